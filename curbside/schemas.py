"""Declared schemas of the tables that cross a file boundary."""

from __future__ import annotations

RAW_TRIPS = (
    "PULocationID INT, DOLocationID INT, request_datetime TIMESTAMP_NTZ, on_scene_datetime TIMESTAMP_NTZ, "
    "pickup_datetime TIMESTAMP_NTZ, dropoff_datetime TIMESTAMP_NTZ, originating_base_num STRING, "
    "trip_miles DOUBLE, trip_time BIGINT, base_passenger_fare DOUBLE, bcf DOUBLE, sales_tax DOUBLE, "
    "congestion_surcharge DOUBLE, cbd_congestion_fee DOUBLE, driver_pay DOUBLE, tips DOUBLE, "
    "shared_request_flag STRING, shared_match_flag STRING, access_a_ride_flag STRING, "
    "wav_request_flag STRING, wav_match_flag STRING"
)

GRAPH = (
    "PULocationID INT, DOLocationID INT, baseline_distance DOUBLE, baseline_time DOUBLE, baseline_fare DOUBLE"
)

HISTORICAL = "PULocationID INT, day_of_week INT, request_hour INT, historical_poisson DOUBLE"

LATENT = HISTORICAL + ", avg_historical_acceptance DOUBLE, latent_poisson DOUBLE"

REWARDS_HISTORY = "Episode INT, Revenue DOUBLE"

# Columns a processed trip no longer carries.
DROPPED_TRIP_COLUMNS = (
    "request_datetime",
    "on_scene_datetime",
    "pickup_datetime",
    "dropoff_datetime",
    "originating_base_num",
    "base_passenger_fare",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "cbd_congestion_fee",
    "driver_pay",
    "tips",
    "shared_request_flag",
    "shared_match_flag",
    "access_a_ride_flag",
    "wav_request_flag",
    "wav_match_flag",
)
