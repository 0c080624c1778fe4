"""Raw trip records to processed trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbside.functions import calendar
from curbside.functions.numeric import r2
from curbside.schemas import DROPPED_TRIP_COLUMNS

OFF_PEAK_DAYS = (2, 3)
OFF_PEAK_HOURS = (2, 3)


def derive_trips(raw: DataFrame, calendar_rule: str = "weekday") -> DataFrame:
    """Add waiting time, calendar parts and money columns, and drop the raw columns behind them.

    `calendar_rule="weekday"` keeps a DATE and the true weekday; `"day_of_month"` keeps the day
    number and the weekday formula that holds only for a month beginning on a Thursday.
    """
    asked = F.col("request_datetime")
    if calendar_rule == "weekday":
        date, dow = F.to_date(asked), calendar.weekday(asked)
    elif calendar_rule == "day_of_month":
        date, dow = F.dayofmonth(asked), calendar.weekday_from_day_of_month(asked)
    else:
        raise ValueError(f"Unknown calendar rule: {calendar_rule}")
    return raw.withColumns(
        {
            "waiting_time": calendar.whole_seconds_between("request_datetime", "pickup_datetime"),
            "request_date": date,
            "day_of_week": dow,
            "request_hour": F.hour(asked),
            "base_fare": r2(F.col("base_passenger_fare") + F.col("bcf") + F.col("sales_tax")),
            "congestion_tax": F.col("congestion_surcharge") + F.col("cbd_congestion_fee"),
            "driver_income": r2(F.col("driver_pay") + F.col("tips")),
        }
    ).drop(*DROPPED_TRIP_COLUMNS)


def is_off_peak(days=OFF_PEAK_DAYS, hours=OFF_PEAK_HOURS) -> Column:
    return F.col("day_of_week").isin(*days) & F.col("request_hour").isin(*hours)


def off_peak(trips: DataFrame, days=OFF_PEAK_DAYS, hours=OFF_PEAK_HOURS) -> DataFrame:
    return trips.where(is_off_peak(days, hours))
