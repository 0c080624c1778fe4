"""Raw trips to processed trips, fare graph, observed and latent demand, each kept as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from curbside.operators import demand, graph, trips
from curbside.sources.staging import stage
from curbside.sources.tables import write_csv, write_parquet

TRIP_COLUMNS = (
    "PULocationID",
    "DOLocationID",
    "request_date",
    "day_of_week",
    "request_hour",
    "trip_miles",
    "trip_time",
    "base_fare",
)


@dataclass(frozen=True)
class DemandTables:
    trips: DataFrame
    graph: DataFrame
    fit: DataFrame
    historical: DataFrame
    latent: DataFrame


def estimate_demand(raw: DataFrame, theta: float = demand.THETA, calendar_rule: str = "weekday") -> DemandTables:
    """All tables of the demand workflow. The processed trips are staged once and scanned three times."""
    kept = stage(trips.derive_trips(raw, calendar_rule).select(*TRIP_COLUMNS), "trips")
    edges, fit = graph.baseline_graph(kept)
    historical = demand.historical_demand_of(kept)
    priced = demand.priced_trips(kept, edges, fit, theta)
    return DemandTables(kept, edges, fit, historical, demand.latent_demand(historical, demand.mean_acceptance(priced)))


def save_demand(tables: DemandTables, folder: str, csv: bool = False) -> None:
    """Write the graph and both demand tables under `folder`, sorted by key when written as CSV."""
    for name, df, keys in (
        ("graph", tables.graph, graph.EDGE),
        ("historical_mle_params", tables.historical, demand.SLOT),
        ("latent_mle_params", tables.latent, demand.SLOT),
    ):
        if csv:
            write_csv(df, f"{folder}/{name}", keys)
        else:
            write_parquet(df, f"{folder}/{name}")
