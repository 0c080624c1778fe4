"""The tables one query needs, built on first use and staged where they are read more than once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.operators import demand, destination, graph, market, trips
from curbside.plans.demand_plan import TRIP_COLUMNS
from curbside.sources import adapters
from curbside.sources.staging import stage

FLEET = [2900, 700, 700, 700]


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str, keep_trips: bool = True, keep: tuple[str, ...] = TRIP_COLUMNS):
        self.spark, self.sf_dir, self.keep_trips, self.keep = spark, sf_dir, keep_trips, keep

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    # trips and graph
    @cached_property
    def raw(self) -> DataFrame:
        return adapters.raw_trips(self.spark, self.sf_dir)

    @cached_property
    def trips(self) -> DataFrame:
        return trips.derive_trips(self.raw)

    @cached_property
    def kept_trips(self) -> DataFrame:
        """Processed trips, as a table for queries that read them more than once."""
        if not self.keep_trips:
            return self.trips
        return stage(self.trips.select(*self.keep), "trips")

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.baseline_graph(self.kept_trips)

    @property
    def graph(self) -> DataFrame:
        return self._graph[0]

    @property
    def fit(self) -> DataFrame:
        return self._graph[1]

    # demand
    @cached_property
    def counts(self) -> DataFrame:
        return stage(demand.hourly_counts(self.kept_trips), "hourly-counts")

    @cached_property
    def zones(self) -> DataFrame:
        return stage(demand.pickup_zones(self.counts), "zones")

    @cached_property
    def historical(self) -> DataFrame:
        return demand.historical_demand(self.counts)

    @cached_property
    def priced(self) -> DataFrame:
        return demand.priced_trips(self.kept_trips, self.graph, self.fit)

    @cached_property
    def latent(self) -> DataFrame:
        return demand.latent_demand(self.historical, demand.mean_acceptance(self.priced))

    @cached_property
    def demand(self) -> DataFrame:
        lookup = demand.demand_lookup(self.latent)
        return stage(demand.densify_demand(lookup, self.zones), "demand")

    # destinations
    @cached_property
    def dest_counts(self) -> DataFrame:
        return stage(destination.destination_counts(self.kept_trips), "destination-counts")

    @cached_property
    def distribution(self) -> DataFrame:
        return destination.destination_distribution(self.dest_counts, slots=destination.slot_grid(self.pickup_ids))

    @cached_property
    def pickup_ids(self) -> DataFrame:
        return stage(destination.distinct_ids(self.dest_counts, "PULocationID"), "pickup-ids")

    @cached_property
    def dropoff_ids(self) -> DataFrame:
        return destination.distinct_ids(self.dest_counts, "DOLocationID")

    @cached_property
    def dest_prob(self) -> DataFrame:
        mapping = destination.dropoff_to_pickup(self.dropoff_ids, self.pickup_ids)
        return stage(destination.merge_onto_pickups(self.distribution, mapping), "destination-probs")

    # market
    @cached_property
    def zone_ids(self) -> DataFrame:
        return self.zones.select(F.col("PULocationID").alias("zone"))

    @cached_property
    def policy(self) -> DataFrame:
        return stage(adapters.policy(self.zone_ids, adapters.scenarios(self.spark, self.sf_dir)), "policy")

    @cached_property
    def inventory(self) -> DataFrame:
        start = market.initial_inventory(self.zone_ids, FLEET)
        return self.policy.drop("multiplier").join(start, ["platform", "zone"]).select(*market.CELL, "n_taxis")

    @cached_property
    def fares(self) -> DataFrame:
        return graph.densify_fares(self.graph, self.zones, graph.fit_line(self.graph))

    @cached_property
    def fare_means(self) -> DataFrame:
        return market.mean_fare(self.dest_prob, self.fares)

    @cached_property
    def shares(self) -> DataFrame:
        return market.choice_shares(self.policy)

    @cached_property
    def split(self) -> DataFrame:
        return market.split_demand(self.demand, self.shares)

    @cached_property
    def matched(self) -> DataFrame:
        return stage(market.match(self.split, self.inventory), "matched")

    @cached_property
    def relocation(self) -> DataFrame:
        return market.relocation_probs(self.demand)

    # logs
    @cached_property
    def decisions(self) -> DataFrame:
        return adapters.decisions(self.spark, self.sf_dir)

    @cached_property
    def two_action_log(self) -> DataFrame:
        """The decisions with the menu reduced to passive (0) and active (1)."""
        return self.decisions.withColumn("action", (F.col("action") >= 2).cast("int"))

    @cached_property
    def firm_log(self) -> DataFrame:
        return adapters.firm_log(self.spark, self.sf_dir)

    @cached_property
    def timeline(self) -> DataFrame:
        return adapters.timeline(self.spark, self.sf_dir)
