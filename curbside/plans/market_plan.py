"""One evaluation step of a policy table: from demand and prices to revenue and the next inventory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from curbside.operators import graph, market
from curbside.operators.demand import THETA, demand_lookup, densify_demand
from curbside.sources.staging import stage


@dataclass(frozen=True)
class MarketStep:
    matched: DataFrame
    revenue: DataFrame
    inventory: DataFrame


def evaluate_policies(
    policy: DataFrame, inventory: DataFrame, latent: DataFrame, dest_prob: DataFrame, edges: DataFrame,
    theta: float = THETA,
) -> MarketStep:
    """Expected outcome of every scenario. All inputs are read more than once, so they should be tables."""
    zones = stage(latent.select("PULocationID").distinct(), "zones")
    demand = stage(densify_demand(demand_lookup(latent), zones), "demand")
    fares = graph.densify_fares(edges, zones, graph.fit_line(edges))
    shares = market.choice_shares(policy, theta)
    matched = stage(market.match(market.split_demand(demand, shares), inventory), "matched")
    return MarketStep(
        matched,
        market.revenue(matched, market.mean_fare(dest_prob, fares)),
        market.next_inventory(matched, dest_prob, market.relocation_probs(demand)),
    )
