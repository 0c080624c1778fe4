"""The registered queries against their SQL. CURBSIDE_ALL=1 runs every one of them.

`python tests/check.py 0.01` does the same at a larger scale and shows times.
"""

import os

import pytest

import __spark_entry__ as entry
from check import difference, oracle

SF_DIR = "/root/testdata/sf0.001"
USUAL = (
    "a3_csv_scan",
    "b8_processed_trips",
    "e6_baseline_graph",
    "e11_historical_demand",
    "e15_latent_demand",
    "e19_phase_summary",
    "f7_centered_mean",
    "g5_sampled_trips",
    "j8_destination_distribution",
    "k9_revenue",
    "k13_assigned_destinations",
    "l4_exp3_stable",
    "l7_q_replay",
    "m1_hourly_requests",
    "m2_ordered_weights",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CURBSIDE_ALL") else USUAL


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    out = entry.entry(spark)
    assert out.columns[-1] == "latent_poisson" and out.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert difference(got, oracle(SF_DIR, entry.oracle_sql()[name])) is None
