"""Registration of queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curbside.catalog.inputs import Inputs
from curbside.catalog.sql import with_tables
from curbside.plans.demand_plan import TRIP_COLUMNS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, one_pass: bool = False, keep: tuple[str, ...] = TRIP_COLUMNS):
    """Register a function of `Inputs` under `name`; `sql` may use the tables of `catalog.sql`.

    `one_pass` marks queries that read the processed trips once and so need no table of them; the others keep the
    columns `keep` of them.
    """

    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir, keep_trips=not one_pass, keep=keep))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return add
