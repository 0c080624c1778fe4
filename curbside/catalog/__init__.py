"""Named queries over the given tables, each with the SQL that must give the same rows."""

from curbside.catalog.registry import ORACLES, QUERIES
from curbside.catalog import demand, destination, learning, market, reports, sampling, storage, streams, trips  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
