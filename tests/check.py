"""Run queries next to their SQL: python tests/check.py [sf] [name prefix ...]"""

import math
import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con.execute(sql).df()


# Spark and SQL names of the same type
SAME_TYPE = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def type_differences(schema, sf_dir: str, sql: str) -> list[str]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    want = dict((r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall())
    mine = {f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in schema.fields}
    return [f"{c}: {mine[c]} != {want.get(c)}" for c in mine if mine[c] != want.get(c)]


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return (0, "")
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (bool, int, float)) or type(v).__name__ == "Decimal":
            return (1, repr(float(v)))
        return (2, str(v).replace(" 00:00:00", ""))

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="curbside-check-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    bad = 0
    for name, run in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            got = df.toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            types = type_differences(df.schema, sf_dir, sql) if sql else []
            problem = difference(got, oracle(sf_dir, sql)) if sql else None
            state = "ok" if problem is None else "WRONG"
            note = " ".join([problem or ("" if sql else "(rows only)"), *types])
        except Exception as e:  # report and go on with the next query
            took, state, note, got = time.time() - start, "ERROR", str(e)[:700], []
        bad += state != "ok"
        print(f"{state:6} {name:36} {len(got):8} rows {took:6.2f}s sql {time.time() - start - took:5.2f}s {note}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
