"""The incremental operators, run to the end of a file source."""

from pyspark.sql import functions as F

from curbside.catalog.learning import CLIPPED_WALK, ETA, GAMMA, SHARE_NORMALIZER
from curbside.catalog.registry import query
from curbside.catalog.sql import r4
from curbside.functions.menu import reward_per_taxi, reward_share
from curbside.functions.numeric import r4 as round4, r6 as round6
from curbside.operators.learning import IDS
from curbside.sources.adapters import as_decisions
from curbside.sources.staging import staged_path
from curbside.streaming import live, ordered

ASKED = "(o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT))"


@query(
    "m1_hourly_requests",
    f"""SELECT strftime(hour_start, '%Y-%m-%d %H:%M:%S') AS hour_start, PULocationID, num_trips FROM (
          SELECT date_trunc('hour', {ASKED}) AS hour_start, c_nationkey + 1 AS PULocationID, count(*) AS num_trips
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        WHERE hour_start + INTERVAL '1' HOUR <= (SELECT max({ASKED}) - INTERVAL '2' HOUR FROM orders)""",
)
def hourly_requests(t):
    """Hours the watermark has closed by the end of the stream; the last ones stay open."""
    orders = live.stream_parquet(t.spark, t.sf_dir, t.table("orders").schema, "orders.parquet")
    asked = F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT))")
    trips = orders.join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        asked.alias("request_datetime"), (F.col("c_nationkey") + 1).alias("PULocationID")
    )
    path = staged_path(t.spark, "hourly-requests")
    live.append_to(live.hourly_requests(trips), path, staged_path(t.spark, "stream-state")).awaitTermination()
    out = t.spark.read.schema("hour_start TIMESTAMP, PULocationID INT, num_trips BIGINT").parquet(path)
    return out.withColumn("hour_start", F.date_format("hour_start", "yyyy-MM-dd HH:mm:ss"))


@query("m2_running_weights", f"SELECT arm, action, {r4('log_w')} AS log_w FROM weights WHERE (arm, action) IN (SELECT (arm, action) FROM decisions)")
def running_weights(t):
    folder, path = staged_path(t.spark, "decisions"), staged_path(t.spark, "running-weights")
    t.decisions.write.parquet(folder)
    stream = live.stream_parquet(t.spark, folder, t.decisions.schema)
    live.changes_to(
        live.running_weights(stream, reward_per_taxi()), path, staged_path(t.spark, "stream-state")
    ).awaitTermination()
    weights = live.current_rows(t.spark, path, [*IDS, "action"])
    return weights.select("arm", "action", round4("log_w").alias("log_w"))


CLOSED_STEPS = """steps AS (SELECT arm, row_number() OVER (PARTITION BY arm ORDER BY ts, step) AS i, action AS a, reward
      FROM decisions JOIN events ON event_id = step
      WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL '2' HOUR FROM events))"""


@query("m2_ordered_weights", f"WITH RECURSIVE {CLOSED_STEPS}, {CLIPPED_WALK} WHERE arm IN (SELECT arm FROM steps)")
def ordered_weights(t):
    """Clipped weights by the days that the watermark has closed at the end of the stream."""
    events = live.stream_parquet(t.spark, t.sf_dir, t.table("events").schema, "events.parquet")
    weights = ordered.ordered_weights(
        as_decisions(events), reward_share(normalizer=SHARE_NORMALIZER), "ts", "2 hours", 86400, ETA, GAMMA
    )
    path = staged_path(t.spark, "ordered-weights")
    with ordered.keyed_state(t.spark):
        live.changes_to(weights, path, staged_path(t.spark, "stream-state")).awaitTermination()
    now = live.current_rows(t.spark, path, [*IDS, "action"])
    return now.select("arm", "action", round6("log_w").alias("log_w"))
