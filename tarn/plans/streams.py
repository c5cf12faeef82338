"""The stream's aggregation over the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import scratch
from ..streaming.rates import running_rates
from ..streaming.sessions import OUTPUT, sessions, write_sessions
from .entities import table
from .registry import query


@query(
    "x1_running_rates",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS high_rate FROM events GROUP BY 1, 2",
)
def rates(spark, d):
    return running_rates(table(spark, d, "events")).withColumns({"mean_value": F.round("mean_value", 6), "high_rate": F.round("high_rate", 6)})


GAP_MS = 6 * 3_600_000


@query(
    "x2_user_sessions",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value FROM events), g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {GAP_MS} THEN 0 ELSE 1 END AS new FROM e),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s HAVING max(ms) + {GAP_MS} + 1 < (SELECT max(ms) FROM e)""",
)
def user_sessions(spark, d):
    """Users' sessions that are over, from a stream of the events with state by user and timers."""
    path = scratch(spark, "sessions")
    table(spark, d, "events").select("user_id", "ts", "value").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    write_sessions(sessions(stream, GAP_MS), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{path}/out").withColumn("total", F.round("total", 4))
