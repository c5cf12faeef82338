"""Frames of time and fading means over events, grouping sets, and sketches that are stored by day and merged later."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from ..shared import stage
from .entities import table
from .registry import query

#: Microseconds of a frame, and seconds after which an event's weight has fallen to 1 / e. Times are whole microseconds, so frames have exact ends.
FRAME, FADE = 86_400e6, 172_800.0


def _events(spark, d):
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("double")
    e = table(spark, d, "events").select("user_id", "event_id", at.alias("at"), "value")
    return scans.pack(e, "user_id", "at", "event_id", "value")


@query(
    "w12_rolling_frame",
    "SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)",
)
def rolling_frame(spark, d):
    """Events of each user within a day up to each one."""
    x = scans.rolling(_events(spark, d), FRAME)
    return x.select(F.col("id").alias("event_id"), "n", F.round("s", 4).alias("total"))


@query(
    "w12b_fading_mean",
    f"""SELECT b.event_id, round(sum(a.value * exp(-(epoch(b.ts) - epoch(a.ts)) / {FADE})) / sum(exp(-(epoch(b.ts) - epoch(a.ts)) / {FADE})), 4) AS mean
    FROM events a JOIN events b ON a.user_id = b.user_id AND (a.ts, a.event_id) <= (b.ts, b.event_id) GROUP BY b.event_id""",
)
def fading_mean(spark, d):
    """Each user's mean value so far, in which older events fade."""
    return scans.ewm(_events(spark, d), FADE * 1e6).select(F.col("id").alias("event_id"), F.round("mean", 4).alias("mean"))


@query(
    "a34_cube",
    """SELECT event_type, CAST(user_id % 4 AS INTEGER) AS grp, CAST(date_trunc('week', ts) AS DATE) AS week, GROUPING(event_type, CAST(user_id % 4 AS INTEGER), CAST(date_trunc('week', ts) AS DATE)) AS level, count(*) AS n, round(sum(value), 2) AS total
    FROM events GROUP BY CUBE (event_type, CAST(user_id % 4 AS INTEGER), CAST(date_trunc('week', ts) AS DATE))""",
)
def cube(spark, d):
    """All combinations of three groupings in one pass; ``level`` tells a total from a group whose key is null."""
    x = table(spark, d, "events").select("event_type", (F.col("user_id") % 4).cast("int").alias("grp"), F.date_trunc("week", "ts").cast("date").alias("week"), "value")
    return x.cube("event_type", "grp", "week").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


#: Sizes of the sketches, and the errors that they promise: of distinct counts, relative; of ranks; of shares of a top list.
HLL_BITS, KLL_SIZE, TOP_ITEMS = 12, 400, 64
HLL_ERROR, RANK_ERROR, TOP_ERROR = 4 * 1.04 / 2 ** (HLL_BITS / 2), 0.01, 1 / TOP_ITEMS


def daily_sketches(rows, by, at, key, value, item):
    """``by, day`` and three sketches of each day's rows, as binaries that can be stored and merged in any order."""
    day = F.date_trunc("day", at).cast("date").alias("day")
    return rows.groupBy(*by, day).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(key, HLL_BITS).alias("keys"), F.kll_sketch_agg_double(value, KLL_SIZE).alias("quantiles"), F.expr(f"approx_top_k_accumulate({item}, {TOP_ITEMS})").alias("top")
    )


@query(
    "a34b_merged_sketches",
    """WITH t AS (SELECT event_type, floor(value / 20) AS band, count(*) AS k FROM events GROUP BY 1, 2) SELECT e.event_type, count(*) AS n, count(DISTINCT e.user_id) AS users, round(quantile_disc(value, 0.5), 4) AS median,
    any_value((SELECT max(k) FROM t WHERE t.event_type = e.event_type)) AS most, true AS users_fit, true AS ranks_fit, true AS top_fits FROM events e GROUP BY 1""",
)
def merged_sketches(spark, d):
    """Distinct users, quantiles and the commonest band of values of each event type, from sketches stored by day and merged later; whether each is
    within its promised error of the exact figure."""
    x = table(spark, d, "events").withColumn("band", F.floor(F.col("value") / 20))
    stored = stage(daily_sketches(x, ["event_type"], "ts", "user_id", "value", "band"), "sketches")
    merged = stored.groupBy("event_type").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("est"), F.kll_merge_agg_double("quantiles").alias("q"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {TOP_ITEMS}), 1)").alias("tops"))
    shares = (0.1, 0.25, 0.5, 0.75, 0.9)
    merged = merged.select("event_type", "n", "est", *(F.kll_sketch_get_quantile_double("q", F.lit(p)).alias(f"q{i}") for i, p in enumerate(shares)), F.get("tops", F.lit(0))["count"].alias("top_count"), F.get("tops", F.lit(0))["item"].alias("top_item"))
    # The exact side: ranks of the estimated quantiles, distinct users, and counts by band.
    seen = stage(x.join(F.broadcast(merged), "event_type"), "seen")  # a row per event type
    users = seen.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    bands = seen.groupBy("event_type", "band").agg(F.count("*").alias("k"), F.first("top_item").alias("item"))
    bands = bands.groupBy("event_type").agg(F.max("k").alias("most"), F.max(F.when(F.col("band") == F.col("item"), F.col("k"))).alias("item_count"))
    ranks = seen.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), *(F.avg((F.col("value") < F.col(f"q{i}")).cast("double")).alias(f"below{i}") for i in range(5)), *(F.avg((F.col("value") <= F.col(f"q{i}")).cast("double")).alias(f"upto{i}") for i in range(5)))
    z = merged.join(users, "event_type").join(bands, "event_type").join(ranks, "event_type")
    near = lambda i, p: (F.col(f"below{i}") <= p + RANK_ERROR) & (F.col(f"upto{i}") >= p - RANK_ERROR)
    ranks_fit = F.lit(True)
    for i, p in enumerate(shares):
        ranks_fit = ranks_fit & near(i, p)
    slack = F.col("n") * TOP_ERROR
    top_fits = F.coalesce((F.col("item_count") >= F.col("most") - slack) & (F.abs(F.col("top_count") - F.col("item_count")) <= slack), F.lit(False))
    users_fit = F.abs(F.col("est") - F.col("users")) <= F.greatest(F.col("users") * HLL_ERROR, F.lit(1.0))
    return z.select("event_type", "n", "users", F.round("median", 4).alias("median"), "most", users_fit.alias("users_fit"), ranks_fit.alias("ranks_fit"), top_fits.alias("top_fits"))
