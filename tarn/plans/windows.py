"""Ranks, running totals, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from .entities import EXPRESSION, METRICS, SURVIVAL, expression, metrics, survival, table
from .registry import query

_r = lambda c, n=6: F.round(c, n)
_AVG_RANK = "rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0"


@query("w1_average_rank", f"WITH {SURVIVAL} SELECT id, CAST({_AVG_RANK.format(g='cohort', x='time')} AS DOUBLE) AS rank FROM survival")
def average_rank(spark, d):
    return stats.average_rank(survival(spark, d), "time", ["cohort"]).select("id", "rank")


@query("w2_percentile_rank", f"WITH {SURVIVAL} SELECT id, round(({_AVG_RANK.format(g='cohort', x='time')} - 1) / nullif(count(*) OVER (PARTITION BY cohort) - 1, 0), 6) AS pct FROM survival")
def percentile_rank(spark, d):
    return stats.percentile_rank(survival(spark, d), "time", ["cohort"]).select("id", _r("pct").alias("pct"))


_PCT = f"WITH {EXPRESSION}, m AS (SELECT gene, cohort, avg(value) AS mean, stddev_samp(value) AS sd FROM expression GROUP BY 1, 2), p AS (SELECT *, percent_rank() OVER (PARTITION BY cohort ORDER BY mean) AS pm, percent_rank() OVER (PARTITION BY cohort ORDER BY sd) AS ps FROM m)"


def _gene_levels(spark, d):
    """Tertiles of mean and spread for every gene and cohort."""
    m = expression(spark, d).groupBy("gene", "cohort").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    m = stats.percentile_rank(stats.percentile_rank(m, "mean", ["cohort"], "pm"), "sd", ["cohort"], "ps")
    third = lambda c: F.when(F.col(c) <= 1 / 3, 0).when(F.col(c) <= 2 / 3, 1).otherwise(2)
    return m.withColumns({"tm": third("pm"), "ts": third("ps")})


_T = "CASE WHEN {0} <= 1.0 / 3 THEN 0 WHEN {0} <= 2.0 / 3 THEN 1 ELSE 2 END"


@query("w3_tertiles", f"{_PCT} SELECT gene, cohort, {_T.format('pm')} AS tm, {_T.format('ps')} AS ts FROM p")
def tertiles(spark, d):
    return _gene_levels(spark, d).select("gene", "cohort", "tm", "ts")


@query(
    "w4_joint_stratum",
    f"{_PCT} SELECT gene, CAST(sum(CASE WHEN cohort = 'A' THEN 27 * {_T.format('pm')} + 9 * {_T.format('ps')} ELSE 3 * {_T.format('pm')} + {_T.format('ps')} END) AS BIGINT) AS stratum FROM p GROUP BY gene",
)
def joint_stratum(spark, d):
    code = F.when(F.col("cohort") == "A", 27 * F.col("tm") + 9 * F.col("ts")).otherwise(3 * F.col("tm") + F.col("ts"))
    return _gene_levels(spark, d).groupBy("gene").agg(F.sum(code).cast("long").alias("stratum"))


@query(
    "w5_quartile_cut",
    f"""WITH {SURVIVAL}, r AS (SELECT id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY time, id) AS r, count(*) OVER (PARTITION BY cohort) AS n FROM survival)
    SELECT id, CAST(greatest(1, ceil((r - 1) * 4 / greatest(n - 1, 1))) AS INTEGER) AS bucket FROM r""",
)
def quartile_cut(spark, d):
    return stats.quantile_bucket(survival(spark, d), "time", ["id"], ["cohort"]).select("id", "bucket")


@query("w6_cumulative_sum", f"WITH {SURVIVAL} SELECT id, CAST(sum(event) OVER (PARTITION BY cohort ORDER BY time RANGE UNBOUNDED PRECEDING) AS BIGINT) AS events FROM survival")
def cumulative_sum(spark, d):
    w = Window.partitionBy("cohort").orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    return survival(spark, d).select("id", F.sum("event").over(w).alias("events"))


@query("w7_cumulative_product", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(product(1 - l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING), 6) AS p FROM lineitem")
def cumulative_product(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(F.product(1 - F.col("l_discount")).over(w)).alias("p"))


@query(
    "w8_reverse_cumulative_min",
    """WITH p AS (SELECT c_mktsegment AS g, c_custkey AS id, (abs(c_acctbal) % 1000 + 0.5) / 1001 AS p FROM customer),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY g) / row_number() OVER (PARTITION BY g ORDER BY p, id) AS raw FROM p)
    SELECT id, round(least(1.0, min(raw) OVER (PARTITION BY g ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""",
)
def reverse_cumulative_min(spark, d):
    p = table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("id"), ((F.abs("c_acctbal") % 1000 + 0.5) / 1001).alias("p"))
    return stats.bh_adjust(p, "p", ["g"]).select("id", _r("q").alias("q"))


@query("w9_tie_group_end", f"WITH {SURVIVAL} SELECT id, count(*) OVER (PARTITION BY cohort ORDER BY time RANGE UNBOUNDED PRECEDING) AS last_index FROM survival")
def tie_group_end(spark, d):
    w = Window.partitionBy("cohort").orderBy("time").rangeBetween(Window.unboundedPreceding, 0)
    return survival(spark, d).select("id", F.count("*").over(w).alias("last_index"))


@query("w10_ranked_view", "SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS BIGINT) AS rank FROM part")
def ranked_view(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    return table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("rank"))


@query("w11_monotone_check", "SELECT user_id, bool_and(coalesce(ts > p, true)) AS strictly_increasing FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY 1")
def monotone_check(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "ts", F.lag("ts").over(w).alias("p"))
    return e.groupBy("user_id").agg(F.bool_and(F.coalesce(F.col("ts") > F.col("p"), F.lit(True))).alias("strictly_increasing"))


@query("o1_stable_sort_place", "SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer")
def stable_sort(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_mktsegment", F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("o2_frozen_order", f"WITH {METRICS} SELECT model, list_position(['view', 'click', 'purchase', 'signup', 'error'], model) AS place, count(*) AS n FROM metrics GROUP BY 1")
def frozen_order(spark, d):
    order = F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error")))
    return metrics(spark, d).groupBy("model").agg(F.count("*").alias("n")).select("model", F.array_position(order, F.col("model")).cast("int").alias("place"), "n")


@query("o3_top_variance", f"WITH {EXPRESSION} SELECT gene, round(var_samp(value), 6) AS v FROM expression GROUP BY gene ORDER BY var_samp(value) DESC, gene LIMIT 20")
def top_variance(spark, d):
    return expression(spark, d).groupBy("gene").agg(F.var_samp("value").alias("v")).orderBy(F.col("v").desc(), "gene").limit(20).select("gene", _r("v").alias("v"))


@query("o4_top_per_fold", f"WITH {EXPRESSION}, v AS (SELECT sample % 5 AS fold, gene, var_samp(value) AS v FROM expression GROUP BY 1, 2) SELECT fold, gene FROM v QUALIFY row_number() OVER (PARTITION BY fold ORDER BY v DESC, gene) <= 10")
def top_per_fold(spark, d):
    v = expression(spark, d).groupBy((F.col("sample") % 5).alias("fold"), "gene").agg(F.var_samp("value").alias("v"))
    w = Window.partitionBy("fold").orderBy(F.col("v").desc(), "gene")
    return v.withColumn("k", F.row_number().over(w)).filter("k <= 10").select("fold", "gene")


@query("o5_examples", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_name))[1:5], ';') AS examples FROM customer GROUP BY 1")
def examples(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("c_name")), 1, 5), ";").alias("examples"))


_CANDIDATES = "c AS (SELECT c_nationkey AS fold, c_mktsegment AS path, round(avg(c_acctbal) / 10000, 3) AS score, count(*) AS alpha FROM customer GROUP BY 1, 2)"


def _candidates(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fold"), F.col("c_mktsegment").alias("path")).agg(_r(F.avg("c_acctbal") / 10000, 3).alias("score"), F.count("*").alias("alpha"))


@query("o6_best_within_tolerance", f"WITH {_CANDIDATES} SELECT fold, max(alpha) AS alpha FROM (SELECT *, max(score) OVER (PARTITION BY fold) AS best FROM c) WHERE score >= best - 0.005 GROUP BY 1")
def best_within_tolerance(spark, d):
    """Among candidates as good as the best, the most regularised one."""
    best = F.max("score").over(Window.partitionBy("fold"))
    return _candidates(spark, d).withColumn("best", best).filter("score >= best - 0.005").groupBy("fold").agg(F.max("alpha").alias("alpha"))


@query("o7_lexicographic_choice", f"WITH {_CANDIDATES} SELECT fold, arg_min(alpha, (path, -alpha)) AS alpha, min(path) AS path FROM (SELECT *, max(score) OVER (PARTITION BY fold) AS best FROM c) WHERE score >= best - 0.05 GROUP BY 1")
def lexicographic_choice(spark, d):
    best = F.max("score").over(Window.partitionBy("fold"))
    near = _candidates(spark, d).withColumn("best", best).filter("score >= best - 0.05")
    return near.groupBy("fold").agg(F.min_by("alpha", F.struct(F.col("path"), -F.col("alpha"))).alias("alpha"), F.min("path").alias("path"))


@query(
    "o7b_nearest_grid_point",
    """WITH g AS (SELECT unnest([1.0::DOUBLE, 10.0, 100.0, 1000.0, 10000.0]) AS a), m AS (SELECT c_nationkey AS fold, median(log10(abs(c_acctbal) + 1)) AS m FROM customer GROUP BY 1),
    x AS (SELECT fold, a, abs(log10(a) - m) AS dist, min(abs(log10(a) - m)) OVER (PARTITION BY fold) AS best FROM m, g) SELECT fold, max(a) AS alpha FROM x WHERE dist <= best + 1e-12 GROUP BY 1""",
)
def nearest_grid_point(spark, d):
    """The grid value nearest the median in log space; of two, the larger. The grid is an array, not a joined table."""
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fold")).agg(F.median(F.log10(F.abs("c_acctbal") + 1)).alias("m"))
    points = F.array(*map(F.lit, (1.0, 10.0, 100.0, 1000.0, 10000.0)))
    dist = F.transform(points, lambda a: F.abs(F.log10(a) - F.col("m")))
    near = F.filter(F.arrays_zip(points.alias("a"), dist.alias("k")), lambda z: z["k"] <= F.array_min(dist) + 1e-12)
    return m.select("fold", F.array_max(F.transform(near, lambda z: z["a"])).alias("alpha"))


@query(
    "o8_order_statistic_midpoint",
    f"""WITH {SURVIVAL}, r AS (SELECT arm, time / (x / 100000.0) AS ratio, row_number() OVER (PARTITION BY arm ORDER BY time / (x / 100000.0), id) AS k FROM survival)
    SELECT arm, round(avg(ratio), 4) AS cut FROM r WHERE k IN (40, 41) GROUP BY 1""",
)
def order_statistic(spark, d):
    """The point between the 40th and the 41st ratio: a cut that gives an exact count of events."""
    ratio = F.col("time") / (F.col("x") / 100000.0)
    w = Window.partitionBy("arm").orderBy("ratio", "id")
    r = survival(spark, d).withColumn("ratio", ratio).withColumn("k", F.row_number().over(w))
    return r.filter(F.col("k").isin(40, 41)).groupBy("arm").agg(_r(F.avg("ratio"), 4).alias("cut"))
