"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import stats
from ..shared import stage
from .entities import DELTAS, DESIGN, EXPRESSION, METRICS, SURVIVAL, deltas, design, expression, metrics, survival, table
from .registry import query

_r = lambda c, n=6: F.round(c, n)


@query("a1_group_mean", f"WITH {METRICS} SELECT scenario, model, round(avg(metric), 6) AS mean_metric, count(*) AS n FROM metrics GROUP BY 1, 2")
def group_mean(spark, d):
    return metrics(spark, d).groupBy("scenario", "model").agg(_r(F.avg("metric")).alias("mean_metric"), F.count("*").alias("n"))


@query("a2_finite_summary", f"WITH {DELTAS} SELECT model, round(avg(delta), 3) AS mean, round(median(delta), 6) AS median, round(avg(CASE WHEN delta IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS finite FROM deltas GROUP BY 1")
def finite_summary(spark, d):
    return deltas(spark, d).groupBy("model").agg(_r(stats.finite_mean("delta"), 3).alias("mean"), _r(stats.finite_median("delta")).alias("median"), _r(stats.finite_fraction("delta")).alias("finite"))


@query("a3_rate_over_valid", f"WITH {DELTAS} SELECT scenario, model, round(avg(CASE WHEN delta IS NOT NULL THEN CASE WHEN delta <= -0.02 THEN 1.0 ELSE 0.0 END END), 6) AS rate FROM deltas GROUP BY 1, 2")
def rate_over_valid(spark, d):
    return deltas(spark, d).groupBy("scenario", "model").agg(_r(stats.rate_over(F.col("delta") <= -0.02, S.is_finite("delta"))).alias("rate"))


_SCENARIO = f"""{DELTAS}, s AS (SELECT scenario, model, avg(metric) AS mean_metric, avg(delta) AS mean_delta,
  avg(CASE WHEN delta IS NOT NULL THEN CASE WHEN delta <= -0.02 THEN 1.0 ELSE 0.0 END END) AS nt,
  avg(CASE WHEN delta IS NOT NULL THEN CASE WHEN delta <= -0.05 THEN 1.0 ELSE 0.0 END END) AS cat FROM deltas GROUP BY 1, 2)"""


def scenario_summary(spark, d):
    valid = S.is_finite("delta")
    return deltas(spark, d).groupBy("scenario", "model").agg(
        stats.finite_mean("metric").alias("mean_metric"), stats.finite_mean("delta").alias("mean_delta"),
        stats.rate_over(F.col("delta") <= -0.02, valid).alias("nt"), stats.rate_over(F.col("delta") <= -0.05, valid).alias("cat"),
    )


@query("a4_scenario_equal_mean", f"WITH {_SCENARIO} SELECT model, round(avg(mean_delta), 6) AS mean_delta, round(avg(nt), 6) AS nt, round(avg(cat), 6) AS cat FROM s GROUP BY 1")
def scenario_equal(spark, d):
    """Each scenario counts once, however many replicates it has."""
    return scenario_summary(spark, d).groupBy("model").agg(*(_r(F.avg(c)).alias(c) for c in ("mean_delta", "nt", "cat")))


@query("a5_scenario_model_summary", f"WITH {_SCENARIO} SELECT scenario, model, round(mean_metric, 6) AS mean_metric, round(mean_delta, 6) AS mean_delta, round(nt, 6) AS nt, round(cat, 6) AS cat FROM s")
def scenario_model(spark, d):
    return scenario_summary(spark, d).select("scenario", "model", *(_r(c).alias(c) for c in ("mean_metric", "mean_delta", "nt", "cat")))


@query("a6_pairwise_complete", f"WITH {DELTAS} SELECT model, count(*) AS n, round(avg(metric), 6) AS mean_metric FROM deltas WHERE delta IS NOT NULL AND metric IS NOT NULL GROUP BY 1")
def pairwise_complete(spark, d):
    both = S.is_finite("delta") & S.is_finite("metric")
    return deltas(spark, d).groupBy("model").agg(F.count_if(both).alias("n"), _r(F.avg(F.when(both, F.col("metric")))).alias("mean_metric"))


@query("a7_filtered_subsets", f"WITH {_SCENARIO}, {DESIGN} SELECT model, round(avg(mean_delta) FILTER (scenario_class = 'CORE'), 6) AS core, round(avg(mean_delta) FILTER (severity = 2), 6) AS severe, round(avg(mean_delta) FILTER (starts_with(regime, 'R5')), 6) AS r5 FROM s JOIN design USING (scenario) GROUP BY 1")
def filtered_subsets(spark, d):
    x = F.col("mean_delta")
    return scenario_summary(spark, d).join(design(spark, d), "scenario").groupBy("model").agg(
        _r(F.avg(F.when(F.col("scenario_class") == "CORE", x))).alias("core"), _r(F.avg(F.when(F.col("severity") == 2, x))).alias("severe"), _r(F.avg(F.when(F.col("regime").startswith("R5"), x))).alias("r5")
    )


@query("a8_regime_aggregate", f"WITH {_SCENARIO}, {DESIGN} SELECT split_part(regime, '_', 1) AS regime, model, count(*) AS n_scenarios, round(avg(mean_delta), 6) AS mean_delta, round(avg(nt), 6) AS nt FROM s JOIN design USING (scenario) GROUP BY 1, 2")
def regime_aggregate(spark, d):
    return scenario_summary(spark, d).join(design(spark, d), "scenario").groupBy(F.split_part("regime", F.lit("_"), F.lit(1)).alias("regime"), "model").agg(F.count("*").alias("n_scenarios"), _r(F.avg("mean_delta")).alias("mean_delta"), _r(F.avg("nt")).alias("nt"))


@query("a9_overall_roles", f"WITH {METRICS} SELECT model, CASE model WHEN 'view' THEN 'reference' WHEN 'click' THEN 'primary' ELSE 'other' END AS role, round(avg(metric), 6) AS mean_metric FROM metrics GROUP BY 1")
def overall_roles(spark, d):
    roles = F.when(F.col("model") == "view", "reference").when(F.col("model") == "click", "primary").otherwise("other")
    return metrics(spark, d).groupBy("model").agg(_r(F.avg("metric")).alias("mean_metric")).withColumn("role", roles)


_WEIGHTS = f"""{DESIGN}, weights AS (
  SELECT 'original' AS estimand, scenario, 1.0 / count(*) OVER () AS w FROM design
  UNION ALL SELECT 'core_only', scenario, 1.0 / count(*) OVER () FROM design WHERE scenario_class = 'CORE'
  UNION ALL SELECT 'regime_balanced', scenario, 1.0 / (6 * count(*) OVER (PARTITION BY split_part(regime, '_', 1))) FROM design)"""


def weights(spark, d):
    """``estimand, scenario, w``; sums over the design come from one aggregated row and joins, not from a window over all of it."""
    x = stage(design(spark, d).withColumn("r", F.split_part("regime", F.lit("_"), F.lit(1))), "design")
    n, core = x.agg(F.count("*"), F.count_if(F.col("scenario_class") == "CORE")).first()
    original = x.select(F.lit("original").alias("estimand"), "scenario", F.lit(1.0 / max(n, 1)).alias("w"))
    core_only = x.filter("scenario_class = 'CORE'").select(F.lit("core_only").alias("estimand"), "scenario", F.lit(1.0 / max(core, 1)).alias("w"))
    by_regime = x.groupBy("r").agg((1.0 / (6 * F.count("*"))).alias("w"))
    balanced = x.join(by_regime, "r").select(F.lit("regime_balanced").alias("estimand"), "scenario", "w")
    return original.unionByName(core_only).unionByName(balanced)


@query("a10_estimand_weights", f"WITH {_WEIGHTS} SELECT estimand, scenario, round(w, 6) AS w FROM weights")
def estimand_weights(spark, d):
    return weights(spark, d).select("estimand", "scenario", _r("w").alias("w"))


@query("a11_weighted_point", f"WITH {_SCENARIO}, {_WEIGHTS} SELECT estimand, model, round(sum(w * mean_delta), 6) AS mean_delta, round(sum(w * nt), 6) AS nt FROM weights JOIN s USING (scenario) GROUP BY 1, 2")
def weighted_point(spark, d):
    return weights(spark, d).join(scenario_summary(spark, d), "scenario").groupBy("estimand", "model").agg(_r(F.sum(F.col("w") * F.col("mean_delta"))).alias("mean_delta"), _r(F.sum(F.col("w") * F.col("nt"))).alias("nt"))


@query("a12_weighted_mean_complete", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1 HAVING count(*) = count(l_discount)")
def weighted_mean_complete(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(_r(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity"))).alias("weighted"), F.count("*").alias("n"), F.count(S.finite("l_discount")).alias("m"))
    return g.filter("n = m").select("l_returnflag", "weighted")


@query(
    "a13_hierarchical_mean",
    f"""WITH {METRICS}, f AS (SELECT model, scenario % 20 AS repeat, scenario % 5 AS fold, avg(metric) AS m FROM metrics GROUP BY 1, 2, 3),
    r AS (SELECT model, repeat, avg(m) AS m FROM f GROUP BY 1, 2 HAVING count(m) >= 1) SELECT model, count(*) AS n_repeats, round(avg(m), 6) AS m FROM r GROUP BY 1 HAVING count(*) >= 16""",
)
def hierarchical_mean(spark, d):
    """Folds are averaged within a repeat, repeats within a model, if enough of them are complete."""
    f = metrics(spark, d).groupBy("model", (F.col("scenario") % 20).alias("repeat"), (F.col("scenario") % 5).alias("fold")).agg(F.avg("metric").alias("m"))
    r = f.groupBy("model", "repeat").agg(F.avg("m").alias("m"), F.count(S.finite("m")).alias("k")).filter("k >= 1")
    return r.groupBy("model").agg(F.count("*").alias("n_repeats"), _r(F.avg("m")).alias("m")).filter("n_repeats >= 16")


@query(
    "a14_formula_selection",
    """WITH f AS (SELECT l_returnflag AS g, l_linenumber AS fold, avg(l_discount) AS m, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2),
    c AS (SELECT g, avg(m) AS plain, sum(n * m) / sum(n) AS weighted, median(m) AS med, max(m) AS top FROM f GROUP BY 1),
    p AS (SELECT l_returnflag AS g, sum(l_quantity * l_discount) / sum(l_quantity) AS published FROM lineitem GROUP BY 1),
    x AS (SELECT g, unnest(['plain', 'weighted', 'median', 'max']) AS formula, unnest([abs(plain - published), abs(weighted - published), abs(med - published), abs(top - published)]) AS diff FROM c JOIN p USING (g))
    SELECT g, arg_min(formula, diff) AS formula, round(min(diff), 6) AS diff FROM x GROUP BY g""",
)
def formula_selection(spark, d):
    """Four ways to aggregate folds; the one that comes nearest the published value is chosen."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g")
    f = li.groupBy("g", "l_linenumber").agg(F.avg("l_discount").alias("m"), F.sum("l_quantity").alias("n"))
    c = f.groupBy("g").agg(F.avg("m").alias("plain"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("weighted"), F.median("m").alias("median"), F.max("m").alias("max"))
    p = li.groupBy("g").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("published"))
    x = c.join(p, "g").unpivot(["g", "published"], ["plain", "weighted", "median", "max"], "formula", "value").withColumn("diff", F.abs(F.col("value") - F.col("published")))
    return x.groupBy("g").agg(F.min_by("formula", "diff").alias("formula"), _r(F.min("diff")).alias("diff"))


@query("a15_weighted_group_mean", f"WITH {_SCENARIO}, {DESIGN} SELECT severity, model, CASE WHEN count(*) = count(mean_delta) THEN round(sum(events * mean_delta) / sum(events), 6) END AS shift FROM s JOIN design USING (scenario) GROUP BY 1, 2")
def weighted_group_mean(spark, d):
    x = scenario_summary(spark, d).join(design(spark, d), "scenario").groupBy("severity", "model")
    full = F.count("*") == F.count(S.finite("mean_delta"))
    return x.agg(F.when(full, _r(F.try_divide(F.sum(F.col("events") * F.col("mean_delta")), F.sum("events")))).alias("shift"))


@query("a16_count_distinct", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n_nations, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1")
def count_distinct(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("n_nations"), F.count_distinct("c_custkey").alias("n"))


@query("a17_value_counts_domain", "SELECT x AS size, count(p_partkey) AS n FROM (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS x) LEFT JOIN part ON p_size = x GROUP BY 1")
def value_counts_domain(spark, d):
    """Counts over the full domain, zeros included."""
    domain = spark.range(0, 61).select(F.col("id").cast("int").alias("size"))
    n = table(spark, d, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    return domain.join(n, "size", "left").select("size", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("a18_crosstab", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def crosstab(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("a19_category_distribution", "SELECT c_nationkey, c_mktsegment, round(count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey), 6) AS share FROM customer GROUP BY 1, 2")
def category_distribution(spark, d):
    total = F.sum("n").over(Window.partitionBy("c_nationkey"))
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).select("c_nationkey", "c_mktsegment", _r(F.col("n") / total).alias("share"))


@query("a19b_status_histogram", f"WITH {DELTAS} SELECT model, count(delta) AS n_finite, count(*) - count(delta) AS n_missing, '{{\"missing\":' || (count(*) - count(delta)) || ',\"ok\":' || count(delta) || '}}' AS histogram FROM deltas GROUP BY 1")
def status_histogram(spark, d):
    n, m = F.count(S.finite("delta")), F.count("*") - F.count(S.finite("delta"))
    return deltas(spark, d).groupBy("model").agg(n.alias("n_finite"), m.alias("n_missing")).withColumn("histogram", F.to_json(F.struct(F.col("n_missing").alias("missing"), F.col("n_finite").alias("ok"))))


@query("a20_sorted_distinct_set", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def sorted_distinct_set(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("a21_ordered_concat", "SELECT user_id, string_agg(event_type, '>' ORDER BY f) AS path FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_concat(spark, d):
    """Distinct values in the order of their first occurrence."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ">").alias("path"))


@query("a22_grouped_median", f"WITH {EXPRESSION} SELECT CAST(gene // 8 AS INTEGER) AS gene_set, sample, round(median(value), 6) AS value FROM expression GROUP BY 1, 2")
def grouped_median(spark, d):
    return expression(spark, d).groupBy(F.floor(F.col("gene") / 8).cast("int").alias("gene_set"), "sample").agg(_r(F.median("value")).alias("value"))


@query("a23_quantiles", f"WITH {SURVIVAL} SELECT arm, round(quantile_cont(time, 0.25), 6) AS q25, round(quantile_cont(time, 0.8), 6) AS q80, round(quantile_cont(time, 0.975), 6) AS q975 FROM survival GROUP BY 1")
def quantiles(spark, d):
    return survival(spark, d).groupBy("arm").agg(*(_r(F.percentile("time", p)).alias(n) for n, p in (("q25", 0.25), ("q80", 0.8), ("q975", 0.975))))


@query("a24_variances", "SELECT c_nationkey, round(var_pop(c_acctbal), 4) AS var0, round(var_samp(c_acctbal), 4) AS var1, round(stddev_pop(c_acctbal), 4) AS sd0, round(stddev_samp(c_acctbal), 4) AS sd1 FROM customer GROUP BY 1")
def variances(spark, d):
    x = "c_acctbal"
    return table(spark, d, "customer").groupBy("c_nationkey").agg(_r(F.var_pop(x), 4).alias("var0"), _r(F.var_samp(x), 4).alias("var1"), _r(F.stddev_pop(x), 4).alias("sd0"), _r(F.stddev_samp(x), 4).alias("sd1"))


@query("a25_all_any", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_totalprice > 499000) AS any_huge FROM orders GROUP BY 1")
def all_any(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"), F.bool_or(F.col("o_totalprice") > 499000).alias("any_huge"))


@query("a26_argmax_row", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_order, max(o_totalprice) AS price FROM orders GROUP BY 1")
def argmax_row(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("best_order"), F.max("o_totalprice").alias("price"))


@query(
    "a27_grouping_sets",
    """SELECT CASE WHEN l_linestatus IS NULL AND l_returnflag IS NULL THEN 'all' WHEN l_linestatus IS NULL THEN 'flag' WHEN l_returnflag IS NULL THEN 'status' ELSE 'both' END AS grouping,
    l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))""",
)
def grouping_sets(spark, d):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    g = table(spark, d, "lineitem").groupingSets([[], [f], [s], [f, s]], f, s).agg(F.count("*").alias("n"), _r(F.avg("l_quantity")).alias("mean"), F.grouping_id().alias("gid"))
    return g.select(F.element_at(F.array(*map(F.lit, ("both", "flag", "status", "all"))), (F.col("gid") + 1).cast("int")).alias("grouping"), "l_returnflag", "l_linestatus", "n", "mean")


@query(
    "a28_axis_levels",
    f"""WITH {_SCENARIO}, {DESIGN}, x AS (SELECT unnest(['events', 'severity']) AS axis, unnest([events, severity]) AS level, model, mean_delta FROM s JOIN design USING (scenario))
    SELECT axis, level, model, count(*) AS n, round(avg(mean_delta), 6) AS mean_delta FROM x GROUP BY 1, 2, 3""",
)
def axis_levels(spark, d):
    x = scenario_summary(spark, d).join(design(spark, d), "scenario").unpivot(["model", "mean_delta"], ["events", "severity"], "axis", "level")
    return x.groupBy("axis", "level", "model").agg(F.count("*").alias("n"), _r(F.avg("mean_delta")).alias("mean_delta"))


_PROFILED = ("c_name", "c_acctbal", "c_mktsegment")


@query(
    "a29_column_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS n_unique, round(avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS numeric_fraction,
    min(TRY_CAST({c} AS DOUBLE)) AS low, max(TRY_CAST({c} AS DOUBLE)) AS high FROM customer""" for c in _PROFILED
    ),
)
def column_profile(spark, d):
    """All columns in one pass over the table."""
    c = table(spark, d, "customer")
    parts = []
    for name in _PROFILED:
        x = F.col(name).cast("string").try_cast("double")
        parts += [F.count(name).alias(f"{name}_n"), F.count_distinct(name).alias(f"{name}_u"), F.avg(x.isNotNull().cast("double")).alias(f"{name}_f"), F.min(x).alias(f"{name}_l"), F.max(x).alias(f"{name}_h")]
    rows = F.array(*(F.struct(F.lit(k).alias("column_name"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_u").alias("n_unique"), _r(f"{k}_f").alias("numeric_fraction"), F.col(f"{k}_l").alias("low"), F.col(f"{k}_h").alias("high")) for k in _PROFILED))
    return c.agg(*parts).select(F.inline(rows))


@query("a30_collection_sizes", "SELECT min(n) AS low, max(n) AS high, count(*) FILTER (n > 10) AS over_ten FROM (SELECT len(list(o_orderkey)) AS n FROM orders GROUP BY o_custkey)")
def collection_sizes(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.size(F.collect_list("o_orderkey")).cast("long").alias("n"))
    return n.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count_if(F.col("n") > 10).alias("over_ten"))


@query("a31_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("a32_drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "a33_group_correlations",
    f"""WITH {METRICS}, c AS (SELECT scenario, model, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(replicate) > 1e-12 AND stddev_pop(metric) > 1e-12 THEN covar_pop(metric, replicate) / (stddev_pop(replicate) * stddev_pop(metric)) END AS r FROM metrics GROUP BY 1, 2)
    SELECT model, count(r) AS n, round(median(r), 6) AS median_r, round(quantile_cont(r, 0.25), 6) AS q25 FROM c GROUP BY 1""",
)
def group_correlations(spark, d):
    c = metrics(spark, d).groupBy("scenario", "model").agg(stats.pearson("metric", F.col("replicate").cast("double")).alias("r"))
    return c.groupBy("model").agg(F.count("r").alias("n"), _r(F.median("r")).alias("median_r"), _r(F.percentile("r", 0.25)).alias("q25"))
