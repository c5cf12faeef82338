"""Second ways to the same numbers, support audits and permutation refits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import stats
from ..operators import survival as V
from ..shared import stage
from .aggregates import _SCENARIO, scenario_summary
from .entities import DESIGN, EXPRESSION, SELECTION, SURVIVAL, design, expression, selection, survival
from .registry import query
from .survival import _tau, km_sql

_r = lambda c, n=6: F.round(c, n)


@query(
    "v2_km_two_ways",
    f"""WITH {SURVIVAL}, {km_sql('km', 'cohort')}, f AS (SELECT cohort, product(1 - d / n) AS by_fold FROM km GROUP BY 1), w AS (SELECT cohort, arg_max(s, t) AS by_window FROM km GROUP BY 1)
    SELECT cohort, round(by_window, 6) AS by_window, round(by_fold, 6) AS by_fold, abs(by_window - by_fold) <= 1e-12 AS agrees FROM w JOIN f USING (cohort)""",
)
def km_two_ways(spark, d):
    """The window product against a product over each cohort's steps."""
    km = stage(V.kaplan_meier(survival(spark, d), ["cohort"]), "km")
    last = km.groupBy("cohort").agg(F.max_by("s", "t").alias("by_window"), F.product(1 - F.col("d") / F.col("n")).alias("by_fold"))
    agrees = F.abs(F.col("by_window") - F.col("by_fold")) <= 1e-12
    return last.select("cohort", _r("by_window").alias("by_window"), _r("by_fold").alias("by_fold"), agrees.alias("agrees"))


@query(
    "v20d_metric_support",
    f"""WITH {SURVIVAL}, f AS (SELECT *, id % 4 AS fold FROM survival), tau AS (SELECT cohort, quantile_cont(time, 0.8) AS tau FROM survival WHERE event = 1 GROUP BY 1)
    SELECT cohort, fold, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, count(*) FILTER (event = 1 AND time < tau) AS usable, count(*) FILTER (event = 1 AND time < tau) >= 3 AS supported FROM f JOIN tau USING (cohort) GROUP BY 1, 2""",
)
def metric_support(spark, d):
    """Whether each test fold has events enough, before the truncation time, to be scored at all."""
    x = stage(survival(spark, d), "support")
    f = x.withColumn("fold", F.col("id") % 4).join(_tau(x), "cohort")
    usable = F.count_if((F.col("event") == 1) & (F.col("time") < F.col("tau")))
    return f.groupBy("cohort", "fold").agg(F.count("*").alias("n"), F.sum("event").alias("events"), usable.alias("usable"), (usable >= 3).alias("supported"))


@query(
    "q14_regime_valley",
    f"""WITH {_SCENARIO}, {DESIGN}, g AS (SELECT CAST(substr(regime, 2, 1) AS INTEGER) AS r, avg(mean_delta) AS m, var_samp(mean_delta) / count(mean_delta) AS v FROM s JOIN design USING (scenario) WHERE model = 'click' GROUP BY 1)
    SELECT a.r AS regime, round(b.m - a.m, 4) AS rise, b.m - a.m - 1.96 * sqrt(a.v + b.v) > 0 AS clear FROM g a JOIN g b ON b.r = a.r + 1""",
)
def regime_valley(spark, d):
    """Each regime against the next: is the difference clear of zero?"""
    x = scenario_summary(spark, d).filter("model = 'click'").join(design(spark, d), "scenario")
    g = x.groupBy(F.substring("regime", 2, 1).cast("int").alias("r")).agg(F.avg("mean_delta").alias("m"), (F.var_samp("mean_delta") / F.count("mean_delta")).alias("v"), F.lit(0).alias("all"))
    w = Window.partitionBy("all").orderBy("r")
    g = g.withColumns({"m1": F.lead("m").over(w), "v1": F.lead("v").over(w), "r1": F.lead("r").over(w)}).filter("r1 = r + 1")
    rise = F.col("m1") - F.col("m")
    return g.select(F.col("r").alias("regime"), _r(rise, 4).alias("rise"), (rise - 1.96 * F.sqrt(F.col("v") + F.col("v1")) > 0).alias("clear"))


@query(
    "t11_bh_adjusted",
    f"""WITH {SELECTION}, p AS (SELECT nation, segment, (count(*) FILTER (selected = 1) + 0.5) / (count(*) + 1.0) AS p FROM selection GROUP BY 1, 2),
    r AS (SELECT *, p * count(*) OVER (PARTITION BY segment) / row_number() OVER (PARTITION BY segment ORDER BY p, nation) AS raw FROM p)
    SELECT nation, segment, round(least(1.0, min(raw) OVER (PARTITION BY segment ORDER BY p DESC, raw ROWS UNBOUNDED PRECEDING)), 5) AS q FROM r""",
)
def bh_adjusted(spark, d):
    p = selection(spark, d).groupBy("nation", "segment").agg(((F.count_if(F.col("selected") == 1) + 0.5) / (F.count("*") + 1.0)).alias("p"))
    return stats.bh_adjust(p, "p", ["segment"]).select("nation", "segment", _r("q", 5).alias("q"))


@query(
    "t14c_causal_correlation",
    f"""WITH {EXPRESSION}, e AS (SELECT gene, avg(value) FILTER (cohort = 'A') AS s, avg(value) FILTER (cohort = 'B') AS t FROM expression GROUP BY 1),
    m AS (SELECT *, CAST(gene // 16 AS INTEGER) AS module, gene % 3 = 0 AS causal FROM e)
    SELECT module, count(*) FILTER (causal) AS n, CASE WHEN count(*) FILTER (causal) >= 3 THEN round(corr(s, t) FILTER (causal), 4) END AS r FROM m GROUP BY 1""",
)
def causal_correlation(spark, d):
    """Source against target effects, on the causal genes of each module; null where these are too few or do not vary."""
    effect = lambda c: F.avg(F.when(F.col("cohort") == c, F.col("value")))
    e = expression(spark, d).groupBy("gene").agg(effect("A").alias("s"), effect("B").alias("t"))
    causal = e.filter("gene % 3 = 0").withColumn("module", F.floor(F.col("gene") / 16).cast("int"))
    return causal.groupBy("module").agg(F.count("*").alias("n"), _r(stats.pearson("s", "t"), 4).alias("r"))
