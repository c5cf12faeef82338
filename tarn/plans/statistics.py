"""Two-sample and descriptive statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions import scalars as S
from ..functions import stats
from ..operators import moments
from ..operators.fits import logistic_terms, newton
from ..shared import stage
from .entities import EXPRESSION, METRICS, SCORES, SELECTION, SURVIVAL, expression, metrics, scores, selection, survival, table
from .registry import query

_r = lambda c, n=6: F.round(c, n)
_CORR = "CASE WHEN count(*) >= {n} AND stddev_pop({x}) > 1e-12 AND stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query("t1_pearson", f"WITH {SURVIVAL} SELECT cohort, round({_CORR.format(n=3, x='time', y='x')}, 6) AS r FROM survival GROUP BY 1")
def pearson(spark, d):
    return survival(spark, d).groupBy("cohort").agg(_r(stats.pearson("time", "x")).alias("r"))


_RANKED = f"{SURVIVAL}, r AS (SELECT cohort, rank() OVER (PARTITION BY cohort ORDER BY time) + (count(*) OVER (PARTITION BY cohort, time) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY cohort ORDER BY x) + (count(*) OVER (PARTITION BY cohort, x) - 1) / 2.0 AS rx FROM survival)"


@query("t2_spearman", f"WITH {_RANKED} SELECT cohort, round({_CORR.format(n=5, x='rt', y='rx')}, 6) AS rho FROM r GROUP BY 1")
def spearman(spark, d):
    x = survival(spark, d).filter(S.is_finite("time") & S.is_finite("x"))
    x = stats.average_rank(stats.average_rank(x, "time", ["cohort"], "rt"), "x", ["cohort"], "rx")
    return x.groupBy("cohort").agg(_r(stats.pearson("rt", "rx", 5)).alias("rho"))


@query(
    "t3_smd_numeric",
    f"""WITH {SELECTION}, s AS (SELECT segment, avg(balance) FILTER (selected = 1) AS m1, avg(balance) FILTER (selected = 0) AS m0, sqrt((var_samp(balance) FILTER (selected = 1) + var_samp(balance) FILTER (selected = 0)) / 2) AS sd FROM selection GROUP BY 1)
    SELECT segment, round(CASE WHEN sd > 0 THEN (m1 - m0) / sd WHEN m1 = m0 THEN 0.0 END, 6) AS smd FROM s""",
)
def smd_numeric(spark, d):
    return selection(spark, d).groupBy("segment").agg(_r(stats.smd("balance", "selected")).alias("smd"))


_SHARES = f"{SELECTION}, p AS (SELECT nation, segment, count(*) FILTER (selected = 1) / nullif(sum(count(*) FILTER (selected = 1)) OVER (PARTITION BY nation), 0) AS p1, count(*) FILTER (selected = 0) / nullif(sum(count(*) FILTER (selected = 0)) OVER (PARTITION BY nation), 0) AS p0 FROM selection GROUP BY 1, 2)"


@query("t4_categorical_distance", f"WITH {_SHARES} SELECT nation, round(max(abs(p1 - p0)), 6) AS max_diff, round(0.5 * sum(abs(p1 - p0)), 6) AS total_variation FROM p GROUP BY 1")
def categorical_distance(spark, d):
    n1, n0 = F.count_if(F.col("selected") == 1), F.count_if(F.col("selected") == 0)
    w = Window.partitionBy("nation")
    c = selection(spark, d).groupBy("nation", "segment").agg(n1.alias("n1"), n0.alias("n0"))
    gap = F.abs(F.try_divide("n1", F.sum("n1").over(w)) - F.try_divide("n0", F.sum("n0").over(w)))
    return c.withColumn("gap", gap).groupBy("nation").agg(_r(F.max("gap")).alias("max_diff"), _r(0.5 * F.sum("gap")).alias("total_variation"))


@query("t5_missing_fraction", f"WITH {SELECTION} SELECT selected, round(avg(CASE WHEN balance < 0 THEN 1.0 ELSE 0.0 END), 6) AS missing FROM selection GROUP BY 1")
def missing_fraction(spark, d):
    """Negative balances stand for missing ones here."""
    known = F.when(F.col("balance") >= 0, F.col("balance"))
    return selection(spark, d).groupBy("selected").agg(_r(F.avg(known.isNull().cast("double"))).alias("missing"))


_WELCH = f"""{SELECTION}, g AS (SELECT segment, avg(balance) FILTER (selected = 1) - avg(balance) FILTER (selected = 0) AS diff, var_samp(balance) FILTER (selected = 1) / count(*) FILTER (selected = 1) AS a,
  var_samp(balance) FILTER (selected = 0) / count(*) FILTER (selected = 0) AS b, count(*) FILTER (selected = 1) AS n1, count(*) FILTER (selected = 0) AS n0 FROM selection GROUP BY 1)"""


@query("t6_welch_t", f"WITH {_WELCH} SELECT segment, round(diff / sqrt(a + b), 6) AS t, round((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)), 4) AS df FROM g")
def welch_t(spark, d):
    t, df = stats.welch("balance", "selected")
    return selection(spark, d).groupBy("segment").agg(_r(t).alias("t"), _r(df, 4).alias("df"))


@F.pandas_udf(T.DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([kernels.t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype=float)


@query("t6b_welch_p")
def welch_p(spark, d):
    """One row per group reaches Python, for the p-value that Spark has no function for."""
    t, df = stats.welch("balance", "selected")
    g = selection(spark, d).groupBy("segment").agg(t.alias("t"), df.alias("df"))
    return g.select("segment", _r("t").alias("t"), _r(_t_p("t", "df"), 8).alias("p"))


@F.pandas_udf(T.DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
    return pd.Series([kernels.fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, e, strict=True)])


@query(
    "t7_fisher_exact",
    f"""WITH {SCORES}, g AS (SELECT lang, count(*) FILTER (y = 1 AND toxic = 1) AS a, count(*) FILTER (y = 1 AND toxic = 0) AS b, count(*) FILTER (y = 0 AND toxic = 1) AS c, count(*) FILTER (y = 0 AND toxic = 0) AS e FROM scores GROUP BY 1),
    m AS (SELECT *, a + b AS r, a + c AS k, a + b + c + e AS n, greatest(0, a - e) AS low FROM g),
    p AS (SELECT *, list_transform(range(low, least(r, k) + 1), lambda i: exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + lgamma(n - k + 1) - lgamma(r - i + 1) - lgamma(n - k - r + i + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1))) AS ps FROM m)
    SELECT lang, a, b, c, e, round(least(1.0, list_sum(list_filter(ps, lambda x: x <= ps[a - low + 1] + 1e-15))), 8) AS p FROM p""",
)
def fisher_exact(spark, d):
    n = lambda s, t: F.count_if((F.col("y") == s) & (F.col("toxic") == t))
    g = scores(spark, d).groupBy("lang").agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("e"))
    return g.select("lang", "a", "b", "c", "e", _r(_fisher("a", "b", "c", "e"), 8).alias("p"))


_TABLE = f"{SELECTION}, o AS (SELECT nation % 5 AS g, segment, selected, count(*) AS o FROM selection GROUP BY 1, 2, 3), e AS (SELECT *, sum(o) OVER (PARTITION BY g, segment) * sum(o) OVER (PARTITION BY g, selected) / sum(o) OVER (PARTITION BY g) AS e, sum(o) OVER (PARTITION BY g) AS n FROM o)"


def _chi2(spark, d):
    """Chi-square of segment by selection; absent cells add their expected counts."""
    o = selection(spark, d).groupBy((F.col("nation") % 5).alias("g"), "segment", "selected").agg(F.count("*").alias("o"))
    w = lambda *c: F.sum("o").over(Window.partitionBy(*c))
    e = o.withColumns({"e": w("g", "segment") * w("g", "selected") / w("g"), "n": w("g")})
    return e.groupBy("g").agg((F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")) + F.max("n") - F.sum("e")).alias("chi2"), F.max("n").alias("n"), F.count_distinct("segment").alias("r"), F.count_distinct("selected").alias("k"))


@query("t8_cramers_v", f"WITH {_TABLE}, c AS (SELECT g, sum((o - e) * (o - e) / e) + max(n) - sum(e) AS chi2, max(n) AS n, count(DISTINCT segment) AS r, count(DISTINCT selected) AS k FROM e GROUP BY 1) SELECT g, round(chi2, 4) AS chi2, round(sqrt(chi2 / (n * least(r - 1, k - 1))), 6) AS v FROM c")
def cramers_v(spark, d):
    return _chi2(spark, d).select("g", _r("chi2", 4).alias("chi2"), _r(F.sqrt(F.col("chi2") / (F.col("n") * F.least(F.col("r") - 1, F.col("k") - 1)))).alias("v"))


@F.pandas_udf(T.DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([kernels.chi2_tail(a, b) for a, b in zip(x, df, strict=True)], dtype=float)


@query("t8b_chi2_p")
def chi2_p(spark, d):
    c = _chi2(spark, d).withColumn("df", ((F.col("r") - 1) * (F.col("k") - 1)).cast("double"))
    return c.select("g", _r("chi2", 4).alias("chi2"), "df", _r(_chi2_p("chi2", "df"), 8).alias("p"))


@query(
    "t9_arm_effect",
    f"""WITH {SURVIVAL}, n AS (SELECT cohort, sum(event) FILTER (x > 250000) AS a, count(*) FILTER (x > 250000) AS na, sum(event) FILTER (x <= 250000) AS b, count(*) FILTER (x <= 250000) AS nb FROM survival GROUP BY 1)
    SELECT cohort, round((a / na) / nullif(b / nb, 0), 6) AS risk_ratio, round((a * (nb - b)) / nullif(b * (na - a), 0), 6) AS odds_ratio, round(a / na - b / nb, 6) AS difference FROM n""",
)
def arm_effect(spark, d):
    high = F.col("x") > 250000
    n = survival(spark, d).groupBy("cohort").agg(F.sum(F.when(high, F.col("event"))).alias("a"), F.count_if(high).alias("na"), F.sum(F.when(~high, F.col("event"))).alias("b"), F.count_if(~high).alias("nb"))
    a, na, b, nb = (F.col(c) for c in ("a", "na", "b", "nb"))
    return n.select("cohort", _r(F.try_divide(F.try_divide(a, na), F.try_divide(b, nb))).alias("risk_ratio"), _r(F.try_divide(a * (nb - b), b * (na - a))).alias("odds_ratio"), _r(F.try_divide(a, na) - F.try_divide(b, nb)).alias("difference"))


_COMPARE = "SELECT 'all' AS comparison, selected AS side, balance FROM selection UNION ALL SELECT 'building', selected, balance FROM selection WHERE segment = 'BUILDING' UNION ALL SELECT 'low_nations', selected, balance FROM selection WHERE nation < 12"


@query(
    "t10_baseline_balance",
    f"""WITH {SELECTION}, m AS ({_COMPARE}), s AS (SELECT comparison, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 0) AS n0, avg(balance) FILTER (side = 1) AS m1, avg(balance) FILTER (side = 0) AS m0,
    sqrt((var_samp(balance) FILTER (side = 1) + var_samp(balance) FILTER (side = 0)) / 2) AS sd FROM m GROUP BY 1) SELECT comparison, n1, n0, round((m1 - m0) / sd, 6) AS smd, CASE WHEN abs((m1 - m0) / sd) > 0.25 THEN 'imbalance' WHEN least(n1, n0) < 10 THEN 'few' ELSE 'ok' END AS warning FROM s""",
)
def baseline_balance(spark, d):
    """Several comparisons in one pass: each subject belongs to an array of them."""
    member = F.filter(F.array(F.lit("all"), F.when(F.col("segment") == "BUILDING", "building"), F.when(F.col("nation") < 12, "low_nations")), lambda x: x.isNotNull())
    m = selection(spark, d).withColumn("comparison", F.explode(member))
    s = m.groupBy("comparison").agg(F.count_if(F.col("selected") == 1).alias("n1"), F.count_if(F.col("selected") == 0).alias("n0"), stats.smd("balance", "selected").alias("smd"))
    warning = F.when(F.abs("smd") > 0.25, "imbalance").when(F.least("n1", "n0") < 10, "few").otherwise("ok")
    return s.select("comparison", "n1", "n0", _r("smd").alias("smd"), warning.alias("warning"))


@query("t12_gene_screen")
def gene_screen(spark, d):
    """Welch t, its p and adjusted p, and the standardised difference of two cohorts, gene by gene."""
    x = expression(spark, d).withColumn("side", (F.col("cohort") == "A").cast("int"))
    t, df = stats.welch("value", "side")
    g = x.groupBy("gene").agg(t.alias("t"), df.alias("df"), stats.smd("value", "side").alias("smd"), F.lit(0).alias("all"))
    g = stats.bh_adjust(g.withColumn("p", _t_p("t", "df")), "p", ["all"])
    strong = (F.col("q") <= 0.05) & (F.abs("smd") >= 0.5)
    return g.select("gene", _r("t").alias("t"), _r("p", 8).alias("p"), _r("q", 8).alias("q"), _r("smd").alias("smd"), strong.alias("strong"))


_PERMANOVA = f"{EXPRESSION}, s AS (SELECT *, avg(value) OVER (PARTITION BY gene) AS m, avg(value) OVER (PARTITION BY gene, cohort) AS mg FROM expression), q AS (SELECT sum((value - m) * (value - m)) AS total, sum((value - mg) * (value - mg)) AS within, count(DISTINCT sample) AS n FROM s)"


@query("t13_permanova", f"WITH {_PERMANOVA} SELECT round((total - within) / (within / (n - 2)), 4) AS pseudo_f, round((total - within) / total, 6) AS r2 FROM q")
def permanova(spark, d):
    """Sums of squares from group sums, so that no row meets another."""
    g = expression(spark, d).groupBy("gene", "cohort").agg(F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("ss"), F.count("*").alias("n"))
    within = F.col("ss") - F.col("s") ** 2 / F.col("n")
    by_gene = g.groupBy("gene").agg(F.sum(within).alias("within"), (F.sum("ss") - F.sum("s") ** 2 / F.sum("n")).alias("total"), F.sum("n").alias("n"))
    q = by_gene.agg(F.sum("within").alias("within"), F.sum("total").alias("total"), F.max("n").alias("n"))
    between = F.col("total") - F.col("within")
    return q.select(_r(between / (F.col("within") / (F.col("n") - 2)), 4).alias("pseudo_f"), _r(between / F.col("total")).alias("r2"))


_DRAW = "('0x' || substr(sha256('{seed}|' || {k}), 1, 8))::BIGINT"


@query(
    "t14_permutation_p",
    f"""WITH {SCORES}, x AS (SELECT lang, doc_id, y, score, draw FROM scores, (SELECT unnest(range(0, 51)) AS draw)),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang, draw ORDER BY doc_id) AS place, row_number() OVER (PARTITION BY lang, draw ORDER BY {_DRAW.format(seed='perm', k="draw || '|' || doc_id")}, doc_id) AS shuffled FROM x),
    s AS (SELECT a.lang, a.draw, abs(avg(b.score) FILTER (a.y = 1) - avg(b.score) FILTER (a.y = 0)) AS stat FROM o a JOIN o b ON a.lang = b.lang AND a.draw = b.draw AND a.place = CASE WHEN a.draw = 0 THEN b.place ELSE b.shuffled END GROUP BY 1, 2)
    SELECT lang, round((1 + count(*) FILTER (draw > 0 AND stat >= obs - 1e-9)) / 51.0, 6) AS p FROM (SELECT *, max(stat) FILTER (draw = 0) OVER (PARTITION BY lang) AS obs FROM s) GROUP BY 1""",
)
def permutation_p(spark, d):
    """Labels permuted by hash order within strata; draw 0 is the observed one."""
    x = scores(spark, d).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(50))))
    w = Window.partitionBy("lang", "draw")
    place = F.row_number().over(w.orderBy("doc_id"))
    shuffled = F.row_number().over(w.orderBy(S.draw_key(F.lit("perm"), "draw", "doc_id"), "doc_id"))
    o = x.withColumn("place", place).withColumn("to", F.when(F.col("draw") == 0, place).otherwise(shuffled))
    pairs = o.select("lang", "draw", F.col("place").alias("k"), "y").join(o.select("lang", "draw", F.col("to").alias("k"), "score"), ["lang", "draw", "k"])
    s = pairs.groupBy("lang", "draw").agg(F.abs(F.avg(F.when(F.col("y") == 1, F.col("score"))) - F.avg(F.when(F.col("y") == 0, F.col("score")))).alias("stat"))
    obs = F.max(F.when(F.col("draw") == 0, F.col("stat"))).over(Window.partitionBy("lang"))
    s = s.withColumn("obs", obs)
    return s.groupBy("lang").agg(_r((1 + F.count_if((F.col("draw") > 0) & (F.col("stat") >= F.col("obs") - 1e-9))) / 51.0).alias("p"))


_AUC = "(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0)"
_SCORED = f"{SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM scores)"


@query("t15_roc_auc", f"WITH {_SCORED} SELECT lang, round({_AUC}, 6) AS auc FROM r GROUP BY 1")
def roc_auc(spark, d):
    return stats.average_rank(scores(spark, d), "score", ["lang"], "r").groupBy("lang").agg(_r(stats.auc_from_ranks("y", "r")).alias("auc"))


@query("t16_balanced_accuracy", f"WITH {SCORES} SELECT lang, round((avg(CASE WHEN score > 1500 THEN 1.0 ELSE 0.0 END) FILTER (y = 1) + avg(CASE WHEN score > 1500 THEN 0.0 ELSE 1.0 END) FILTER (y = 0)) / 2, 6) AS balanced FROM scores GROUP BY 1")
def balanced_accuracy(spark, d):
    hit = (F.col("score") > 1500).cast("double")
    return scores(spark, d).groupBy("lang").agg(_r((F.avg(F.when(F.col("y") == 1, hit)) + F.avg(F.when(F.col("y") == 0, 1 - hit))) / 2).alias("balanced"))


_Z = f"{EXPRESSION}, p AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS sd FROM expression WHERE sample % 5 <> 0 GROUP BY 1), z AS (SELECT sample, gene, cohort, (value - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS z FROM expression JOIN p USING (gene))"


def _z(spark, d):
    """Every value standardised by its gene's training samples: a row of moments per gene, joined back."""
    x = expression(spark, d)
    p = x.filter("sample % 5 <> 0").groupBy("gene").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    scaled = (F.col("value") - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return x.join(p, "gene").select("sample", "gene", "cohort", scaled.alias("z"))


@query("t17_train_z", f"WITH {_Z} SELECT sample, gene, round(z, 4) AS z FROM z")
def train_z(spark, d):
    return _z(spark, d).select("sample", "gene", _r("z", 4).alias("z"))


@query("t18_module_score", f"WITH {_Z}, s AS (SELECT sample, CAST(gene // 16 AS INTEGER) AS module, avg(z) AS s FROM z GROUP BY 1, 2 HAVING count(*) >= 10) SELECT sample, module, round((s - avg(s) FILTER (sample % 5 <> 0) OVER (PARTITION BY module)) / stddev_pop(s) FILTER (sample % 5 <> 0) OVER (PARTITION BY module), 4) AS score FROM s")
def module_score(spark, d):
    """The mean of a set's standardised genes, standardised once more by the training samples."""
    s = _z(spark, d).groupBy("sample", F.floor(F.col("gene") / 16).cast("int").alias("module")).agg(F.avg("z").alias("s"), F.count("*").alias("n")).filter("n >= 10")
    s = stage(s, "modules")
    p = s.filter("sample % 5 <> 0").groupBy("module").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"))
    return s.join(p, "module").select("sample", "module", _r((F.col("s") - F.col("m")) / F.col("sd"), 4).alias("score"))


@query("t19_principal_components")
def principal_components(spark, d):
    """Two components for each label, each with its largest loading positive.

    Only a label's moments, summed up on the executors, are decomposed; vectors are then projected by
    array expressions, so no label's vectors are gathered.
    """
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    axes = moments.principal_axes(moments.moments(e, "label", "embedding"), "label", 2)
    centred = F.zip_with(F.col("embedding"), F.col("mean"), lambda x, m: x.cast("double") - m)
    both = e.join(axes, "label").select("vec_id", centred.alias("x"), "axis0", "axis1")
    return both.select("vec_id", _r(S.dot("x", "axis0"), 4).alias("pc1"), _r(S.dot("x", "axis1"), 4).alias("pc2"))


@query(
    "t20_residualised",
    f"WITH {SURVIVAL}, b AS (SELECT cohort, regr_slope(time, x) AS b, regr_intercept(time, x) AS a FROM survival WHERE id % 5 <> 0 GROUP BY 1) SELECT id, round(time - (a + b * x), 4) AS residual FROM survival JOIN b USING (cohort) WHERE b IS NOT NULL",
)
def residualised(spark, d):
    """What a line fitted to a cohort's training rows leaves of every row."""
    x = stage(survival(spark, d).select("cohort", "id", "time", "x"), "residual")
    line = x.filter("id % 5 <> 0").groupBy("cohort").agg(F.regr_slope("time", "x").alias("b"), F.regr_intercept("time", "x").alias("a")).filter("b IS NOT NULL")
    return x.join(line, "cohort").select("id", _r(F.col("time") - (F.col("a") + F.col("b") * F.col("x")), 4).alias("residual"))


@query("t21_l2_logistic")
def l2_logistic(spark, d):
    """A classifier for each language, from standardised length and toxicity; none where only one class is there."""
    x = stage(scores(spark, d).select("lang", "y", "score", "toxic"), "logistic")
    m = x.groupBy("lang").agg(*(f(c).alias(f"{k}_{c}") for c in ("score", "toxic") for k, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = [((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}")).otherwise(1.0)).alias(f"z_{c}") for c in ("score", "toxic")]
    rows = stage(x.join(F.broadcast(m), "lang").select("lang", "y", *z, F.lit(1.0).alias("one")), "logistic")  # a row of moments per language
    fits = newton(rows, "lang", ["z_score", "z_toxic", "one"], lambda _: np.array([1.0, 1.0, 1e-10]), terms=logistic_terms, cap=15.0)
    return spark.createDataFrame([(g, *(round(float(v), 6) for v in b)) for g, (b, fine) in fits.items() if fine], "lang string, b_score double, b_toxic double, intercept double")


@query("t22_control_percentile", f"WITH {METRICS}, o AS (SELECT model, avg(metric) AS obs FROM metrics WHERE scenario = 0 GROUP BY 1), c AS (SELECT model, scenario, avg(metric) AS m FROM metrics WHERE scenario > 0 GROUP BY 1, 2) SELECT model, round((1 + count(*) FILTER (m <= obs)) / (count(*) + 1.0), 6) AS percentile FROM c JOIN o USING (model) GROUP BY 1")
def control_percentile(spark, d):
    """Where one scenario lies among all others."""
    m = metrics(spark, d).groupBy("model", "scenario").agg(F.avg("metric").alias("m"))
    obs = F.max(F.when(F.col("scenario") == 0, F.col("m"))).over(Window.partitionBy("model"))
    c = m.withColumn("obs", obs).filter("scenario > 0 AND obs IS NOT NULL")
    return c.groupBy("model").agg(_r((1 + F.count_if(F.col("m") <= F.col("obs"))) / (F.count("*") + 1.0)).alias("percentile"))


@query("t23_dispersion", f"WITH {SURVIVAL} SELECT cohort, round(stddev_pop(risk), 6) AS sd, round(quantile_cont(risk, 0.99) - quantile_cont(risk, 0.01), 6) AS q99_q01, round(max(abs(risk)), 6) AS max_abs FROM survival GROUP BY 1")
def dispersion(spark, d):
    return survival(spark, d).groupBy("cohort").agg(_r(F.stddev_pop("risk")).alias("sd"), _r(F.percentile("risk", 0.99) - F.percentile("risk", 0.01)).alias("q99_q01"), _r(F.max(F.abs("risk"))).alias("max_abs"))
