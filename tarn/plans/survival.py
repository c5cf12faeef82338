"""Survival queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..functions import scalars as S
from ..operators import moments
from ..operators import survival as V
from ..operators.fits import newton
from ..operators.relational import asof
from ..shared import stage
from .entities import SURVIVAL, survival
from .registry import query
from .resampling import key_sql

_r = lambda c, n=6: F.round(c, n)

#: A product-limit curve in SQL; e is the event code that counts.
_KM = """{name}_k AS (SELECT {g}, time AS t, count(*) AS k, count(*) FILTER (event = {e}) AS d FROM {src} GROUP BY ALL),
  {name}_n AS (SELECT *, sum(k) OVER (PARTITION BY {g} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM {name}_k),
  {name} AS (SELECT {g}, t, n, d, product(1 - d / n) OVER (PARTITION BY {g} ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {name}_n)"""


def km_sql(name: str, g: str, e: int = 1, src: str = "survival") -> str:
    return _KM.format(name=name, g=g, e=e, src=src)


@query("v1_kaplan_meier", f"WITH {SURVIVAL}, {km_sql('km', 'cohort')} SELECT cohort, t, CAST(n AS BIGINT) AS n, d, round(s, 6) AS s FROM km")
def kaplan_meier(spark, d):
    return V.kaplan_meier(survival(spark, d), ["cohort"]).withColumn("s", _r("s"))


_HORIZONS = "h AS (SELECT DISTINCT cohort, h.h AS t FROM survival, (SELECT unnest([200.0::DOUBLE, 400.0, 800.0]) AS h) h)"


@query(
    "v1b_survival_at_horizons",
    f"WITH {SURVIVAL}, {km_sql('km', 'cohort')}, {_HORIZONS} SELECT h.cohort, h.t, round(least(1 - 1e-8, greatest(1e-8, coalesce(km.s, 1.0))), 6) AS s FROM h ASOF LEFT JOIN km ON h.cohort = km.cohort AND h.t >= km.t",
)
def survival_at(spark, d):
    km = stage(V.kaplan_meier(survival(spark, d), ["cohort"]), "km")
    h = km.select("cohort").distinct().withColumn("t", F.explode(F.array(*map(F.lit, (200.0, 400.0, 800.0)))))
    return asof(h, km, ["cohort"], "t", "t", "s", "s").select("cohort", "t", _r(S.clip("s", 1e-8, 1 - 1e-8)).alias("s"))


@query("v3_reverse_median", f"WITH {SURVIVAL}, {km_sql('km', 'arm', 0)} SELECT arm, min(t) FILTER (s <= 0.5) AS median FROM km GROUP BY 1")
def reverse_median(spark, d):
    return V.median_time(V.kaplan_meier(survival(spark, d), ["arm"], flip=True), ["arm"])


@query("v4_censoring_curve", f"WITH {SURVIVAL}, {km_sql('g', 'cohort', 0, '(SELECT * FROM survival WHERE id % 5 <> 0)')} SELECT cohort, t, round(s, 6) AS g FROM g")
def censoring_curve(spark, d):
    """Of the training rows alone."""
    return V.kaplan_meier(survival(spark, d).filter("id % 5 <> 0"), ["cohort"], flip=True).select("cohort", "t", _r("s").alias("g"))


@query("v5_truncation_times", f"WITH {SURVIVAL} SELECT cohort, round(quantile_cont(time, 0.8) FILTER (event = 1), 4) AS tau_events, round(least(quantile_cont(time, 0.9), max(time) FILTER (event = 1)), 4) AS tau_all FROM survival GROUP BY 1")
def truncation_times(spark, d):
    """Two definitions: a quantile of event times, and one of all times that events still support."""
    e = F.when(F.col("event") == 1, F.col("time"))
    return survival(spark, d).groupBy("cohort").agg(_r(F.percentile(e, 0.8), 4).alias("tau_events"), _r(F.least(F.percentile("time", 0.9), F.max(e)), 4).alias("tau_all"))


def _tau(x, by="cohort"):
    return x.groupBy(by).agg(F.percentile(F.when(F.col("event") == 1, F.col("time")), 0.8).alias("tau"))


_UNO = f"""{SURVIVAL}, {km_sql('g', 'cohort', 0)}, x AS (SELECT s.*, coalesce(g.s, 1.0) AS g FROM survival s ASOF LEFT JOIN g ON s.cohort = g.cohort AND s.time > g.t),
  tau AS (SELECT cohort, quantile_cont(time, 0.8) AS tau FROM survival WHERE event = 1 GROUP BY 1),
  c AS (SELECT a.cohort, sum(1 / (a.g * a.g) * CASE WHEN a.risk {{op}} b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END) / sum(1 / (a.g * a.g)) AS c
  FROM x a JOIN tau USING (cohort) JOIN x b ON a.cohort = b.cohort AND b.time > a.time WHERE a.event = 1 AND a.time < tau GROUP BY 1)"""


@query("v6_uno_concordance", f"WITH {_UNO.format(op='>')} SELECT cohort, round(c, 4) AS c FROM c")
def uno_concordance(spark, d):
    x = stage(survival(spark, d), "uno")
    return V.uno_fast(x, "cohort", _tau(x)).filter("c IS NOT NULL").select("cohort", _r("c", 4).alias("c"))


@query("v6b_uno_by_pairs", f"WITH {_UNO.format(op='>')} SELECT cohort, round(c, 4) AS c FROM c")
def uno_by_pairs(spark, d):
    """The same from the pairs of blocks of subjects."""
    x = stage(survival(spark, d), "uno")
    return V.uno_pairs(x, ["cohort"], _tau(x)).select("cohort", _r("c", 4).alias("c"))


_BRESLOW = """{name}_k AS (SELECT {g}, time AS t, sum(exp(greatest(-30, least(30, risk)))) AS w, sum(event) AS d FROM {src} GROUP BY ALL),
  {name}_j AS (SELECT *, d / sum(w) OVER (PARTITION BY {g} ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS j FROM {name}_k),
  {name} AS (SELECT {g}, t, sum(j) OVER (PARTITION BY {g} ORDER BY t ROWS UNBOUNDED PRECEDING) AS h FROM {name}_j)"""


def breslow_sql(name: str, g: str, src: str = "survival") -> str:
    return _BRESLOW.format(name=name, g=g, src=src)


@query("v7_breslow_hazard", f"WITH {SURVIVAL}, {breslow_sql('bh', 'cohort')} SELECT cohort, t, round(h, 6) AS h FROM bh")
def breslow_hazard(spark, d):
    return V.breslow(survival(spark, d), ["cohort"]).withColumn("h", _r("h"))


@query("v8_cox_survival", f"WITH {SURVIVAL}, {breslow_sql('bh', 'cohort')} SELECT s.id, round(exp(-exp(s.risk) * coalesce(bh.h, 0.0)), 6) AS p FROM survival s ASOF LEFT JOIN bh ON s.cohort = bh.cohort AND 500.0 + 0 * s.id >= bh.t")
def cox_survival(spark, d):
    """Each subject's predicted survival at 500 days."""
    x = stage(survival(spark, d), "cox")
    h = V.breslow(x, ["cohort"]).filter("t <= 500").groupBy("cohort").agg(F.max_by("h", "t").alias("h"))
    return x.join(h, "cohort", "left").select("id", _r(F.exp(-F.exp("risk") * F.coalesce("h", F.lit(0.0)))).alias("p"))


_BRIER = f"""{SURVIVAL}, {km_sql('g', 'cohort', 0)}, x AS (SELECT s.*, coalesce(g.s, 1.0) AS g FROM survival s ASOF LEFT JOIN g ON s.cohort = g.cohort AND s.time > g.t),
  lim AS (SELECT cohort, quantile_cont(time, 0.1) AS lo, quantile_cont(time, 0.8) AS hi FROM survival GROUP BY 1),
  grid AS (SELECT cohort, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 9.0 AS t FROM lim, (SELECT unnest(range(0, 10)) AS i)),
  pt AS (SELECT grid.*, coalesce(g.s, 1.0) AS gt FROM grid ASOF LEFT JOIN g ON grid.cohort = g.cohort AND grid.t >= g.t),
  loss AS (SELECT pt.cohort, pt.i, pt.t, CASE WHEN x.time <= pt.t AND x.event = 1 THEN power(exp(-exp(x.risk) * pt.t / 1000), 2) / nullif(x.g, 0)
    WHEN x.time > pt.t THEN power(1 - exp(-exp(x.risk) * pt.t / 1000), 2) / nullif(pt.gt, 0) ELSE 0 END AS l FROM pt JOIN x ON x.cohort = pt.cohort),
  bs AS (SELECT cohort, i, t, avg(l) AS bs FROM loss GROUP BY 1, 2, 3)"""


def _brier(spark, d):
    x = stage(survival(spark, d), "brier")
    grid = x.groupBy("cohort").agg(S.grid(F.percentile("time", 0.1), F.percentile("time", 0.8), 10).alias("ts"))
    return V.brier(x, ["cohort"], grid, F.exp(-F.exp("risk") * F.col("t") / 1000))


@query("v9_ipcw_brier", f"WITH {_BRIER} SELECT cohort, i, round(bs, 4) AS bs FROM bs")
def ipcw_brier(spark, d):
    return _brier(spark, d).select("cohort", "i", _r("bs", 4).alias("bs"))


@query("v10_integrated_brier", f"WITH {_BRIER}, l AS (SELECT *, lag(bs) OVER (PARTITION BY cohort ORDER BY t) AS b0, lag(t) OVER (PARTITION BY cohort ORDER BY t) AS t0 FROM bs) SELECT cohort, round(sum((bs + b0) / 2 * (t - t0)) / (max(t) - min(t)), 4) AS ibs FROM l GROUP BY 1")
def integrated_brier(spark, d):
    return V.integrate(_brier(spark, d), ["cohort"], "t", "bs", "ibs").withColumn("ibs", _r("ibs", 4))


@query(
    "v11_supported_grid",
    f"WITH {SURVIVAL}, g AS (SELECT cohort, min(time) FILTER (event = 1) AS lo, max(time) FILTER (event = 1) AS hi FROM survival GROUP BY 1), p AS (SELECT cohort, lo + (hi - lo) * i / 19.0 AS t, lo, hi FROM g, (SELECT unnest(range(0, 20)) AS i)) SELECT cohort, count(*) AS n_points, round(min(t), 4) AS first, round(max(t), 4) AS last FROM p WHERE t > lo AND t < hi GROUP BY 1 HAVING count(*) >= 5",
)
def supported_grid(spark, d):
    """Grid points strictly inside the event times; at least five, else no grid."""
    e = F.when(F.col("event") == 1, F.col("time"))
    g = survival(spark, d).groupBy("cohort").agg(F.min(e).alias("lo"), F.max(e).alias("hi"))
    p = g.withColumn("t", F.explode(S.grid(F.col("lo"), F.col("hi"), 20))).filter("t > lo AND t < hi")
    return p.groupBy("cohort").agg(F.count("*").alias("n_points"), _r(F.min("t"), 4).alias("first"), _r(F.max("t"), 4).alias("last")).filter("n_points >= 5")


@query("v12_calibration_slope")
def calibration_slope(spark, d):
    """The slope of a Cox model on the risk alone; null without events or spread, or if it does not settle within 20."""
    x = stage(survival(spark, d).select("cohort", "time", "event", "risk"), "slope")
    usable = x.groupBy("cohort").agg(((F.sum("event") >= 1) & (F.stddev_pop("risk") >= 1e-12)).alias("usable"))
    fits = newton(x, "cohort", ["risk"], lambda _: 0.0, cap=20.0)
    slopes = [(g, round(float(b[0]), 5) if fine and abs(b[0]) < 20 else None) for g, (b, fine) in fits.items()]
    found = spark.createDataFrame(slopes, "cohort string, slope double")
    return usable.join(found, "cohort", "left").select("cohort", F.when(F.col("usable"), F.col("slope")).alias("slope"))


@query(
    "v13_calibration_in_the_large",
    f"""WITH {SURVIVAL}, {km_sql('km', 'cohort')}, {breslow_sql('bh', 'cohort')}, o AS (SELECT cohort, arg_max(s, t) AS s FROM km WHERE t <= 500 GROUP BY 1), h AS (SELECT cohort, arg_max(h, t) AS h FROM bh WHERE t <= 500 GROUP BY 1),
    p AS (SELECT cohort, avg(exp(-exp(risk) * h)) AS p FROM survival JOIN h USING (cohort) GROUP BY 1) SELECT cohort, round(ln(-ln(s)) - ln(-ln(p)), 4) AS intercept FROM o JOIN p USING (cohort) WHERE s > 0 AND s < 1 AND p > 0 AND p < 1""",
)
def calibration_in_the_large(spark, d):
    x = stage(survival(spark, d), "citl")
    o = V.kaplan_meier(x, ["cohort"]).filter("t <= 500").groupBy("cohort").agg(F.max_by("s", "t").alias("s"))
    h = V.breslow(x, ["cohort"]).filter("t <= 500").groupBy("cohort").agg(F.max_by("h", "t").alias("h"))
    p = x.join(h, "cohort").groupBy("cohort").agg(F.avg(F.exp(-F.exp("risk") * F.col("h"))).alias("p"))
    loglog = lambda c: F.ln(-F.ln(c))
    both = o.join(p, "cohort").filter("s > 0 AND s < 1 AND p > 0 AND p < 1")
    return both.select("cohort", _r(loglog("s") - loglog("p"), 4).alias("intercept"))


@query("v14_partial_likelihood", f"WITH {SURVIVAL}, l AS (SELECT cohort, event, risk - ln(sum(exp(risk)) OVER (PARTITION BY cohort ORDER BY time DESC, id ROWS UNBOUNDED PRECEDING)) AS l FROM survival) SELECT cohort, round(-avg(l) FILTER (event = 1), 5) AS nll FROM l GROUP BY 1")
def partial_likelihood(spark, d):
    w = Window.partitionBy("cohort").orderBy(F.col("time").desc(), "id").rowsBetween(Window.unboundedPreceding, 0)
    x = survival(spark, d).withColumn("l", F.col("risk") - F.ln(F.sum(F.exp("risk")).over(w)))
    return x.groupBy("cohort").agg(_r(-F.avg(F.when(F.col("event") == 1, F.col("l"))), 5).alias("nll"))


@query("v19_standardised_risk", f"WITH {SURVIVAL} SELECT id, round((risk - avg(risk) FILTER (id % 5 <> 0) OVER (PARTITION BY cohort)) / stddev_pop(risk) FILTER (id % 5 <> 0) OVER (PARTITION BY cohort), 4) AS z FROM survival")
def standardised_risk(spark, d):
    w, train = Window.partitionBy("cohort"), F.when(F.col("id") % 5 != 0, F.col("risk"))
    return survival(spark, d).select("id", _r((F.col("risk") - F.avg(train).over(w)) / F.stddev_pop(train).over(w), 4).alias("z"))


#: Subjects dealt into five folds anew in each of four repeats.
_FOLDS = f"""{SURVIVAL}, folds AS (SELECT s.*, repeat, CAST((id + id // 7 * repeat) % 5 AS INTEGER) AS fold FROM survival s, (SELECT unnest(range(0, 4)) AS repeat))"""


def _folds(spark, d):
    x = survival(spark, d).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return x.withColumn("fold", ((F.col("id") + F.floor(F.col("id") / 7) * F.col("repeat")) % 5).cast("int"))


_OOF = f"""{_FOLDS}, p AS (SELECT repeat, fold, cohort, count(*) AS n, avg(risk) AS m, stddev_pop(risk) AS sd FROM folds GROUP BY ALL),
  train AS (SELECT a.repeat, a.fold, a.cohort, sum(b.n) AS n, sum(b.n * b.m) / sum(b.n) AS m, sum(b.n * (b.sd * b.sd + b.m * b.m)) / sum(b.n) AS q
            FROM p a JOIN p b ON a.repeat = b.repeat AND a.cohort = b.cohort AND a.fold <> b.fold GROUP BY ALL),
  oof AS (SELECT f.id, f.repeat, (f.risk - t.m) / sqrt(t.q - t.m * t.m) AS z FROM folds f JOIN train t USING (repeat, fold, cohort) WHERE t.q - t.m * t.m > 1e-9)"""


@query("v20_out_of_fold_mean", f"WITH {_OOF} SELECT id AS sample, round(avg(z), 4) AS risk, count(*) AS n FROM oof GROUP BY 1")
def out_of_fold_mean(spark, d):
    """Each subject's risk, standardised in every repeat by the folds it is not in, and averaged over the repeats."""
    x = stage(_folds(spark, d).select("id", "cohort", "risk", "repeat", "fold"), "oof")
    r = F.col("risk")
    own = x.groupBy("repeat", "cohort", "fold").agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    # A fold's training rows are all rows but its own, so their moments are differences.
    every = Window.partitionBy("repeat", "cohort")
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("n", "s", "q")}
    train = own.select("repeat", "cohort", "fold", *(v.alias(c) for c, v in rest.items())).filter("n > 0")
    train = train.select("repeat", "cohort", "fold", (F.col("s") / F.col("n")).alias("m"), (F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("v")).filter("v > 1e-9")
    z = x.join(train, ["repeat", "cohort", "fold"]).select("id", ((r - F.col("m")) / F.sqrt("v")).alias("z"))
    return z.groupBy(F.col("id").alias("sample")).agg(_r(F.avg("z"), 4).alias("risk"), F.count("*").alias("n"))


@query("v20c_outcome_from_pairs", "SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 WHEN 'P' THEN 0 END AS event FROM orders")
def outcome_from_pairs(spark, d):
    """``key: value`` texts as columns, and the status by a closed map."""
    from .entities import table

    raw = table(spark, d, "orders").select("o_orderkey", F.array(F.concat(F.lit("status: "), "o_orderstatus"), F.concat(F.lit("priority: "), "o_orderpriority")).alias("pairs"))
    as_map = F.map_from_entries(F.transform("pairs", lambda p: F.struct(F.trim(F.split(p, ":", 2)[0]), F.trim(F.split(p, ":", 2)[1]))))
    m = raw.select("o_orderkey", as_map.alias("m"))
    status = F.col("m")["status"]
    return m.select("o_orderkey", status.alias("status"), F.col("m")["priority"].alias("priority"), F.when(status == "F", 1).when(status.isin("O", "P"), 0).alias("event"))


_FOLD_SCORES = f"""{SURVIVAL}, f AS (SELECT arm, id, time, event, risk, CAST(id % 5 AS INTEGER) AS fold FROM survival),
  tr AS (SELECT k.fold AS test, f.arm, f.time, f.event, f.risk FROM f, (SELECT unnest(range(0, 5)) AS fold) k WHERE f.fold <> k.fold),
  bk AS (SELECT test, arm, time AS t, sum(exp(risk)) AS w, sum(event) AS d FROM tr GROUP BY ALL),
  bj AS (SELECT *, d / sum(w) OVER (PARTITION BY test, arm ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS j FROM bk),
  h AS (SELECT test, arm, sum(j) FILTER (t <= 60) AS h FROM bj GROUP BY ALL),
  gk AS (SELECT test, arm, time AS t, count(*) AS k, count(*) FILTER (event = 0) AS d FROM tr GROUP BY ALL),
  gn AS (SELECT *, sum(k) OVER (PARTITION BY test, arm ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM gk),
  g AS (SELECT test, arm, t, product(1 - d / n) OVER (PARTITION BY test, arm ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM gn),
  x AS (SELECT f.*, coalesce(g.s, 1.0) AS g FROM f ASOF LEFT JOIN g ON g.test = f.fold AND g.arm = f.arm AND f.time > g.t),
  at60 AS (SELECT test, arm, arg_max(s, t) AS g60 FROM g WHERE t <= 60 GROUP BY ALL),
  b AS (SELECT x.fold, x.arm, avg(CASE WHEN time <= 60 AND event = 1 THEN power(exp(-exp(risk) * coalesce(h, 0)), 2) / nullif(x.g, 0)
    WHEN time > 60 THEN power(1 - exp(-exp(risk) * coalesce(h, 0)), 2) / nullif(coalesce(g60, 1.0), 0) ELSE 0 END) AS brier, stddev_pop(risk) AS risk_sd
    FROM x LEFT JOIN h ON h.test = x.fold AND h.arm = x.arm LEFT JOIN at60 ON at60.test = x.fold AND at60.arm = x.arm GROUP BY ALL),
  c AS (SELECT a.fold, a.arm, sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*) AS c
    FROM f a JOIN f b ON a.fold = b.fold AND a.arm = b.arm AND b.time > a.time WHERE a.event = 1 GROUP BY ALL)"""


@query("v20e_fold_metrics", f"WITH {_FOLD_SCORES} SELECT fold, arm, round(c, 4) AS c, round(brier, 4) AS brier, round(risk_sd, 4) AS risk_sd FROM b LEFT JOIN c USING (fold, arm)")
def fold_metrics(spark, d):
    """Test folds scored fold by fold: the baseline hazard and the censoring curve come from the other folds' rows alone."""
    x = stage(survival(spark, d).select("arm", "id", "time", "event", "risk", (F.col("id") % 5).cast("int").alias("fold")), "folds")
    by = ["fold", "arm"]
    folds = F.array(*map(F.lit, range(5)))
    train = x.withColumnRenamed("fold", "own").withColumn("fold", F.explode(folds)).filter("fold <> own")
    h = V.breslow(train, by).filter("t <= 60").groupBy(*by).agg(F.max_by("h", "t").alias("h"))
    g = stage(V.kaplan_meier(train, by, flip=True), "censoring")
    g60 = g.filter("t <= 60").groupBy(*by).agg(F.max_by("s", "t").alias("g60"))
    y = V.with_curve(x, g, by, "g").join(h, by, "left").join(g60, by, "left")
    s = F.exp(-F.exp("risk") * F.coalesce("h", F.lit(0.0)))
    late = F.try_divide((1 - s) * (1 - s), F.coalesce("g60", F.lit(1.0)))
    loss = F.when((F.col("time") <= 60) & (F.col("event") == 1), F.try_divide(s * s, F.col("g"))).when(F.col("time") > 60, late).otherwise(0.0)
    scores = y.groupBy(*by).agg(_r(F.avg(loss), 4).alias("brier"), _r(F.stddev_pop("risk"), 4).alias("risk_sd"))
    c = V.uno_fast(x.withColumn("grp", F.concat_ws("#", "fold", "arm")), "grp").select(F.split("grp", "#")[0].cast("int").alias("fold"), F.split("grp", "#")[1].alias("arm"), _r("c", 4).alias("c"))
    return scores.join(c, by, "left").select(*by, "c", "brier", "risk_sd")


@query(
    "v21_km_null_reference",
    f"""WITH {SURVIVAL}, {km_sql('km', 'cohort', 1, '(SELECT * FROM survival WHERE id % 5 <> 0)')}, {km_sql('g', 'cohort', 0, '(SELECT * FROM survival WHERE id % 5 <> 0)')},
    x AS (SELECT s.*, coalesce(g.s, 1.0) AS g FROM (SELECT * FROM survival WHERE id % 5 = 0) s ASOF LEFT JOIN g ON s.cohort = g.cohort AND s.time > g.t),
    q AS (SELECT DISTINCT cohort, 500.0::DOUBLE AS t FROM x), st AS (SELECT q.cohort, q.t, coalesce(km.s, 1.0) AS st FROM q ASOF LEFT JOIN km ON q.cohort = km.cohort AND q.t >= km.t),
    gt AS (SELECT q.cohort, coalesce(g.s, 1.0) AS gt FROM q ASOF LEFT JOIN g ON q.cohort = g.cohort AND q.t >= g.t)
    SELECT cohort, count(*) AS n_test, round(avg(CASE WHEN time <= 500 AND event = 1 THEN st * st / nullif(x.g, 0) WHEN time > 500 THEN (1 - st) * (1 - st) / nullif(gt, 0) ELSE 0 END), 4) AS bs FROM x JOIN st USING (cohort) JOIN gt USING (cohort) GROUP BY 1""",
)
def km_null_reference(spark, d):
    """The Brier score at 500 days that the training rows' own curve gets on the test rows."""
    x = stage(survival(spark, d), "null")
    train, test = x.filter("id % 5 <> 0"), x.filter("id % 5 = 0")
    km, g = V.kaplan_meier(train, ["cohort"]), stage(V.kaplan_meier(train, ["cohort"], flip=True), "null")
    at = km.filter("t <= 500").groupBy("cohort").agg(F.max_by("s", "t").alias("st"))
    gt = g.filter("t <= 500").groupBy("cohort").agg(F.max_by("s", "t").alias("gt"))
    y = V.with_curve(test, g, ["cohort"], "g").join(at, "cohort", "left").join(gt, "cohort", "left")
    st, after = F.coalesce("st", F.lit(1.0)), F.coalesce("gt", F.lit(1.0))
    loss = F.when((F.col("time") <= 500) & (F.col("event") == 1), F.try_divide(st * st, F.col("g"))).when(F.col("time") > 500, F.try_divide((1 - st) * (1 - st), after)).otherwise(0.0)
    return y.groupBy("cohort").agg(F.count("*").alias("n_test"), _r(F.avg(loss), 4).alias("bs"))


REPEATS, FOLDS, GRID = 3, 5, 11

_REPEATED = f"""{SURVIVAL}, f AS (SELECT arm, r, id, time, event, {key_sql("'null'", 'r', 'id')} % {FOLDS} AS fold FROM survival, (SELECT unnest(range(0, {REPEATS})) AS r)),
  tr AS (SELECT k.fold, f.arm, f.r, f.time, f.event FROM f, (SELECT unnest(range(0, {FOLDS})) AS fold) k WHERE f.fold <> k.fold),
  k AS (SELECT arm, r, fold, time AS t, count(*) AS k, count(*) FILTER (event = 1) AS d FROM tr GROUP BY ALL),
  n AS (SELECT *, sum(k) OVER (PARTITION BY arm, r, fold ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM k),
  c AS (SELECT arm, r, fold, t, product(1 - d / n) OVER w AS s, product(1 - (k - d) / n) OVER w AS g FROM n WINDOW w AS (PARTITION BY arm, r, fold ORDER BY t ROWS UNBOUNDED PRECEDING)),
  x AS (SELECT f.*, coalesce(c.g, 1.0) AS g FROM f ASOF LEFT JOIN c ON c.arm = f.arm AND c.r = f.r AND c.fold = f.fold AND f.time > c.t),
  lim AS (SELECT arm, quantile_cont(time, 0.1) AS lo, quantile_cont(time, 0.8) AS hi FROM survival GROUP BY 1),
  p AS (SELECT arm, r, fold, i, lo + (hi - lo) * i / {GRID - 1}.0 AS t FROM lim, (SELECT unnest(range(0, {GRID})) AS i), (SELECT DISTINCT r, fold FROM f)),
  q AS (SELECT p.*, coalesce(c.s, 1.0) AS s, coalesce(c.g, 1.0) AS g FROM p ASOF LEFT JOIN c ON c.arm = p.arm AND c.r = p.r AND c.fold = p.fold AND p.t >= c.t),
  b AS (SELECT q.arm, q.r, q.fold, q.i, q.t, count(*) AS n, avg(CASE WHEN x.time <= q.t AND x.event = 1 THEN q.s * q.s / x.g WHEN x.time > q.t THEN (1 - q.s) * (1 - q.s) / q.g ELSE 0 END) AS bs
    FROM q JOIN x ON x.arm = q.arm AND x.r = q.r AND x.fold = q.fold GROUP BY ALL),
  l AS (SELECT *, lag(bs) OVER w AS b0, lag(t) OVER w AS t0 FROM b WINDOW w AS (PARTITION BY arm, r, fold ORDER BY i)),
  s AS (SELECT arm, r, fold, any_value(n) AS n, sum((bs + b0) / 2 * (t - t0)) / (max(t) - min(t)) AS ibs FROM l GROUP BY ALL)"""


@query("v21b_repeated_km_null", f"WITH {_REPEATED} SELECT arm, count(*) AS folds, CAST(sum(n) AS BIGINT) AS tested, round(sum(n * ibs) / sum(n), 6) AS weighted_mean, round(median(ibs), 6) AS median FROM s GROUP BY 1")
def repeated_km_null(spark, d):
    """The integrated Brier score of the training rows' own curve, over repeated folds: mean by tested rows, and median.

    Everything is a count by arm, repeat, fold and time: training rows are all rows but the fold's, and a fold's loss at a
    time is two sums over its own counts. No row is copied per fold.
    """
    x = survival(spark, d).select("arm", "id", "time", "event").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    x = x.withColumn("fold", F.pmod(S.draw_key(F.lit("null"), "r", "id"), F.lit(FOLDS)).cast("int"))
    own = stage(x.groupBy("arm", "r", "fold", F.col("time").alias("t")).agg(F.count("*").alias("tk"), F.count_if(F.col("event") == 1).alias("td")), "fold_counts")
    every = own.groupBy("arm", "r", "t").agg(F.sum("tk").alias("k"), F.sum("td").alias("d")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    c = every.join(own, ["arm", "r", "fold", "t"], "left").fillna(0, ["tk", "td"]).withColumns({"k": F.col("k") - F.col("tk"), "d": F.col("d") - F.col("td")})
    by = ["arm", "r", "fold"]
    up, down = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by).orderBy(F.col("t").desc())
    run = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("n", F.sum("k").over(run(down))).withColumns({"s": F.product(F.coalesce(1 - F.try_divide("d", "n"), F.lit(1.0))).over(run(up)), "g": F.product(F.coalesce(1 - F.try_divide(F.col("k") - F.col("d"), F.col("n")), F.lit(1.0))).over(run(up))})
    c = c.withColumn("before", F.coalesce(F.lag("g").over(up), F.lit(1.0)))
    c = c.withColumns({"hit": F.sum(F.try_divide("td", "before")).over(run(up)), "gone": F.sum("tk").over(run(up))})
    lim = own.filter("r = 0").groupBy("arm").agg(F.percentile("t", 0.1, F.col("tk")).alias("lo"), F.percentile("t", 0.8, F.col("tk")).alias("hi"))
    c = c.join(lim, "arm")  # a row per arm
    at = [F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(GRID - 1) for i in range(GRID)]
    last = [F.max_by(F.struct("s", "g", "hit", "gone"), F.when(F.col("t") <= t, F.col("t"))) for t in at]
    z = c.groupBy(*by, "lo", "hi").agg(F.sum("tk").alias("tested"), *(v.alias(f"p{i}") for i, v in enumerate(last))).filter("tested > 0")

    def loss(i: int):
        p, one = F.col(f"p{i}"), F.lit(1.0)
        s, g, hit, gone = F.coalesce(p["s"], one), F.coalesce(p["g"], one), F.coalesce(p["hit"], F.lit(0.0)), F.coalesce(p["gone"], F.lit(0))
        return (s * s * hit + (1 - s) * (1 - s) * F.coalesce(F.try_divide(F.col("tested") - gone, g), F.lit(0.0))) / F.col("tested")

    ibs = sum((loss(i) + loss(i + 1)) / 2 for i in range(GRID - 1)) / float(GRID - 1)
    z = z.select("arm", "tested", ibs.alias("ibs"))
    return z.groupBy("arm").agg(F.count("*").alias("folds"), F.sum("tested").alias("tested"), _r(F.sum(F.col("tested") * F.col("ibs")) / F.sum("tested")).alias("weighted_mean"), _r(F.median("ibs")).alias("median"))


@query("v22_follow_up_summary", f"WITH {SURVIVAL}, {km_sql('km', 'arm', 0)}, m AS (SELECT arm, min(t) FILTER (s <= 0.5) AS reverse_median FROM km GROUP BY 1) SELECT arm, count(*) AS n, CAST(sum(event) AS BIGINT) AS events, round(median(time), 4) AS median, round(quantile_cont(time, 0.25), 4) AS q25, any_value(reverse_median) AS reverse_median FROM survival JOIN m USING (arm) GROUP BY 1")
def follow_up_summary(spark, d):
    x = stage(survival(spark, d), "follow")
    m = V.median_time(V.kaplan_meier(x, ["arm"], flip=True), ["arm"]).withColumnRenamed("median", "reverse_median")
    s = x.groupBy("arm").agg(F.count("*").alias("n"), F.sum("event").alias("events"), _r(F.median("time"), 4).alias("median"), _r(F.percentile("time", 0.25), 4).alias("q25"))
    return s.join(m, "arm")


@query("v23_coral_alignment")
def coral_alignment(spark, d):
    """A unit score's coefficients carried between two cohorts' covariances; these are summed up on the executors."""
    from .entities import table

    e = table(spark, d, "embeddings").select(F.when(F.col("label") < 5, "A").otherwise("B").alias("cohort"), F.col("embedding").alias("x"))
    cov = {r["cohort"]: moments.covariance(r) for r in moments.moments(e, "cohort", "x").collect()}  # two rows
    beta = kernels.coral(np.ones(len(cov["A"])), cov["A"], cov["B"])
    return spark.createDataFrame([(i, round(float(b), 5)) for i, b in enumerate(beta)], "gene int, beta double")
