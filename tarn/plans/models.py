"""Fitted models: ridge and elastic-net Cox by rounds of summed moments, nested tuning."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import draw_key
from ..operators import manyfits
from ..operators.concordance import concordance
from ..operators.fits import newton
from ..shared import drop, stage
from .entities import survival, table
from .registry import query

_FEATURES = ["x1", "x2", "x3"]


def _features(spark, d):
    """Subjects with a few standardised covariates of their orders."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_discount").alias("disc"), F.sum("l_quantity").alias("qty"))
    x = survival(spark, d).join(li, "id")
    x = x.select("cohort", "arm", "id", "time", "event", ((F.col("x") - 250000) / 150000).alias("x1"), ((F.col("disc") - 0.05) / 0.03).alias("x2"), ((F.col("qty") - 100) / 60).alias("x3"))
    return stage(x, "features")


def _coefficients(spark, fits):
    rows = [(g, fine, *(round(float(x), 5) for x in b)) for g, (b, fine) in fits.items()]
    return spark.createDataFrame(rows, "cohort string, converged boolean, b0 double, b1 double, b2 double")


@query("v15_centred_ridge_cox")
def centred_ridge(spark, d):
    """Coefficients shrunk towards a centre instead of zero."""
    return _coefficients(spark, newton(_features(spark, d), "cohort", _FEATURES, lambda _: 5.0, np.array([0.1, 0.0, 0.0])))


@query("v16_ridge_cox")
def ridge(spark, d):
    return _coefficients(spark, newton(_features(spark, d), "cohort", _FEATURES, lambda _: 1.0))


#: Penalties of a path, and mixes of absolute and squared penalties.
ALPHAS, RATIOS = tuple(float(a) for a in 0.2 * 0.01 ** (np.arange(30) / 29)), (0.1, 0.5, 1.0)


def _net(alpha: float, ratio: float, folds: frozenset[int] | None = None) -> manyfits.Fit:
    return manyfits.Fit(l2=alpha * (1 - ratio), l1=alpha * ratio, folds=folds, relative=True)


@query("v17_elastic_net_path")
def elastic_net_path(spark, d):
    """Non-zero coefficients along a path of 30 penalties, for three mixes: 90 fits of every arm at once."""
    blocks = manyfits.pack(_features(spark, d), "arm", _FEATURES)
    grid = [(r, i) for r in range(len(RATIOS)) for i in range(len(ALPHAS))]
    fits = manyfits.solve(blocks, [_net(ALPHAS[i], RATIOS[r]) for r, i in grid])
    out = [(arm, RATIOS[grid[f][0]], grid[f][1], round(ALPHAS[grid[f][1]], 6), int((r.beta != 0).sum()), round(float(np.abs(r.beta).sum()), 4), r.converged) for (arm, f), r in fits.items()]
    return spark.createDataFrame(out, "arm string, l1_ratio double, path_index int, alpha double, n_nonzero int, l1 double, converged boolean")


_PENALTIES, _TOLERANCE, _NEST = (0.1, 1.0, 10.0, 100.0), 0.005, 3


def _folded(x, seed: str = "nested"):
    return x.withColumn("fold", F.pmod(draw_key(F.lit(seed), "id"), F.lit(_NEST)).cast("int"))


def cross_validated(blocks: manyfits.Blocks, candidates: list[manyfits.Fit]):
    """Staged ``grp, outer, candidate, inner_c, outer_c, converged``: for every group, outer fold and candidate the mean concordance on the inner folds,
    and that of a fit to all inner folds on the outer one.

    A fit without folds i and j serves outer fold i with inner fold j, and the other way round.
    """
    spark, every = blocks.df.sparkSession, frozenset(range(_NEST))
    pairs = [(i, j) for i in range(_NEST) for j in range(i + 1, _NEST)]
    plan = [(c, out) for c in range(len(candidates)) for out in [*map(frozenset, pairs), *(frozenset([i]) for i in range(_NEST))]]
    fits = manyfits.solve(blocks, [replace(candidates[c], folds=every - out) for c, out in plan])
    table = {g: np.stack([fits[g, f].beta for f in range(len(plan))]) for g in blocks.groups}
    sent = spark.sparkContext.broadcast(table)

    def scored(grp, t, e, x, fold, _):
        beta, parts = sent.value[grp], {}
        for f, (_, out) in enumerate(plan):
            for k in out:
                if k not in parts:
                    at = np.flatnonzero(fold == k)
                    parts[k] = t[at], x[at], (e[at, None] == 1).astype(float), np.ones((len(at), 1))
                t_k, x_k, event, one = parts[k]
                # Summed feature by feature, so that equal subjects have equal risks in all blocks.
                yield f * _NEST + k, t_k, sum(x_k[:, i] * b for i, b in enumerate(beta[f])), event, one

    counted = concordance(blocks, scored)
    sent.unpersist()
    rows = [(g, n // _NEST, n % _NEST, float(s[0] / d[0]) if d[0] > 0 else None) for (g, n), (s, d) in counted.items()]
    c = spark.createDataFrame(rows, "grp string, fit int, fold int, c double")  # a row per group, fit and fold
    named = [(f, cand, i, j) for f, (cand, out) in enumerate(plan) for i in range(_NEST) for j in range(_NEST) if (out == {i, j} if i != j else out == {i})]
    named = spark.createDataFrame(named, "fit int, candidate int, outer int, fold int")  # a row per fit and fold
    c = c.join(F.broadcast(named), ["fit", "fold"])
    inner = F.col("outer") != F.col("fold")
    # A candidate counts only if it has a concordance on every inner fold.
    complete = F.count(F.when(inner, F.col("c"))) == _NEST - 1
    sums = c.groupBy("grp", "outer", "candidate").agg(F.when(complete, F.avg(F.when(inner, F.col("c")))).alias("inner_c"), F.max(F.when(~inner, F.col("c"))).alias("outer_c"))
    fine = [(g, plan[f][0], r.converged) for (g, f), r in fits.items()]
    flags = spark.createDataFrame(fine, "grp string, candidate int, ok boolean").groupBy("grp", "candidate").agg(F.every("ok").alias("converged"))
    return stage(sums.join(flags, ["grp", "candidate"]), "cross_validated")


def tuned(cv, order: list):
    """The first candidate, in ``order``, of those within tolerance of the best on the inner folds."""
    best = F.max("inner_c").over(Window.partitionBy("grp", "outer"))
    near = cv.filter("inner_c IS NOT NULL").withColumn("best_c", best).filter(F.col("inner_c") >= F.col("best_c") - _TOLERANCE)
    first = F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), "candidate", "best_c", "outer_c", "converged")).alias("t")
    return near.groupBy("grp", "outer").agg(first).select("grp", "outer", "t.candidate", "t.best_c", "t.outer_c", "t.converged")


@query("v18_nested_tuning")
def nested_tuning(spark, d):
    """For each outer fold, inner folds score the penalties; the largest within tolerance of the best is fitted to
    all inner folds and scored on the outer one, which no choice has seen."""
    x = _features(spark, d)
    blocks = manyfits.pack(_folded(x), "arm", _FEATURES, "fold", "id")
    drop(x)
    chosen = tuned(cross_validated(blocks, [manyfits.Fit(l2=a) for a in _PENALTIES]), [-F.col("candidate")])
    alpha = F.element_at(F.array(*map(F.lit, _PENALTIES)), F.col("candidate") + 1)
    return chosen.select(F.col("grp").alias("arm"), "outer", alpha.alias("alpha"), F.round("best_c", 4).alias("best_c"), F.round("outer_c", 4).alias("outer_c"), "converged")


@query("v18b_elastic_net_tuning")
def elastic_net_tuning(spark, d):
    """The same for mixed penalties: of the candidates within tolerance the first of the path, then the larger part of absolute penalty."""
    grid = [(i, r) for i in range(0, 30, 7) for r in (0.5, 1.0)]
    blocks = manyfits.pack(_folded(_features(spark, d)), "arm", _FEATURES, "fold", "id")
    table = spark.createDataFrame([(c, i, r) for c, (i, r) in enumerate(grid)], "candidate int, path_index int, l1_ratio double")
    cv = cross_validated(blocks, [_net(ALPHAS[i], r) for i, r in grid]).join(F.broadcast(table), "candidate")
    chosen = tuned(cv, [F.col("path_index"), -F.col("l1_ratio")]).join(F.broadcast(table), "candidate")
    return chosen.select(F.col("grp").alias("arm"), "outer", "path_index", "l1_ratio", F.round("best_c", 4).alias("best_c"), F.round("outer_c", 4).alias("outer_c"), "converged")


@query("v20b_directional_refit")
def directional_refit(spark, d):
    """One penalty, refitted in each arm: do the coefficients point the same way as overall?"""
    fits = newton(_features(spark, d), "arm", _FEATURES, lambda _: 10.0)
    arms = spark.createDataFrame([(g, t, round(float(x), 5)) for g, (b, _) in fits.items() for t, x in zip(_FEATURES, b, strict=True)], "arm string, term string, b double")
    mean = arms.groupBy("term").agg(F.avg("b").alias("mean_b"))
    return arms.join(mean, "term").select("arm", "term", "b", (F.sign("b") == F.sign("mean_b")).alias("same_sign"))
