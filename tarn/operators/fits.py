"""Iterative fits by rounds of summed moments: no group's rows are gathered.

A round evaluates every group's current coefficients in one pass: gradients and Hessians are sums over the
rows (for Cox models, over risk sets by time), and only these, a row per group, reach the driver, where a
Newton step is taken. Groups that have settled leave the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Terms = dict[Hashable, tuple[float, np.ndarray, np.ndarray]]


def _with_eta(rows: DataFrame, by: str, features: Sequence[str], betas: dict[Hashable, np.ndarray]) -> DataFrame:
    """The rows of the groups in ``betas``, with ``eta``; the table of coefficients has a row per group."""
    kind = rows.schema[by].dataType.simpleString()
    table = rows.sparkSession.createDataFrame([(g, [float(x) for x in b]) for g, b in betas.items()], f"{by} {kind}, _beta array<double>")
    eta = reduce(Column.__add__, (F.col(c) * F.col("_beta")[i] for i, c in enumerate(features)))
    return rows.join(F.broadcast(table), by).withColumn("eta", eta)


def _symmetric(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _collect(sums: DataFrame, by: str, p: int) -> Terms:
    out: Terms = {}
    for r in sums.collect():
        h = np.zeros((p, p))
        for i, j in _symmetric(p):
            h[i, j] = h[j, i] = r[f"h{i}_{j}"] or 0.0
        out[r[by]] = (r["loss"] or 0.0, np.array([r[f"g{i}"] or 0.0 for i in range(p)]), h)
    return out


def cox_terms(rows: DataFrame, by: str, features: Sequence[str], betas: dict[Hashable, np.ndarray]) -> Terms:
    """Negative log partial likelihood (Breslow ties), gradient and Hessian of each group at its coefficients.

    Rows are summed by time first, so a risk set's window sees a row per time.
    """
    p, pairs = len(features), _symmetric(len(features))
    x = _with_eta(rows, by, features, betas).withColumn("w", F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("eta")))))
    e = F.col("event").cast("double")
    steps = x.groupBy(by, "time").agg(
        F.sum(e).alias("d"),
        F.sum(e * F.col("eta")).alias("de"),
        *(F.sum(e * F.col(c)).alias(f"d{i}") for i, c in enumerate(features)),
        F.sum("w").alias("s"),
        *(F.sum(F.col("w") * F.col(c)).alias(f"s{i}") for i, c in enumerate(features)),
        *(F.sum(F.col("w") * F.col(features[i]) * F.col(features[j])).alias(f"s{i}_{j}") for i, j in pairs),
    )
    late = Window.partitionBy(by).orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, 0)
    names = ["s", *(f"s{i}" for i in range(p)), *(f"s{i}_{j}" for i, j in pairs)]
    risk = steps.withColumns({n: F.sum(n).over(late) for n in names}).filter("d > 0")
    mean = [F.col(f"s{i}") / F.col("s") for i in range(p)]
    sums = risk.groupBy(by).agg(
        F.sum(F.col("d") * F.ln("s") - F.col("de")).alias("loss"),
        *(F.sum(F.col("d") * mean[i] - F.col(f"d{i}")).alias(f"g{i}") for i in range(p)),
        *(F.sum(F.col("d") * (F.col(f"s{i}_{j}") / F.col("s") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in pairs),
    )
    return _collect(sums, by, p)


def logistic_terms(rows: DataFrame, by: str, features: Sequence[str], betas: dict[Hashable, np.ndarray], y: str = "y") -> Terms:
    """The same for a logistic classifier of ``y``."""
    x = _with_eta(rows, by, features, betas).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("eta"))))))
    loss = F.sum(F.ln(1 + F.exp(-F.abs("eta"))) + F.greatest("eta", F.lit(0.0)) - F.col("eta") * F.col(y))
    sums = x.groupBy(by).agg(
        loss.alias("loss"),
        *(F.sum((F.col("p") - F.col(y)) * F.col(c)).alias(f"g{i}") for i, c in enumerate(features)),
        *(F.sum(F.col("p") * (1 - F.col("p")) * F.col(features[i]) * F.col(features[j])).alias(f"h{i}_{j}") for i, j in _symmetric(len(features))),
    )
    return _collect(sums, by, len(features))


def newton(
    rows: DataFrame,
    by: str,
    features: Sequence[str],
    penalty: Callable[[Hashable], np.ndarray | float],
    centre: np.ndarray | None = None,
    terms: Callable[..., Terms] = cox_terms,
    rounds: int = 40,
    cap: float = np.inf,
) -> dict[Hashable, tuple[np.ndarray, bool]]:
    """Coefficients and whether they settled, by group, under a quadratic ``penalty`` towards ``centre``.

    A step that does not lower a group's penalised loss is halved in the next round. A group whose
    coefficients pass ``cap`` has no finite fit and is given up.
    """
    p = len(features)
    centre = np.zeros(p) if centre is None else centre
    groups = [r[0] for r in rows.select(by).distinct().collect()]  # a row per group, as is the result
    beta = {g: centre.copy() for g in groups}
    step = {g: np.zeros(p) for g in groups}
    value = dict.fromkeys(groups, np.inf)
    fits: dict[Hashable, tuple[np.ndarray, bool]] = {}
    for _ in range(rounds):
        tried = {g: beta[g] - step[g] for g in groups if g not in fits}
        if not tried:
            break
        found = terms(rows, by, features, tried)
        for g, b in tried.items():
            loss, gradient, hessian = found.get(g, (0.0, np.zeros(p), np.zeros((p, p))))
            weight = np.broadcast_to(penalty(g), p)
            now = loss + (weight / 2 * (b - centre) ** 2).sum()
            if not now <= value[g] + 1e-9 * max(1.0, abs(now)):
                step[g] = step[g] / 2
                continue
            moved, beta[g], value[g] = value[g] - now, b, now
            slope = gradient + weight * (b - centre)
            step[g] = np.linalg.lstsq(hessian + np.diag(weight), slope, rcond=None)[0]
            if np.abs(step[g]).max(initial=0.0) < 1e-9 or abs(moved) < 1e-13 * max(1.0, abs(now)):
                fits[g] = (b, True)
            elif np.abs(b).max(initial=0.0) > cap:
                fits[g] = (b, False)
    return {g: fits.get(g, (beta[g], False)) for g in groups}
