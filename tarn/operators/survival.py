"""Survival analysis as window queries: step estimates, concordance, Brier scores, baseline hazards."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stage
from .concordance import Scored, concordance
from .manyfits import pack
from .relational import asof


def kaplan_meier(df: DataFrame, by: Sequence[str], time: str = "time", event: str = "event", flip: bool = False) -> DataFrame:
    """``by, t, n, d, s``: at risk, events and the product-limit estimate at each time of a group.

    Rows are first counted per group and time; the windows then see one row per time. With ``flip``,
    censoring is the event: the censoring curve, whose risk set takes all times from t on. Rows without a time count nowhere.
    """
    e = F.col(event) == (0 if flip else 1)
    steps = df.filter(F.col(time).isNotNull()).groupBy(*by, F.col(time).alias("t")).agg(F.count("*").alias("k"), F.count_if(e).alias("d"))
    late = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    early = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("n", F.sum("k").over(late))
    return steps.withColumn("s", F.product(1 - F.col("d") / F.col("n")).over(early)).select(*by, "t", "n", "d", "s")


def median_time(km: DataFrame, by: Sequence[str]) -> DataFrame:
    """The first time at which the estimate is at most a half; null if it never is."""
    return km.groupBy(*by).agg(F.min(F.when(F.col("s") <= 0.5, F.col("t"))).alias("median"))


def breslow(df: DataFrame, by: Sequence[str], risk: str = "risk", clip: float = 30.0, time: str = "time", event: str = "event") -> DataFrame:
    """``by, t, h``: the cumulative baseline hazard; all ties of a time are in its risk set."""
    w = F.exp(F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(risk))))
    steps = df.groupBy(*by, F.col(time).alias("t")).agg(F.sum(w).alias("w"), F.sum(event).alias("d"))
    late = Window.partitionBy(*by).orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    early = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("jump", F.col("d") / F.sum("w").over(late))
    return steps.withColumn("h", F.sum("jump").over(early)).select(*by, "t", "h")


def with_censoring_weight(df: DataFrame, by: Sequence[str], time: str = "time") -> DataFrame:
    """Each subject with ``g``, the censoring curve just before its time. ``df`` is read twice: stage what is costly.

    A subject's own time is a row of its group's curve, and the value before it the row before; so the window sees a row
    per time, and subjects are joined on their time.
    """
    before = Window.partitionBy(*by).orderBy("t")
    g = kaplan_meier(df, by, time=time, flip=True).select(*by, F.col("t").alias(time), F.coalesce(F.lag("s").over(before), F.lit(1.0)).alias("g"))
    return _at_times(df, g, by, time, "g")


def with_curve(df: DataFrame, curve: DataFrame, by: Sequence[str], name: str, time: str = "time", left_limit: bool = True) -> DataFrame:
    """The same for another group's or sample's ``curve`` (``by, t, s``): looked up once per time, then joined on the time."""
    times = df.select(*by, time).distinct()
    return _at_times(df, asof(times, curve, by, time, "t", "s", name, before_first=1.0, left_limit=left_limit), by, time, name)


def _at_times(df: DataFrame, values: DataFrame, by: Sequence[str], time: str, name: str) -> DataFrame:
    return df.join(values, [*by, time], "left").withColumn(name, F.coalesce(name, F.lit(1.0))).select(*df.columns, name)


def uno_pairs(df: DataFrame, by: Sequence[str], tau: DataFrame, risk: str = "risk") -> DataFrame:
    """Inverse-probability-weighted concordance up to ``tau`` by group.

    Within a group it counts, for every event, the later subjects with a lower or an equal risk: pairs within blocks of
    subjects, and between them (``concordance``). A risk that is null is neither lower nor equal; groups without a pair are left out.
    """
    x = stage(with_censoring_weight(df, by).join(tau, list(by)).withColumn("_group", F.to_json(F.array(*(F.col(c).cast("string") for c in by)))), "uno")
    usable = (F.col("event") == 1) & (F.col("time") < F.col("tau"))
    known = F.when(F.col(risk).isNull(), 0.0).when(F.isnan(risk), 2.0).otherwise(1.0)
    rows = x.select("_group", "time", F.lit(0).alias("event"), F.when(known == 1, F.col(risk)).otherwise(0.0).alias("r"), known.alias("known"), F.when(usable, 1 / (F.col("g") * F.col("g"))).otherwise(0.0).alias("w"))
    sums = concordance(pack(rows, "_group", ["r", "known", "w"]), _scored_risks)
    found = [(g, float(sums[g, 1][0][0] / d[0]) if (g, 1) in sums else 0.0) for (g, n), (_, d) in sums.items() if n == 0 and d[0] > 0]
    c = df.sparkSession.createDataFrame(found, "_group string, c double")  # a row per group
    return x.select("_group", *by).distinct().join(c, "_group").select(*by, "c")


def _scored_risks(grp: str, t: np.ndarray, e: np.ndarray, x: np.ndarray, fold: np.ndarray, ids: np.ndarray) -> Iterator[Scored]:
    """Count 0 is for all pairs, and count 1 for those whose risks are both known."""
    ones, known = np.ones((len(t), 1)), x[:, 1] > 0
    yield 0, t, np.zeros(len(t)), x[:, 2:3], ones
    yield 1, t[known], np.where(x[known, 1] == 2, np.nan, x[known, 0]), x[known, 2:3], ones[known]


def uno_fast(df: DataFrame, by: str, tau: DataFrame | None = None, risk: str = "risk", times: str | None = None) -> DataFrame:
    """The same in n log n rows, as one sum: no group is gathered, no pairs are made.

    Risks are ranked within the group. Two ranks first differ in one bit; at each bit, subjects whose ranks
    agree above it are a node, and an event whose bit is set counts the later subjects whose bit is not. So
    rows are summed by node and time, and a window over a node's times counts what comes later. ``times`` is
    how often a subject counts. Without ``tau`` all events count, and weigh alike.
    """
    if tau is not None:
        x = with_censoring_weight(df, [by]).join(tau, by)
        usable, weight = (F.col("event") == 1) & (F.col("time") < F.col("tau")), 1 / (F.col("g") * F.col("g"))
    else:
        x, usable, weight = df, F.col("event") == 1, F.lit(1.0)
    m = F.col(times).cast("double") if times else F.lit(1.0)
    x = x.select(by, "time", F.col(risk).alias("r"), m.alias("m"), F.when(usable, m * weight).otherwise(0.0).alias("w"))
    ranks = x.select(by, "r").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("r")) - 1)
    ranks = stage(ranks, "ranks")
    bits = int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length()
    # Level -1 are equal risks, which count half; the last level is everyone later, for the denominator.
    level = F.col("level")
    node = F.when(level < 0, F.col("rank")).when(level == bits, 0).otherwise(F.expr("shiftright(rank, level + 1)"))
    bit = F.when((level >= 0) & (level < bits), F.expr("shiftright(rank, level) & 1"))
    rows = x.join(ranks, [by, "r"]).withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(bits))))
    low, high = F.when(bit.isNull() | (bit == 0), F.col("m")).otherwise(0.0), F.when(bit == 0, 0.0).otherwise(F.col("w"))
    cells = rows.groupBy(by, "level", node.alias("node"), "time").agg(F.sum(low).alias("low"), F.sum(high).alias("high"))
    later = Window.partitionBy(by, "level", "node").orderBy(F.col("time").desc()).rowsBetween(Window.unboundedPreceding, -1)
    part = F.col("high") * F.coalesce(F.sum("low").over(later), F.lit(0.0))
    sums = cells.withColumn("part", part * F.when(level < 0, 0.5).otherwise(1.0)).groupBy(by)
    below, total = F.sum(F.when(level < bits, F.col("part"))), F.sum(F.when(level == bits, F.col("part")))
    return sums.agg(below.alias("n"), total.alias("d")).select(by, F.when(F.col("d") > 0, F.col("n") / F.col("d")).alias("c"))


def brier(df: DataFrame, by: Sequence[str], grid: DataFrame, survival: Column) -> DataFrame:
    """``by, i, t, bs``: the weighted Brier score of ``survival`` (of columns t and the subject's) on a grid.

    ``grid`` has ``by, ts``: an array of times. Events up to t weigh by the censoring curve before
    them, later subjects by the curve at t; both curves are as-of lookups, not range joins.
    """
    x = stage(with_censoring_weight(df, by), "brier")
    g = kaplan_meier(x, by, flip=True)
    points = asof(grid.select(*by, F.posexplode("ts").alias("i", "t")), g, by, "t", "t", "s", "gt", before_first=1.0)
    per_group = points.groupBy(*by).agg(F.collect_list(F.struct("i", "t", "gt")).alias("points"))
    rows = x.join(per_group, list(by)).withColumn("p", F.explode("points")).select("*", "p.i", "p.t", "p.gt").drop("points", "p")
    s = survival
    loss = F.when((F.col("time") <= F.col("t")) & (F.col("event") == 1), F.try_divide(s * s, F.col("g"))).when(F.col("time") > F.col("t"), F.try_divide((1 - s) * (1 - s), F.col("gt"))).otherwise(0.0)
    return rows.groupBy(*by, "i", "t").agg(F.avg(loss).alias("bs"))


def integrate(points: DataFrame, by: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Trapezoid mean of y over x in each group."""
    w = Window.partitionBy(*by).orderBy(x)
    p = points.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)})
    return p.groupBy(*by).agg(F.try_divide(F.sum((F.col(y) + F.col("_y")) / 2 * (F.col(x) - F.col("_x"))), F.max(x) - F.min(x)).alias(name))
