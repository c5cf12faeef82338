"""Joins of intervals that overlap, by buckets of time, without a range join.

Each interval has a level, so that it lies in few buckets of that level's width; a level's buckets are twice as wide as those of the one below. A pair
meets in the buckets of the higher of its two levels, and only in the first bucket that both share, so no pair comes
twice and nothing is made distinct. Long intervals are copied into few wide buckets, never into many narrow ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stage

#: Buckets that an interval lies in at its own level, about.
SPREAD = 4


def _buckets(df: DataFrame, start: str, end: str, width: float, top: int, tag: str) -> DataFrame:
    """A row per level from the interval's own up to ``top`` and per bucket that it lies in."""
    span = F.col(end) - F.col(start)
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(span / F.lit(width * SPREAD), F.lit(1e-9))))).cast("int")
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col(start) / size), F.floor(F.col(end) / size)
    # A half-open interval that ends where a bucket begins doesn't lie in it.
    last = F.when((last * size == F.col(end)) & (last > first), last - 1).otherwise(last)
    x = df.withColumn(f"_own_{tag}", own).withColumn("_level", F.explode(F.sequence(F.col(f"_own_{tag}"), F.lit(top))))
    return x.withColumn(f"_first_{tag}", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def levels(df: DataFrame, start: str, end: str, width: float) -> int:
    longest = df.agg(F.max(F.col(end) - F.col(start)).alias("m")).first()["m"] or 0.0
    top = 0
    while width * SPREAD * 2**top < longest:
        top += 1
    return top


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """All pairs, equal in ``by``, of half-open intervals [start, end) that share a moment; ends are numbers.

    Column names of both sides must differ but for ``by``. Intervals that are null or end before or where they start
    overlap nothing. ``width`` is the narrowest bucket's; the mean interval's length if it isn't given.
    """
    (ls, le), (rs, re) = left_span, right_span
    a = stage(left.filter(F.col(le) > F.col(ls)), "intervals")
    b = stage(right.filter(F.col(re) > F.col(rs)), "intervals")
    if width is None:
        means = [x.agg(F.avg(F.col(e) - F.col(s)).alias("m")).first()["m"] for x, s, e in ((a, ls, le), (b, rs, re))]
        known = [float(m) for m in means if m]
        width = sum(known) / len(known) if known else 1.0
    top = max(levels(a, ls, le, width), levels(b, rs, re, width))
    pairs = _buckets(a, ls, le, width, top, "l").join(_buckets(b, rs, re, width, top, "r"), [*by, "_level", "_bucket"])
    met: Column = F.col("_level") == F.greatest("_own_l", "_own_r")
    once = F.col("_bucket") == F.greatest("_first_l", "_first_r")
    overlap = (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le))
    return pairs.filter(met & once & overlap).drop("_level", "_bucket", "_own_l", "_own_r", "_first_l", "_first_r")
