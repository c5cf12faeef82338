"""Statistics as aggregate and window expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scalars import col, finite


def finite_mean(c: Column | str) -> Column:
    return F.avg(finite(c))


def finite_median(c: Column | str) -> Column:
    return F.median(finite(c))


def finite_fraction(c: Column | str) -> Column:
    return F.avg(finite(c).isNotNull().cast("double"))


def rate_over(flag: Column, valid: Column) -> Column:
    """The rate of ``flag`` among valid rows only."""
    return F.avg(F.when(valid, flag.cast("double")))


def pearson(x: Column | str, y: Column | str, least: int = 3) -> Column:
    """Correlation of complete pairs; null for fewer than ``least`` or a constant side."""
    x, y = finite(x), finite(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    # The product of standard deviations may be tiny without being zero, so divide by hand.
    cov = F.covar_pop(a, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), cov / F.nullif(spread, F.lit(0.0)))


def average_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 in each group, ties sharing their mean; nulls get no rank."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    peers = Window.partitionBy(*by, value)
    r = F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2.0
    return df.withColumn(name, F.when(F.col(value).isNotNull(), r))


def percentile_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "pct") -> DataFrame:
    """(average rank - 1) / (n - 1)."""
    out = average_rank(df, value, by, "_r")
    n = F.count(value).over(Window.partitionBy(*by))
    return out.withColumn(name, F.try_divide(F.col("_r") - 1, n - 1)).drop("_r")


def quantile_bucket(df: DataFrame, value: str, tiebreak: Sequence[str], by: Sequence[str], q: int = 4, name: str = "bucket") -> DataFrame:
    """Equal-width cuts of ordinal ranks, as quantile cuts of distinct ranks give; ``ntile`` differs."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(value, *tiebreak))
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    cut = F.greatest(F.lit(1), F.ceil((r - 1) * q / F.greatest(n - 1, F.lit(1))).cast("int"))
    return df.withColumn(name, cut)


def smd(x: Column | str, group: Column | str) -> Column:
    """Standardised mean difference of group 1 and 0, with the pooled sample variance."""
    x, g = finite(x), col(group)
    m1, m0 = F.avg(F.when(g == 1, x)), F.avg(F.when(g == 0, x))
    v1, v0 = F.var_samp(F.when(g == 1, x)), F.var_samp(F.when(g == 0, x))
    pooled = F.sqrt((v1 + v0) / 2)
    return F.when(pooled > 0, (m1 - m0) / F.nullif(pooled, F.lit(0.0))).when(m1 == m0, F.lit(0.0))


def auc_from_ranks(y: Column | str, rank: Column | str) -> Column:
    """Area under the ROC curve from average ranks of the scores; null unless both classes are there."""
    y, r = col(y), col(rank)
    n1, n0 = F.count(F.when(y == 1, 1)), F.count(F.when(y == 0, 1))
    return F.try_divide(F.sum(F.when(y == 1, r)) - n1 * (n1 + 1) / 2.0, n1 * n0)


def welch(x: Column | str, group: Column | str) -> tuple[Column, Column]:
    """t and its degrees of freedom for two groups with unequal variances."""
    x, g = finite(x), col(group)
    n1, n0 = F.count(F.when(g == 1, x)), F.count(F.when(g == 0, x))
    a, b = F.try_divide(F.var_samp(F.when(g == 1, x)), n1), F.try_divide(F.var_samp(F.when(g == 0, x)), n0)
    t = F.try_divide(F.avg(F.when(g == 1, x)) - F.avg(F.when(g == 0, x)), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n0 - 1))
    return t, df


def bh_adjust(df: DataFrame, p: str, by: Sequence[str], name: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values in each group; nulls stay null and don't count, ties share the least."""
    m = F.count(p).over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
    out = df.withColumn("_raw", F.when(F.col(p).isNotNull(), F.col(p) * m / r))
    down = Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_first(), F.col("_raw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min("_raw").over(down)))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), q)).drop("_raw")
