"""Ranks within groups of any size: rows are range-sorted, and a rank is a place in a partition plus what came before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage

_PLACE_BITS = 33  # monotonically_increasing_id() keeps a row's place in the low 33 bits
#: Rows of a table of offsets that is broadcast at most.
FEW = 100_000


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: each row's place from 0 within its group in the order given; no group is gathered.

    Equal rows get distinct places, which a rerun may swap: order by something unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    placed = stage(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", _PLACE_BITS)
    runs = placed.groupBy(*by, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    runs = runs.select(*by, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    runs = stage(runs, "offsets")
    side = F.broadcast(runs) if runs.count() <= FEW else runs
    out = placed.withColumn("_part", part).join(side, [*by, "_part"])
    return out.withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
