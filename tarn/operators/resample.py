"""Splits and resampling by hash order: no random generator, so both engines and all reruns agree."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from ..functions.scalars import draw_key
from ..shared import stage
from .ranks import group_rank


def stratified_folds(df: DataFrame, strata: Sequence[str], key: str, k: int, seed: Column | str, name: str = "fold") -> DataFrame:
    """Each stratum dealt round-robin into k folds in hash order."""
    order = Window.partitionBy(*strata).orderBy(draw_key(F.lit(seed) if isinstance(seed, str) else seed, key), key)
    return df.withColumn(name, ((F.row_number().over(order) - 1) % k).cast("int"))


def repeated_folds(df: DataFrame, strata: Sequence[str], key: str, k: int, repeats: int, seed: str) -> DataFrame:
    """``repeat, fold`` for every row and repeat."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy("repeat", *strata).orderBy(draw_key(F.lit(seed), "repeat", key), key)
    return rows.withColumn("fold", ((F.row_number().over(order) - 1) % k).cast("int"))


#: Rows of a group whose values are held in one array, and draws that are made from one copy of it.
GATHERED, DRAWS_AT_ONCE = 1_000_000, 64


def bootstrap_means(df: DataFrame, by: Sequence[str], key: str, value: str, draws: int, seed: str) -> DataFrame:
    """``by, draw, m``: means of resamples of each group, drawn with replacement.

    Row i of a group draws the row at hash(seed, draw, i) modulo n. Groups of up to GATHERED rows are an array each,
    and a draw is one sum over places of that array: no row for each draw and replicate. Larger groups are joined on the
    place, and their sums added up before they move.
    """
    x = group_rank(df.select(*by, key, F.col(value).cast("double").alias("v")), by, [F.col(key)], "i")
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"))
    small = x.join(sizes.filter(F.col("n") <= GATHERED), list(by)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.count("*").alias("n"))
    small = small.select(*by, "n", F.col("s.v").alias("vs"))
    parts = F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_AT_ONCE))
    small = small.withColumn("part", F.explode(parts)).repartition(*by, "part")
    first = F.col("part") * DRAWS_AT_ONCE
    small = small.withColumn("draw", F.explode(F.sequence(first, F.least(first + (DRAWS_AT_ONCE - 1), F.lit(draws - 1)))))
    places = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    at = lambda i: F.pmod(draw_key(F.lit(seed), F.col("draw"), i), F.col("n")).cast("int")
    total = F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get("vs", at(i)))
    means = small.select(*by, "draw", (total / F.col("n")).alias("m"))
    large = sizes.filter(F.col("n") > GATHERED)
    if large.isEmpty():
        return means
    y = stage(x.join(large, list(by)), "resample")
    drawn = y.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.select(*by, "draw", F.pmod(draw_key(F.lit(seed), "draw", "i"), F.col("n")).alias("i"))
    return means.unionByName(drawn.join(y.select(*by, "i", "v"), [*by, "i"]).groupBy(*by, "draw").agg(F.avg("v").alias("m")))


def mean_of_bootstrap_means(df: DataFrame, group: str, stratum: str, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """``stratum, draw, m``: the mean over a stratum's groups of what ``bootstrap_means`` gives; each group has one stratum.

    A draw takes the same places in all groups of one size, so values are first added up by stratum, size and place. What is
    drawn are these sums: for each size as many as it has places, however many groups there are.
    """
    x = group_rank(df.select(stratum, group, key, F.col(value).cast("double").alias("v")), [group], [F.col(key)], "i")
    sizes = x.groupBy(group, stratum).agg(F.count("*").alias("n"))
    groups = sizes.groupBy(stratum).agg(F.count("*").alias("_groups"))
    cells = x.join(sizes.select(group, "n").filter(F.col("n") <= GATHERED), group).groupBy(stratum, "n", "i").agg(F.sum("v").alias("v"))
    places = cells.groupBy(stratum, "n").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).select(stratum, "n", F.col("s.v").alias("vs"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = places.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_AT_ONCE)))).repartition(parts, stratum, "n", "first")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                n, first, vs = batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), batch.column(2)[k].values.to_numpy()
                own = range(first, min(draws, first + DRAWS_AT_ONCE))
                means = [float(vs[_hashes(f"{seed}|{draw}|", 0, n) % n].sum() / n) for draw in own]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), batch.schema.field(0).type), pa.array(own, pa.int32()), pa.array(means)], [stratum, "draw", "m"])

    kind = df.schema[stratum].dataType.simpleString()
    means = places.select(stratum, "n", "vs", "first").mapInArrow(drawn, f"{stratum} {kind}, draw int, m double")
    large = sizes.filter(F.col("n") > GATHERED).select(group)
    if not large.isEmpty():
        more = bootstrap_means(df.join(large, group), [group, stratum], key, value, draws, seed)
        means = means.unionByName(more.select(stratum, "draw", "m"))
    return means.groupBy(stratum, "draw").agg(F.sum("m").alias("m")).join(groups, stratum).select(stratum, "draw", (F.col("m") / F.col("_groups")).alias("m"))


def _hashes(start: str, first: int, end: int) -> np.ndarray:
    """``draw_key`` of texts that begin alike and end with a number."""
    head, out = hashlib.sha256(start.encode()), []
    for i in range(first, end):
        h = head.copy()
        h.update(b"%d" % i)
        out.append(h.digest()[:4])
    return np.frombuffer(b"".join(out), ">u4").astype(np.int64)


#: Places of a group that are joined at once, and places that a task draws.
PLACES, AT_ONCE = 1 << 16, 1 << 18


def multiplicities(rows: DataFrame, by: str, place: str, size: str, draws: int, seed: str) -> DataFrame:
    """``rows`` with ``times``, an array: how often each draw takes the row, where place i of a group draws the place
    at hash(seed, draw, group, i) modulo the group's size.

    A group's draws move as places within ranges of PLACES, two bytes each, and meet the rows of that range: no row for each draw and
    row, and no group is gathered. ``rows`` is read twice: stage what is costly.
    """
    groups = rows.select(by, size).distinct().filter(F.col(by).isNotNull())
    spread = groups.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(size) - 1).cast("long"), F.lit(AT_ONCE).cast("long"))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as so few rows would become one task
    spread = spread.select(F.col(by).cast("string").alias("_g"), F.col(size).cast("long").alias("_n"), "_draw", "_from").repartition(parts, "_g", "_draw", "_from")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n, draw, first in zip(*(batch.column(c).to_pylist() for c in ("_g", "_n", "_draw", "_from")), strict=True):
                at = np.sort(_hashes(f"{seed}|{draw}|{g}|", first, min(n, first + AT_ONCE)) % n)
                part = at // PLACES
                cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(at)]
                out = [(g, int(part[a]), draw, (at[a:b] % PLACES).astype("<u2").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["_g", "_part", "_draw", "_at"])

    drawn = spread.mapInArrow(taken, "_g string, _part long, _draw int, _at binary")
    own = rows.withColumns({"_g": F.col(by).cast("string"), "_part": F.floor(F.col(place) / PLACES).cast("long")})
    columns = rows.columns

    def met(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        times = np.zeros((PLACES, draws), np.int32)
        for draw, at in zip(theirs.column("_draw").to_pylist(), theirs.column("_at").to_pylist(), strict=True):
            times[:, draw] += np.bincount(np.frombuffer(at, "<u2"), minlength=PLACES).astype(np.int32)
        picked = times[mine.column(place).to_numpy() % PLACES]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * draws), pa.array(picked.ravel()))
        return pa.table([*(mine.column(c) for c in columns), lists], [*columns, "times"])

    kinds = T.StructType([*rows.schema.fields, T.StructField("times", T.ArrayType(T.IntegerType()))])
    return own.groupBy("_g", "_part").cogroup(drawn.groupBy("_g", "_part")).applyInArrow(met, kinds)


def interval(draws: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, 2.5 % and 97.5 % points, and the share above zero."""
    x = F.col(value)
    return draws.groupBy(*by).agg(F.avg(x).alias("mean"), F.percentile(x, 0.025).alias("p025"), F.percentile(x, 0.975).alias("p975"), F.avg((x > 0).cast("double")).alias("p_positive"))


def matched_panels(rows: DataFrame, set_col: str, stratum: str, item: str, draws: int, seed: str) -> DataFrame:
    """``set, draw, stratum, item``: for each set as many items of each stratum as it needs.

    ``rows`` has ``set, stratum, n, item``: the items that a set may draw, with the number ``n`` it needs of
    their stratum; a stratum with too few gives fewer, so check it.
    """
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    order = Window.partitionBy(set_col, "draw", stratum).orderBy(draw_key(F.lit(seed), set_col, "draw", item), item)
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= F.col("n")).select(set_col, "draw", stratum, item)


class LeastByDraw:
    """A Python table function over the items of one set and stratum: for each draw it keeps the ``n`` items of least hash.

    It holds ``n`` items a draw, however many it is given.
    """

    def __init__(self) -> None:
        self.heaps: dict[int, list[tuple[int, int]]] = {}

    def eval(self, row: Row, seed: str, draws: int) -> None:
        if row["item"] is None:
            return
        n, self.key = int(row["n"]), (row["s"], row["stratum"])
        for draw in range(draws):
            h = int(hashlib.sha256(f"{seed}|{row['s']}|{draw}|{row['item']}".encode()).hexdigest()[:8], 16)
            heap = self.heaps.setdefault(draw, [])
            entry = (-h, -int(row["item"]))  # the greatest is first to go
            if len(heap) < n:
                heapq.heappush(heap, entry)
            elif n and entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def terminate(self) -> Iterator[tuple]:
        for draw, heap in self.heaps.items():
            for _, item in heap:
                yield (*self.key, draw, -item)


def panels_by_table_function(rows: DataFrame, draws: int, seed: str) -> DataFrame:
    """``s, stratum, draw, item``: what ``matched_panels`` draws, without a row per item and draw. ``rows`` has ``s, stratum, n, item``."""
    least = udtf(LeastByDraw, returnType="s string, stratum int, draw long, item long")
    return least(rows.asTable().partitionBy("s", "stratum"), F.lit(seed), F.lit(draws))
