"""Running values along time in groups of any size: exponentially weighted means and sums over a time frame.

Rows are range-sorted by group and time and packed into blocks, a row each. A block is summed up once; the driver carries these sums
from block to block, a row a block; then every block works with what came before it. A group with very many rows is many
blocks, never one task. A frame that begins in an earlier block asks that block for its running sum there; a block that very many rows ask is
copied, so that no task gets more than a block's worth of questions.

Rows without a group, a time or an id take no part; null values count as no rows of a frame, and leave a mean as it was.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage

#: Rows of a block, and questions that one copy of a block answers.
BLOCK = 1 << 16
#: The greatest exponent that a stretch of a block is scaled by.
STEEP = 300.0
_KINDS = "grp string, first double, first_id long, t array<double>, id array<long>, v array<double>"


@dataclass
class Blocks:
    df: DataFrame


def pack(rows: DataFrame, group: str, at: str, id: str, value: str) -> Blocks:
    """``at`` is a number; rows of equal time go by ``id``, which must be unique in a group."""
    x = rows.select(F.col(group).cast("string").alias("grp"), F.col(at).cast("double").alias("t"), F.col(id).cast("long").alias("id"), F.col(value).cast("double").alias("v"))
    x = x.dropna(subset=["grp", "t", "id"])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = x.repartitionByRange(parts, "grp", "t", "id").sortWithinPartitions("grp", "t", "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, n = None, [], 0

        def flush() -> pa.RecordBatch:
            t, ids, v = (np.concatenate([h[i] for h in held]) for i in range(3))
            columns = [pa.array([grp], pa.string()), pa.array([t[0]]), pa.array([ids[0]]), *(pa.array([c.tolist()], pa.list_(k)) for c, k in ((t, pa.float64()), (ids, pa.int64()), (v, pa.float64())))]
            return pa.RecordBatch.from_arrays(columns, ["grp", "first", "first_id", "t", "id", "v"])

        for b in batches:
            names = b.column(0).to_pylist()
            t, ids, v = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            at = 0
            while at < len(names):
                if held and (names[at] != grp or n >= BLOCK):
                    yield flush()
                    held, n = [], 0
                grp = names[at]
                end = bisect_right(names, grp, at, min(len(names), at + BLOCK - n))
                held.append((t[at:end], ids[at:end], v[at:end]))
                n, at = n + end - at, end
        if held:
            yield flush()

    return Blocks(stage(ordered.mapInArrow(packed, _KINDS), "blocks"))


def _block(b: pa.RecordBatch, k: int) -> tuple[tuple[str, float, int], np.ndarray, np.ndarray, np.ndarray]:
    key = tuple(b.column(i)[k].as_py() for i in range(3))
    t, ids, v = (b.column(i)[k].values for i in range(3, 6))
    return key, t.to_numpy(), ids.to_numpy(), v.to_numpy(zero_copy_only=False)


def decayed(t: np.ndarray, v: np.ndarray, tau: float, carry: tuple[float, float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values and of weights, both fading by exp(-dt / tau); ``carry``: the last time before, and both sums there."""
    known = ~np.isnan(v)
    sums, weights = np.empty(len(t)), np.empty(len(t))
    last, s, w = carry or (t[0], 0.0, 0.0)
    at = 0
    while at < len(t):
        end = int(np.searchsorted(t, t[at] + STEEP * tau, "right"))
        fade = math.exp(-(t[at] - last) / tau)
        up = np.exp((t[at:end] - t[at]) / tau)
        sums[at:end] = (s * fade + np.cumsum(np.where(known[at:end], v[at:end], 0.0) * up)) / up
        weights[at:end] = (w * fade + np.cumsum(known[at:end] * up)) / up
        last, s, w, at = t[end - 1], sums[end - 1], weights[end - 1], end
    return sums, weights


def ewm(blocks: Blocks, tau: float) -> DataFrame:
    """``grp, id, t, mean``: of each row and those before it, weighted by exp(-age / tau)."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                _, t, _, v = _block(b, k)
                s, w = decayed(t, v, tau, None)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(k, 1) for i in range(3)), *(pa.array([float(x)]) for x in (t[-1], s[-1], w[-1]))], ["grp", "first", "first_id", "last", "s", "w"])

    carry: dict[tuple, tuple[float, float, float]] = {}
    grp = before = None
    for r in sorted(blocks.df.mapInArrow(ends, "grp string, first double, first_id long, last double, s double, w double").collect()):  # a row per block
        if r["grp"] != grp:
            grp, before = r["grp"], None
        if before:
            carry[tuple(r)[:3]] = before
        fade = math.exp(-(r["last"] - before[0]) / tau) if before else 0.0
        before = (r["last"], r["s"] + fade * (before[1] if before else 0.0), r["w"] + fade * (before[2] if before else 0.0))
    sent = blocks.df.sparkSession.sparkContext.broadcast(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                key, t, ids, v = _block(b, k)
                s, w = decayed(t, v, tau, sent.value.get(key))
                mean = pa.array(np.divide(s, w, out=np.zeros(len(s)), where=w > 0), mask=w <= 0)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(t), pa.string()), pa.array(ids), pa.array(t), mean], ["grp", "id", "t", "mean"])

    return blocks.df.mapInArrow(run, "grp string, id long, t double, mean double")


def _running(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums before each place, and after the last."""
    known = ~np.isnan(v)
    return np.concatenate(([0], np.cumsum(known))), np.concatenate(([0.0], np.cumsum(np.where(known, v, 0.0))))


def rolling(blocks: Blocks, width: float) -> DataFrame:
    """``grp, id, t, n, s``: count and sum of the values of times from ``t - width`` to ``t``, both ends and all rows of equal times included."""
    spark = blocks.df.sparkSession

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                _, _, _, v = _block(b, k)
                n, s = _running(v)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(k, 1) for i in range(3)), pa.array([int(n[-1])]), pa.array([float(s[-1])])], ["grp", "first", "first_id", "n", "s"])

    order: dict[str, tuple[list[float], list[tuple], list[tuple[int, float]]]] = {}
    for r in sorted(blocks.df.mapInArrow(ends, "grp string, first double, first_id long, n long, s double").collect()):  # a row per block
        firsts, keys, before = order.setdefault(r["grp"], ([], [], [(0, 0.0)]))
        firsts.append(r["first"])
        keys.append((r["first"], r["first_id"]))
        before.append((before[-1][0] + r["n"], before[-1][1] + r["s"]))
    sent = spark.sparkContext.broadcast(order)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its two ends: the block that knows the running sum there, and the sum itself if it is this one."""
        for b in batches:
            for k in range(len(b)):
                (grp, first, first_id), t, ids, v = _block(b, k)
                firsts, keys, before = sent.value[grp]
                own = keys.index((first, first_id), bisect_left(firsts, first))
                n, s = _running(v)
                for x, side, sign in ((t, "right", 1), (t - width, "left", -1)):
                    block = np.searchsorted(firsts, x, side) - 1
                    place = np.searchsorted(t, x, side)
                    here, none = block == own, block < 0
                    count = np.where(none, 0, before[own][0] + n[place])
                    total = np.where(none, 0.0, before[own][1] + s[place])
                    known = here | none
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([grp] * len(t), pa.string()), pa.array(ids), pa.array(t), pa.array(np.full(len(t), sign, np.int32)), pa.array(np.maximum(block, 0).astype(np.int64)), pa.array(x), pa.array(count.astype(np.int64), mask=~known), pa.array(total, mask=~known)],
                        ["grp", "id", "t", "sign", "block", "x", "n", "s"],
                    )

    asked = stage(blocks.df.mapInArrow(ask, "grp string, id long, t double, sign int, block long, x double, n long, s double"), "asked")
    answered, pending = asked.filter("n IS NOT NULL").select("grp", "id", "t", "sign", "n", "s"), asked.filter("n IS NULL")
    copies = {(r["grp"], r["block"]): -(-r["count"] // BLOCK) for r in pending.groupBy("grp", "block").count().collect()}  # a row per block
    if copies:
        table = [(g, *order[g][1][i], i, c, *order[g][2][i]) for (g, i), c in copies.items()]
        named = spark.createDataFrame(table, "grp string, first double, first_id long, block long, copies long, n long, s double")
        known = blocks.df.join(F.broadcast(named), ["grp", "first", "first_id"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("grp", "block", "copy", "t", "v", "n", "s")
        ways = spark.createDataFrame([(g, i, c) for (g, i), c in copies.items()], "grp string, block long, ways long")
        pending = pending.join(F.broadcast(ways), ["grp", "block"]).withColumn("copy", F.pmod(F.xxhash64("id", "sign"), "ways")).select("grp", "block", "copy", "id", "t", "sign", "x")

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = left.combine_chunks(), right.combine_chunks()
            t, v = (right.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("t", "v"))
            n, s = _running(v)
            x, sign = left.column("x").to_numpy(), left.column("sign").to_numpy()
            place = np.where(sign > 0, np.searchsorted(t, x, "right"), np.searchsorted(t, x, "left"))
            return left.select(["grp", "id", "t", "sign"]).append_column("n", pa.array(n[place] + right.column("n")[0].as_py())).append_column("s", pa.array(s[place] + right.column("s")[0].as_py()))

        keys: Sequence[str] = ("grp", "block", "copy")
        more = pending.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(answer, "grp string, id long, t double, sign int, n long, s double")
        answered = answered.unionByName(more)
    return answered.groupBy("grp", "id", "t").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum(F.col("s") * F.col("sign")).alias("s"))
