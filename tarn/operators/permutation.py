"""Permuted labels without a row per draw: all draws of a batch of subjects at once, as matrices.

A draw puts subjects in the order of a hash of their own, and deals the labels out along it, so many of each as there
are. Where one label ends and the next begins is a cut: the subject at a known place of that order. Cuts are found by
counting in ever smaller intervals of the hash, a pass each, and a sort of the few subjects in the last one. From then on a
subject's label in every draw follows from its hash alone, and statistics are sums of its values over draws and labels.

Draw 0 has the labels as they are. Subjects need ids of their own; those without an id, a label or a value take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage

PRIME = (1 << 31) - 1
#: Intervals that a counting pass cuts an interval into, and subjects of an interval that are sorted.
BINS, SORTED = 256, 2000
#: Subjects whose matrices are in memory at once.
CHUNK = 1000


def _seeded(seed: str, kind: str, draw: int) -> int:
    return int(hashlib.sha256(f"{seed}|{kind}|{draw}".encode()).hexdigest()[:8], 16)


def multipliers(seed: str, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """A draw's hash of a subject is (a * u + b) mod PRIME, where u is the subject's own hash."""
    a = [1 + _seeded(seed, "a", d) % (PRIME - 1) for d in range(1, draws + 1)]
    b = [_seeded(seed, "b", d) % PRIME for d in range(1, draws + 1)]
    return np.array(a, np.int64), np.array(b, np.int64)


def subjects(df: DataFrame, id: str, label: str, values: str, seed: str) -> DataFrame:
    """Staged ``id, u, label, x``: the subjects with their hash and an array of values."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id).cast("string")), 256), 1, 8), 16, 10).cast("long") % PRIME
    rows = df.select(F.col(id).cast("long").alias("id"), u.alias("u"), F.col(label).cast("string").alias("label"), F.col(values).cast("array<double>").alias("x"))
    return stage(rows.dropna(), "subjects")


@dataclass
class Draws:
    """Labels in order, how many subjects have each, and the cuts: draws x (labels - 1) hashes and ids."""

    labels: list[str]
    sizes: np.ndarray
    a: np.ndarray
    b: np.ndarray
    h: np.ndarray
    id: np.ndarray

    def assign(self, u: np.ndarray, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Subjects x (1 + draws) places of labels; the first column are their ``own``."""
        out = np.empty((len(u), 1 + len(self.a)), np.int8)
        out[:, 0] = own
        h = (u[:, None] * self.a + self.b) % PRIME
        drawn = np.zeros(h.shape, np.int8)
        for j in range(self.h.shape[1]):
            drawn += (h > self.h[:, j]) | ((h == self.h[:, j]) & (ids[:, None] > self.id[:, j]))
        out[:, 1:] = drawn
        return out

    def places(self, labels: pa.Array) -> np.ndarray:
        at = {k: i for i, k in enumerate(self.labels)}
        return np.array([at[x] for x in labels.to_pylist()], np.int8)


def draw(rows: DataFrame, draws: int, seed: str) -> Draws:
    """Find the cuts of all draws for ``subjects``; of them, a number per draw and cut reaches the driver."""
    sizes = sorted((r["label"], r["n"]) for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect())  # a row per label
    a, b = multipliers(seed, draws)
    labels, n = [k for k, _ in sizes], np.array([v for _, v in sizes], np.int64)
    cuts = max(len(labels) - 1, 0)
    rank = np.tile(np.cumsum(n)[:-1], (draws, 1)) if cuts else np.zeros((draws, 0), np.int64)
    low, width = np.zeros((draws, cuts), np.int64), 1 << 31
    inside = n.sum()
    while cuts and inside > SORTED and width > 1:
        step = width // BINS or 1
        found = _counts(rows, a, b, low, step)
        before = np.cumsum(found, 2) - found
        at = (np.cumsum(found, 2) < rank[:, :, None]).sum(2)
        pick = np.take_along_axis(before, at[:, :, None], 2)[:, :, 0]
        rank = rank - pick
        inside = np.take_along_axis(found, at[:, :, None], 2).max()
        low, width = low + at * step, step
    h, ids = np.zeros((draws, cuts), np.int64), np.zeros((draws, cuts), np.int64)
    if cuts:
        table = rows.sparkSession.createDataFrame([(d * cuts + j, int(rank[d, j])) for d in range(draws) for j in range(cuts)], "cut long, rank long")
        place = F.row_number().over(Window.partitionBy("cut").orderBy("h", "id"))
        near = _near(rows, a, b, low, width).withColumn("place", place).join(F.broadcast(table), "cut").filter("place = rank")  # a row per draw and cut
        for r in near.collect():
            h.flat[r["cut"]], ids.flat[r["cut"]] = r["h"], r["id"]
    return Draws(labels, n, a, b, h, ids)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), CHUNK):
            yield batch.slice(at, CHUNK)


def _counts(rows: DataFrame, a: np.ndarray, b: np.ndarray, low: np.ndarray, step: int) -> np.ndarray:
    """How many subjects of each draw are in each of the BINS intervals from ``low`` on: draws x cuts x BINS."""
    draws, cuts = low.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws * cuts, BINS + 1), np.int64)
        for batch in chunks(batches):
            h = (batch.column(0).to_numpy()[None, :] * a[:, None] + b[:, None]) % PRIME
            for j in range(cuts):
                at = (h - low[:, j : j + 1]) // step
                at = np.where((at < 0) | (at >= BINS), BINS, at) + (BINS + 1) * np.arange(draws)[:, None]
                total[j::cuts] += np.bincount(at.ravel(), minlength=draws * (BINS + 1)).reshape(draws, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws * cuts)), pa.array(total[:, :BINS].tolist(), pa.list_(pa.int64()))], ["cut", "n"])

    parts = rows.select("u").mapInArrow(run, "cut long, n array<long>").select("cut", F.posexplode("n").alias("bin", "n")).filter("n > 0")
    out = np.zeros((draws * cuts, BINS), np.int64)
    sums = parts.groupBy("cut", "bin").agg(F.sum("n").alias("n")).toArrow()  # draws x cuts x BINS numbers at most
    out[sums.column("cut").to_numpy(), sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(draws, cuts, BINS)


def _near(rows: DataFrame, a: np.ndarray, b: np.ndarray, low: np.ndarray, width: int) -> DataFrame:
    """``cut, h, id`` of the subjects in each cut's last interval."""
    draws, cuts = low.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            u, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            h = (u[:, None] * a + b) % PRIME
            for j in range(cuts):
                row, d = np.nonzero((h >= low[:, j]) & (h < low[:, j] + width))
                yield pa.RecordBatch.from_arrays([pa.array(d * cuts + j), pa.array(h[row, d]), pa.array(ids[row])], ["cut", "h", "id"])

    return rows.select("u", "id").mapInArrow(run, "cut long, h long, id long")


def label_sums(rows: DataFrame, drawn: Draws) -> DataFrame:
    """``draw, label, at, s``: by draw and place of label, the sum of each value; ``draw`` -1 has the sums of squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = squares = None
        for batch in chunks(batches):
            u, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = batch.column(3).flatten().to_numpy().reshape(len(batch), -1)
            place = drawn.assign(u, ids, drawn.places(batch.column(2)))
            now = np.stack([(place == g).T.astype(np.float64) @ x for g in range(len(drawn.labels))], 1)
            sums, squares = (now, (x * x).sum(0)) if sums is None else (sums + now, squares + (x * x).sum(0))
        if sums is not None:
            flat = [*sums.reshape(-1, sums.shape[2]), squares]
            keys = [(d, g) for d in range(sums.shape[0]) for g in range(sums.shape[1])] + [(-1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([f.tolist() for f in flat], pa.list_(pa.float64()))], ["draw", "label", "s"])

    parts = rows.select("u", "id", "label", "x").mapInArrow(run, "draw int, label int, s array<double>")
    return parts.select("draw", "label", F.posexplode("s").alias("at", "s")).groupBy("draw", "label", "at").agg(F.sum("s").alias("s"))


def permanova(df: DataFrame, id: str, label: str, values: str, draws: int, seed: str) -> DataFrame:
    """``pseudo_f, r2, p, null_mean, null_q95, permutations``: how much of the values' spread lies between labels, and
    how much does under ``draws`` permutations of them. With fewer than two labels the figures are null."""
    rows = subjects(df, id, label, values, seed)
    drawn = draw(rows, draws, seed)
    n, groups = float(drawn.sizes.sum()), len(drawn.labels)
    sums = stage(label_sums(rows, drawn), "label_sums")
    size = F.element_at(F.array(*(F.lit(float(k)) for k in (drawn.sizes if groups else [1]))), F.col("label") + 1)
    between = sums.filter("draw >= 0").groupBy("draw").agg(F.sum(F.col("s") * F.col("s") / size).alias("q"))
    mean = sums.filter("draw = 0").groupBy("at").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s") / F.lit(n or 1.0)).alias("m"))
    total = sums.filter("draw = -1").agg(F.sum("s").alias("t"))
    r2 = F.try_divide(F.col("q") - F.col("m"), F.col("t") - F.col("m"))
    x = between.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(total)).withColumn("r2", F.when(F.lit(groups > 1), r2))  # a row each
    seen = F.max(F.when(F.col("draw") == 0, F.col("r2"))).over(Window.partitionBy(F.lit(0)))  # a row per draw
    x = x.withColumn("seen", seen)
    null = F.when(F.col("draw") > 0, F.col("r2"))
    out = x.agg(
        F.max("seen").alias("r2"),
        ((1 + F.count_if((F.col("draw") > 0) & (F.col("r2") >= F.col("seen")))) / F.lit(draws + 1.0)).alias("p"),
        F.avg(null).alias("null_mean"),
        F.percentile(null, 0.95).alias("null_q95"),
    )
    f = F.try_divide(F.col("r2") / F.lit(float(max(groups - 1, 1))), (1 - F.col("r2")) / F.lit(n - groups))
    return out.select(f.alias("pseudo_f"), "r2", F.when(F.col("r2").isNotNull(), F.col("p")).alias("p"), "null_mean", "null_q95", F.lit(draws).alias("permutations"))
