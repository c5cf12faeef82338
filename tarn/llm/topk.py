"""Exact top-k search by columnar branch and bound.

Vectors are quantised to integers and laid out in tiles, dimension by dimension. For a block of
queries, inner products grow one block of dimensions after another; after each, what the remaining
dimensions can add at most (the product of the remaining masses) drops candidates that cannot reach
the k-th best any more, and the columns of the survivors are compacted. Where sums could exceed what
doubles hold exactly, their rounding widens the bounds, and what is left is scored in whole numbers.

Defined results for odd input: vectors that are null or hold null or non-finite components take no
part; a shorter vector counts as padded with zeros; a query's own vec_id is never its candidate; rows
with an equal vec_id all are candidates, and such queries count once (the smallest vector); with fewer
than k candidates all are returned; rows with a null vec_id take no part; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, stage

TILE, QUERIES, STEP = 4096, 2048, 16
#: Components of a tile, and of a block of queries, at most; tiles and blocks before these grow.
TILE_VALUES, TILES = 1 << 20, 32
SCALE = 256
_EXACT = 2.0**53
_LARGE = 1e150  # squares of components above it could exceed doubles


def sound(vector: Column) -> Column:
    """Not null, and all components there and finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def best_of(queries: np.ndarray, q_ids: np.ndarray, tile: np.ndarray, ids: np.ndarray, k: int, step: int = STEP) -> tuple[list, list, list]:
    """Top k of ``tile`` (dimensions x vectors) for each row of ``queries``: lists of query, vector, score."""
    order = np.argsort(ids, kind="stable")  # ties go to smaller ids
    ids, tile = ids[order], tile[:, order]
    dims = tile.shape[0]
    starts = range(0, dims, step)
    squares = np.array([(tile[s : s + step] ** 2).sum(0) for s in starts])
    mass = np.sqrt(np.vstack((np.cumsum(squares[::-1], 0)[::-1], np.zeros((1, tile.shape[1])))))
    largest = np.abs(tile).max(initial=0.0)
    out: tuple[list, list, list] = ([], [], [])
    for q, q_id in zip(queries, q_ids, strict=True):
        q_squares = np.array([(q[s : s + step] ** 2).sum() for s in starts])
        q_mass = np.sqrt(np.concatenate((np.cumsum(q_squares[::-1])[::-1], [0.0])))
        rounded = np.abs(q).max(initial=0.0) * largest * dims >= _EXACT
        alive = np.flatnonzero(ids != q_id)
        score = np.zeros(len(alive))
        for i, s in enumerate(starts):
            rows = tile[s : s + step]
            score += q[s : s + step] @ (rows if len(alive) == rows.shape[1] else rows[:, alive])
            if len(alive) > k and (rounded or i + 1 < len(starts)):
                slack = q_mass[i + 1] * mass[i + 1][alive] * (1 + 1e-9) + 1e-6
                if rounded:
                    slack += q_mass[0] * mass[0][alive] * (dims * 2.0**-50)
                low = score - slack
                bar = np.partition(low, len(low) - k)[len(low) - k]
                keep = score + slack >= bar
                if keep.mean() < 0.8 or i + 1 == len(starts):
                    alive, score = alive[keep], score[keep]
        if rounded:
            found = exact_best(q[None, :], np.array([q_id]), tile[:, alive], ids[alive], k)
            for column, more in zip(out, found, strict=True):
                column.extend(more)
            continue
        top = np.argsort(-score, kind="stable")[:k]
        out[0].extend([q_id] * len(top))
        out[1].extend(ids[alive[top]].tolist())
        out[2].extend(int(x) for x in score[top])
    return out


def exact_best(queries: np.ndarray, q_ids: np.ndarray, tile: np.ndarray, ids: np.ndarray, k: int, scale: int = 1) -> tuple[list, list, list]:
    """The same in Python integers, floor(scale * x), for the few vectors whose sums doubles don't hold."""

    def whole(x: float) -> int:
        n, d = float(x).as_integer_ratio()  # exact, and no product overflows
        return scale * n // d

    out: tuple[list, list, list] = ([], [], [])
    cols = [[whole(x) for x in v] for v in tile.T]
    for q, q_id in zip(queries, q_ids, strict=True):
        mine = [whole(x) for x in q]
        scored = sorted((-sum(x * y for x, y in zip(mine, c, strict=True)), int(i)) for c, i in zip(cols, ids, strict=True) if i != q_id)[:k]
        out[0].extend([q_id] * len(scored))
        out[1].extend(i for _, i in scored)
        out[2].extend(max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in scored)
    return out


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of doubles, padded with zeros."""
    lengths = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, tile: int = TILE, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vec_id divisible by ``every`` its k best others."""
    arrow_batches(vectors.sparkSession, 10_000)
    rows = vectors.filter(sound(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    rows = stage(rows, "topk_vectors")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = int(dims or 0)
    most = TILE_VALUES // max(dims, 1)
    n_asked = asked.count()
    tile, block = (max(size, min(most, -(-count // TILES))) for size, count in ((tile, n), (block, n_asked)))
    tiles, blocks = max(1, -(-n // tile)), max(1, -(-n_asked // block))
    # Every block of queries meets every tile of rows: a key is one such meeting, bounded on both sides.
    data = rows.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(tiles)).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(False).alias("asks"), "vec_id", "v")
    asks = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("t"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"), F.lit(True).alias("asks"), "vec_id", "v")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ask = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        matrix = _matrix(table.column("v").chunk(0), dims) if len(table) else np.zeros((0, dims))
        q, q_ids, x, x_ids = matrix[ask], ids[ask], matrix[~ask], ids[~ask]
        q_large, x_large = (np.abs(m).max(1, initial=0.0) > _LARGE / SCALE for m in (q, x))
        small = [np.floor(SCALE * m) for m in (q[~q_large], x[~x_large])]
        found = [best_of(small[0], q_ids[~q_large], np.ascontiguousarray(small[1].T), x_ids[~x_large], k)]
        if x_large.any():
            found.append(exact_best(q[~q_large], q_ids[~q_large], x[x_large].T, x_ids[x_large], k, SCALE))
        if q_large.any():
            found.append(exact_best(q[q_large], q_ids[q_large], x.T, x_ids, k, SCALE))
        found = [sum(columns, []) for columns in zip(*found, strict=True)]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.int64())})

    near = data.unionByName(asks).groupBy("t", "b").applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
