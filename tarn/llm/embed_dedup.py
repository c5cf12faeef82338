"""Near duplicates among embeddings, by int8 tile products with rigorous error bounds.

Vectors of a label are dealt into tiles, and every two tiles of a label meet once. A vector's unit form
is stored as int8 with one scale, and with the exact length of what that rounding lost. The product of
two int8 vectors, plus a bound from both losses, is at least their cosine; only pairs whose bound
reaches the threshold are computed again in double precision.

Equal vectors are one class and are never expanded into pairs. A meeting of tiles returns each class's
count of links and a spanning forest of the links, so its result grows with the tiles, not with pairs.
Tiles grow with their label up to a bounded size, so that a label's vectors are copied rarely.

Defined results for odd input: vectors that are null, zero, or hold null or non-finite components, and
those with a null label, link with nothing and are kept; a shorter vector counts as padded with zeros;
every row is compared by its own vector, also where rows share a vec_id or have none, and comes once in
the result; a component without any vec_id has a null one, and its rows without one are kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stage
from .components import components, forest
from .topk import sound

THRESHOLD, TILE = 0.98, 2048
#: Components of a tile at most, and tiles that a label has before they grow.
TILE_VALUES, TILES = 1 << 20, 32
#: More than the rounding of a double-precision cosine.
MARGIN = 1e-9
_EXACT_DIMS = 1024  # products of int8 vectors stay exact in float32 up to so many dimensions


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the lengths of the scaled int8 rows and of the losses."""
    scale = np.abs(unit).max(1, initial=0.0) / 127
    scale[scale == 0] = 1
    q = np.rint(unit / scale[:, None])
    kept = q * scale[:, None]
    return q.astype(np.int8), scale, np.linalg.norm(kept, axis=1), np.linalg.norm(unit - kept, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for s in range(0, a.shape[1], _EXACT_DIMS):
        out += a[:, s : s + _EXACT_DIMS].astype(np.float32) @ b[:, s : s + _EXACT_DIMS].astype(np.float32).T
    return out


def links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float, step: int = 256):
    """Yield ``rows, columns`` of links between two tiles of unit rows; each pair once if they are the same."""
    qx, sx, kx, lx = quantise(x)
    qy, sy, ky, ly = quantise(y)
    for s in range(0, len(x), step):
        e = min(s + step, len(x))
        near = product(qx[s:e], qy) * sx[s:e, None] * sy[None, :]
        near += kx[s:e, None] * ly[None, :] + lx[s:e, None] * (1 + MARGIN)
        rows, cols = np.nonzero(near >= threshold - MARGIN)
        if same:
            rows, cols = rows[cols > rows + s], cols[cols > rows + s]
        if len(rows) * 8 > near.size:  # dense: one product in full precision
            sure = (x[s:e] @ y.T)[rows, cols] >= threshold
        else:
            sure = np.zeros(len(rows), bool)
            for c in range(0, len(rows), 1 << 14):
                sure[c : c + (1 << 14)] = np.einsum("ij,ij->i", x[s + rows[c : c + (1 << 14)]], y[cols[c : c + (1 << 14)]]) >= threshold
        yield rows[sure] + s, cols[sure]


def _units(vectors: pa.ListArray, dims: int) -> np.ndarray:
    lengths = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    arrow_batches(vectors.sparkSession, 10_000)
    fine = F.col("label").isNotNull() & sound(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(fine, F.col("embedding")).alias("v"))
    zero = F.lit(0.0).cast(rows.schema["v"].dataType.elementType)
    rows = rows.withColumn("v", F.transform("v", lambda x: x + zero))  # -0.0 and 0.0 are one value
    rows = stage(rows.withColumns({"_row": F.monotonically_increasing_id(), "h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "embed_rows")
    # A class is a label's equal vectors; its id is the number of one of its rows.
    classes = rows.filter("v is not null").groupBy("label", "h", "h2", "v").agg(F.min("_row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stage(classes, "embed_classes")
    dims = int(classes.agg(F.max(F.size("v"))).first()[0] or 0)
    most = max(tile, TILE_VALUES // max(dims, 1))
    size = F.greatest(F.lit(tile), F.least(F.lit(most), F.ceil(F.count("*") / TILES)))
    tiles = classes.groupBy("label").agg(F.ceil(F.count("*") / size).cast("int").alias("tiles"))
    dealt = classes.join(tiles, "label").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", F.least("t", "p").alias("i"), F.greatest("t", "p").alias("j"), "t", "id", "n", "v")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        t, ids, n = (table.column(c).to_numpy() for c in ("t", "id", "n"))
        unit = _units(table.column("v").chunk(0), dims)
        left, right = np.flatnonzero(t == i), np.flatnonzero(t == j)
        count = np.zeros(len(ids), np.int64)
        tree_a, tree_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows, cols in links(unit[left], unit[right], i == j, threshold):
            a, b = left[rows], right[cols]
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
            tree_a, tree_b = forest(np.concatenate((tree_a, ids[a])), np.concatenate((tree_b, ids[b])))
        some = np.flatnonzero(count)
        return pa.table(
            {
                "a": pa.array(np.concatenate((ids[some], tree_a)), pa.int64()),
                "b": pa.array(np.concatenate((np.full(len(some), -1), tree_b)), pa.int64(), mask=np.arange(len(some) + len(tree_a)) < len(some)),
                "n": pa.array(np.concatenate((count[some], np.zeros(len(tree_a), np.int64))), pa.int64()),
            }
        )

    met = stage(dealt.groupBy("label", "i", "j").applyInArrow(meet, "a long, b long, n long"), "embed_links")
    counts = met.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    groups = components(met.filter("b is not null"))
    known = classes.drop("v").join(counts, "id", "left").join(groups, "id", "left").withColumn("c", F.coalesce("component", "id"))
    known = stage(known.select("label", "h", "h2", "c", "least", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "embed_known")
    names = known.groupBy("c").agg(F.min("least").alias("component_id"))
    known = known.join(names, "c").select("label", "h", "h2", "n_links", "component_id")
    # A class is found again by 128 bits of its vector; rows that link with nothing need not move.
    linked = rows.filter("v is not null").join(known, ["label", "h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
