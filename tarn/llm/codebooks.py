"""Compression of vectors to codes: product quantisation, its k-means rounds by Exponion search in whole numbers.

A vector's components become integers and its row is cut into PARTS parts; a part position has a codebook of at
most ENTRIES entries. The search for a part's nearest entry begins at the entry that it had before, at the exact squared
distance d. No entry farther than 2 * sqrt(d) from that one can be as near, so only the entries of its distance-sorted list
of neighbours with a squared distance of at most 4 * d are looked at; of equally near ones the lowest index wins.

A round is one pass: tasks read vectors with their codes, write both again with the new codes, and add the sums of the
parts of each entry, at most PARTS * ENTRIES rows a task. Those sums are added up by entry on the executors; the driver gets
a row per entry. Integers whose distances fit 64 bits are NumPy's, greater ones Python's, so all sums are exact.

Defined results for odd input: a shorter vector counts as padded with zeros, and if 8 doesn't divide the longest one's length, all are padded; an entry's
vectors are those of the smallest vec_ids, rows without one last, rows that share one by their vectors; with fewer rows
than entries, a codebook has as many entries as there are rows; every row is a row of the result; errors beyond 64 bits
are held at the largest long; an empty table, or one without any usable vector, gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop, stage
from .topk import sound

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose totals are broadcast at most; more are joined.
FEW_LABELS = 100_000
LONGEST = (1 << 63) - 1


def integers(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """floor(SCALE * x) by row, padded to ``dims``; int64 where squared distances fit 64 bits, else Python's integers."""
    lengths = vectors.value_lengths().to_numpy()
    inside = np.arange(dims)[None, :] < lengths[:, None]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if np.abs(flat).max(initial=0.0) < (2.0**60 / max(dims, 1)) ** 0.5 / SCALE:
        out = np.zeros((len(vectors), dims), np.int64)
        out[inside] = np.floor(flat * SCALE).astype(np.int64)
    else:
        out = np.zeros((len(vectors), dims), object)
        # A double is a ratio of whole numbers, so that no product is rounded or overflows.
        ratios = [x.as_integer_ratio() for x in flat.tolist()]
        values = np.empty(len(ratios), object)
        values[:] = [SCALE * n // d for n, d in ratios]
        out[inside] = values
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def exponion(x: np.ndarray, book: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x`` and its squared distance; the search starts at ``before``."""
    if book.dtype != x.dtype:
        x, book = x.astype(object), book.astype(object)
    code, near = before.copy(), squared(x, book[before])
    for a in range(len(book)):
        rows = np.flatnonzero(before == a)
        if not len(rows):
            continue
        gaps = squared(book, book[a])
        others = [e for e in sorted(range(len(book)), key=lambda e: (gaps[e], e)) if e != a]
        # How far down the sorted neighbours each row must look: the radius of its own distance.
        look = np.searchsorted(np.array([gaps[e] for e in others], x.dtype), 4 * near[rows], side="right")
        order = np.argsort(-look, kind="stable")
        rows, look = rows[order], look[order]
        best, at = near[rows].copy(), np.full(len(rows), a)
        for k, e in enumerate(others):
            n = int(np.searchsorted(-look, -k, side="left"))  # rows that look at more than k neighbours
            if not n:
                break
            d = squared(x[rows[:n]], book[e])
            wins = (d < best[:n]) | ((d == best[:n]) & (e < at[:n]))
            best[:n][wins] = d[wins]
            at[:n][wins] = e
        near[rows], code[rows] = best, at
    return code, near


def assign(rows: np.ndarray, books: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all parts of all rows, and squared distances summed over parts."""
    width = rows.shape[1] // PARTS
    out, errors = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), object if rows.dtype == object else np.int64)
    for p, book in enumerate(books):
        out[:, p], near = exponion(rows[:, p * width : (p + 1) * width], book, codes[:, p].astype(np.int64))
        errors = errors + near
    return out, errors


def moved(books: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> list[np.ndarray]:
    """Entries at the floored means of their parts; unused ones stay."""
    out = []
    for p, book in enumerate(books):
        rows = [[s // sums[p, e][0] for s in sums[p, e][1]] if (p, e) in sums else book[e].tolist() for e in range(len(book))]
        out.append(_book(rows))
    return out


def _book(rows: list[list[int]]) -> np.ndarray:
    """int64 if all distances to it fit 64 bits."""
    most = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if most * most * 4 * max(len(rows[0]), 1) * PARTS < 1 << 62 else object).reshape(len(rows), -1)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def _round(books: list[np.ndarray], dims: int):
    """A task of a round: rows with their new codes, then the sums of its parts by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = {}, {}
        for batch in batches:
            vectors, codes = batch.column(0), _codes(batch.column(1))
            rows = integers(vectors, dims)
            new, _ = assign(rows, books, codes)
            width = dims // PARTS
            for p in range(PARTS):
                part = rows[:, p * width : (p + 1) * width]
                for e in np.unique(new[:, p]).tolist():
                    own = new[:, p] == e
                    count[p, e] = count.get((p, e), 0) + int(own.sum())
                    # A batch's sums fit 64 bits, as its squared distances do; across batches they are Python's.
                    sums[p, e] = [a + int(b) for a, b in zip(sums.get((p, e), [0] * width), part[own].sum(0), strict=True)]
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [vectors, pa.array([c.tobytes() for c in new], pa.binary()), batch.column(2), batch.column(3), none, none, pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.string())], NAMES
            )
        keys = sorted(sums)
        n = len(keys)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, vectors.type), pa.nulls(n, pa.binary()), pa.nulls(n, batch.column(2).type), pa.nulls(n, batch.column(3).type),
                    pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64()), pa.array([",".join(map(str, sums[k])) for k in keys], pa.string()),
                ],
                NAMES,
            )

    return run


NAMES = ["v", "codes", "vec_id", "label", "part", "entry", "n", "sums"]


def _codes(column: pa.BinaryArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS)


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one entry: counts and sums of all tasks."""
    columns = zip(*([int(v) for v in s.split(",")] if s else [] for s in rows["sums"]), strict=True)
    return pd.DataFrame({"part": rows["part"][:1], "entry": rows["entry"][:1], "n": [int(rows["n"].sum())], "sums": [",".join(str(sum(c)) for c in columns)]})


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Staged ``v, codes, vec_id, label, error`` of every usable vector, and the codebooks, by part position."""
    spark = embeddings.sparkSession
    arrow_batches(spark, 10_000)
    kept = embeddings.filter(sound(F.col("embedding"))).select(F.col("embedding").cast("array<double>").alias("v"), F.unhex(F.lit("00" * PARTS)).alias("codes"), "vec_id", "label")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    dims = -(-longest // PARTS) * PARTS
    schema = "v array<double>, codes binary, " + ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    if not first:
        return stage(kept.withColumn("error", F.lit(0).cast("long")), "codes"), []
    start = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dims).tolist()
    width = dims // PARTS
    books = [_book([r[p * width : (p + 1) * width] for r in start]) for p in range(PARTS)]
    rows = stage(kept, "codes")
    for _ in range(rounds):
        done = stage(rows.mapInArrow(_round(books, dims), f"{schema}, part int, entry int, n long, sums string"), "codes")
        drop(rows)
        totals = done.filter(F.col("part").isNotNull()).select("part", "entry", "n", "sums")
        found = totals.groupBy("part", "entry").applyInPandas(_total, "part int, entry int, n long, sums string").collect()
        books = moved(books, {(r["part"], r["entry"]): (r["n"], [int(v) for v in r["sums"].split(",")] if r["sums"] else []) for r in found})
        rows = done.filter(F.col("part").isNull()).select("v", "codes", "vec_id", "label")
        rows._scratch = done._scratch

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, errors = assign(integers(batch.column(0), dims), books, _codes(batch.column(1)))
            errors = pa.array([min(int(x), LONGEST) for x in errors], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in new], pa.binary()), batch.column(2), batch.column(3), errors], [*NAMES[:4], "error"])

    out = stage(rows.mapInArrow(last, f"{schema}, error long"), "codes")
    drop(rows)
    return out, books


def codes(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for every usable vector."""
    rows, books = compress(embeddings)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = stage(rows.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    side = F.broadcast(by_label) if by_label.count() <= FEW_LABELS else by_label
    out = rows.join(side, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
