"""Exact Jaccard join of documents on word shingles, by size-banded tiles with bitmap signatures.

Equal sets are one class. Two sets that link must share a shingle among the first ones of each (a
quarter of a set, in one global order that puts shingles of crowded sketch cells last), so sets meet in
tiles by such shingles. In a tile, sets are sorted by size and each is held only against its band of
sizes; the differing bits of two hashed parity bitmaps bound the overlap from above, and what remains
is decided by intersecting the sorted shingle arrays.

Rounds keep groups of near copies from being expanded into pairs. First each set is in one tile a shingle,
and proposes only the partner that its bitmap finds nearest; what the exact test links becomes one
component. Then one set stands for its component under each shingle, and does the same; it joins what lay
in different tiles. Pairs within a component need no test, and a large component has tiles of
its own, which never meet one another; so the last round, which tests every other pair, has few left, and
a group of near copies costs as many rows as it has, not their square.

Defined results for odd input: a null text is empty; a text without words has no shingles and links
with nothing; with fewer words than a shingle, the whole sequence is the one shingle; repeated rows
are equal sets; every row is compared by its own text, also where rows share a doc_id or have none, and
comes once in the result; a component without any doc_id has a null one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, drop, keyed, shuffle_partitions, stage
from .components import components
from .words import ODD, mix, word_hashes

#: Sets link when SHARE[1] * overlap >= SHARE[0] * union.
SHARE, SHINGLE = (75, 100), 5
SKETCH_BITS, TILE, BROADCAST_IDS = 20, 1024, 500_000


def shingle_sets(texts: pa.StringArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first_word = word_hashes(texts)
    n = len(words)
    runs = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        runs += words[k : n - size + 1 + k] * ODD[k] if n >= size else 0
    runs = mix(runs)
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True):
        if b - a >= size:
            h = np.sort(runs[a : b - size + 1])
            yield h[np.append(True, h[1:] != h[:-1])]
        elif b > a:
            yield mix(np.array([(words[a:b] * ODD[100 : 100 + b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, share: tuple[int, int] = SHARE) -> int:
    """A set of n that links with another has one of its first so many shingles in common with it."""
    return n + (-n * share[0] // share[1]) + 1


def index_length(n: int, share: tuple[int, int] = SHARE) -> int:
    """The same for the smaller set of a pair."""
    return n + (-2 * share[0] * n // (share[0] + share[1])) + 1


def bitmap(h: np.ndarray) -> bytes:
    """Parity of the hashes' low bits; wide enough for the set, a power of two."""
    width = bitmap_width(len(h))
    return np.packbits((np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def bitmap_width(n: int) -> int:
    return 1 << min(16, max(8, int(2 * n - 1).bit_length()))


def crowded(docs: DataFrame, size: int) -> np.ndarray:
    """A level for each of 2**SKETCH_BITS cells of hashes: 0, or how far its count is above the mean.

    All shingles of all documents count. Cells are added up on the executors; what reaches the driver
    is the finished sketch, of a fixed size.
    """
    cells, part = 1 << SKETCH_BITS, 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(cells, np.int64)
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), size))
            if sets:
                sums += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(cells // part), pa.int32()), pa.array(list(sums.reshape(-1, part)), pa.list_(pa.int64()))], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        n = table.column("n").combine_chunks().flatten().to_numpy().reshape(-1, part).sum(0)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": pa.array([n], pa.list_(pa.int64()))})

    rows = docs.select("text").mapInArrow(count, "part int, n array<long>").groupBy("part").applyInArrow(add, "part int, n array<long>").collect()
    sums = np.zeros((cells // part, part))
    for r in rows:
        sums[r.part] = r.n
    usual = 4 * sums.mean() + 16
    return np.floor(np.log2(np.maximum(sums.reshape(-1) / usual, 1))).astype(np.uint8)


def summaries(docs: DataFrame, levels: np.ndarray, size: int, share: tuple[int, int]) -> DataFrame:
    """``doc_id, n, k1, k2, prefix``: set size, a 128-bit digest of the set, its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, prefix = [], [], [], []
            for h in shingle_sets(batch.column(1), size):
                n.append(len(h))
                k1.append(int(mix(h).sum(dtype=np.uint64)))
                k2.append(int(mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).sum(dtype=np.uint64)))
                lv = levels[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                h = h[np.argsort(lv, kind="stable")] if lv.any() else h
                prefix.append(h[: prefix_length(len(h), share)].view(np.int64) if len(h) else h.view(np.int64))
            ends = np.cumsum([0] + [len(p) for p in prefix])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            signed = [pa.array(np.array(k, np.uint64).view(np.int64)) for k in (k1, k2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *signed, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n", "k1", "k2", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``id, n, bits``: sizes and bitmaps of the documents' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([bitmap(h) for h in sets], pa.binary())],
                ["id", "n", "bits"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "id long, n long, bits binary")


def arrays(docs: DataFrame, size: int) -> DataFrame:
    """``id, hashes``: the documents' sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in shingle_sets(batch.column(1), size)], pa.binary())], ["id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, hashes binary")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmap rows of 64-bit words folded to ``width`` bits: parities of halves add up."""
    while bits.shape[1] * 64 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def may_link(n_a, n_b, differing, share: tuple[int, int]):
    """Whether an overlap of (n_a + n_b - differing) / 2, the most that the bitmaps allow, would link."""
    return (n_a + n_b - differing) * (share[0] + share[1]) >= 2 * share[0] * (n_a + n_b)


def tile_pairs(n: np.ndarray, bits: list[bytes], index: np.ndarray, component: np.ndarray, share: tuple[int, int], nearest: bool = False, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a tile that are in one band, not yet in one component, and not ruled out by their bitmaps.

    With ``nearest``, only the pair that looks most alike for each set that has any.
    """
    order = np.argsort(n, kind="stable")
    n, index, component = n[order], index[order], component[order]
    widths = np.array([len(bits[i]) * 8 for i in order])
    out_a, out_b, out_d = [], [], []
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        lo = own[0]
        # The band above the smallest of this width reaches into the next width at most, folded here.
        hi = np.searchsorted(n, n[own[-1]] * share[1] // share[0], "right")
        rows = np.vstack([fold(np.frombuffer(bits[order[i]], np.uint64)[None, :], width) for i in range(lo, hi)])
        for s in range(lo, own[-1] + 1, step):
            e = min(s + step, own[-1] + 1)
            top = np.searchsorted(n, n[e - 1] * share[1] // share[0], "right")
            if top <= s + 1:
                continue
            can = (component[s:e, None] != component[None, s:top]) & index[s:e, None]
            can &= n[None, s:top] * share[0] <= n[s:e, None] * share[1]
            can &= np.arange(s, top)[None, :] > np.arange(s, e)[:, None]
            a, b = np.nonzero(can)
            for c in range(0, len(a), 1 << 15):
                x, y = a[c : c + (1 << 15)] + s, b[c : c + (1 << 15)] + s
                apart = np.bitwise_count(rows[x - lo] ^ rows[y - lo]).sum(1, dtype=np.int64)
                fine = may_link(n[x], n[y], apart, share)
                out_a.append(order[x[fine]])
                out_b.append(order[y[fine]])
                out_d.append(apart[fine] / (n[x[fine]] + n[y[fine]]))
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
    if nearest and len(a):
        by = np.argsort(np.concatenate(out_d), kind="stable")
        a, b = a[by], b[by]
        best = np.unique(np.unique(np.stack((a, b), 1).reshape(-1), return_index=True)[1] // 2)
        a, b = a[best], b[best]
    return a, b


def verify(pairs: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` that link, by intersecting their sorted arrays."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                overlap = int((both[1:] == both[:-1]).sum())
                fine.append(share[1] * overlap >= share[0] * (len(both) - overlap))
            fine = np.array(fine, bool)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[fine]), pa.array(batch.column(1).to_numpy()[fine])], ["a", "b"])

    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"hashes_{k}")) for k in ("a", "b"))
    wide = pairs.join(left, "a").join(right, "b")
    return wide.select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, "a long, b long")


def own_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """``token, i, j, salt, id, n, index, c``: every set in one tile of about ``tile`` sets of its token, which has ``g``."""
    salt = F.pmod(F.xxhash64("id", "token"), F.ceil(F.col("g") / tile)).cast("int")
    return rows.select("token", salt.alias("i"), salt.alias("j"), salt.alias("salt"), "id", "n", "index", "c")


def all_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """The same for tokens that have more than one component: every two tiles but those of one large component.

    Tokens with no more than ``tile`` sets are one tile.
    """
    tokens = rows.groupBy("token").agg(F.count("*").alias("g"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("token", "g")
    tokens = stage(tokens, "jaccard_tokens")
    rows = rows.select("token", "id", "n", "index", "c").join(tokens, "token")
    zero = [F.lit(0).alias(k) for k in ("i", "j", "salt")]
    one = rows.filter(F.col("g") <= tile).select("token", *zero, "id", "n", "index", "c")
    if tokens.filter(F.col("g") > tile).isEmpty():
        return one
    rows = rows.filter(F.col("g") > tile).drop("g")
    sizes = stage(rows.groupBy("token", "c").agg(F.count("*").alias("m")), "jaccard_sizes")
    own = F.when(F.col("m") > tile, F.ceil(F.col("m") / tile))
    before = Window.partitionBy("token").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    large = sizes.filter(F.col("m") > tile).withColumn("own", own.cast("int"))
    large = large.select("token", "c", "own", F.coalesce(F.sum("own").over(before), F.lit(0)).cast("int").alias("start"))
    shared = F.ceil(F.coalesce(F.sum(F.when(F.col("m") <= tile, F.col("m"))), F.lit(0)) / tile).cast("int")
    counts = sizes.groupBy("token").agg(shared.alias("shared"), F.coalesce(F.sum(own), F.lit(0)).cast("int").alias("more"))
    rows = rows.join(counts, "token").join(large, ["token", "c"], "left")
    # Tiles of small components come first, then those of each large one.
    first, last = F.col("shared") + F.col("start"), F.col("shared") + F.col("more") - 1
    rows = rows.withColumn("salt", F.when(F.col("own").isNull(), F.pmod(F.xxhash64("id"), F.col("shared"))).otherwise(first + F.pmod(F.xxhash64("id"), F.col("own"))).cast("int"))
    none = F.array().cast("array<int>")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    others = F.when(F.col("own").isNull(), span(F.lit(0), last)).otherwise(F.concat(span(F.lit(0), first - 1), span(first + F.col("own"), last)))
    rows = rows.withColumn("other", F.explode(others))
    return one.unionByName(rows.select("token", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "id", "n", "index", "c"))


def meetings(rows: DataFrame, bits: DataFrame, share: tuple[int, int], nearest: bool, buckets: int) -> DataFrame:
    """Pairs ``a, b`` to verify, of rows ``token, i, j, salt, id, n, index, c`` and the sets' ``id, bits``.

    Tiles that are the first of their tokens only share one of ``buckets`` groups with others.
    """

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        token, i, j, salt, ids, n, index, c = (table.column(k).to_numpy() for k in ("token", "i", "j", "salt", "id", "n", "index", "c"))
        bits = table.column("bits").to_pylist()
        order = np.lexsort((j, i, token))
        new = np.flatnonzero((np.diff(token[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        pairs = []
        for at in np.split(order, new):
            x, y = tile_pairs(n[at], [bits[r] for r in at], index[at], c[at], share, nearest)
            across = (i[at[0]] == j[at[0]]) | (salt[at[x]] != salt[at[y]])
            pairs.append(np.stack((ids[at[x]], ids[at[y]]))[:, across])
        both = np.unique(np.sort(np.concatenate(pairs, 1), 0), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    key = F.when(F.col("j") == 0, F.pmod(F.xxhash64("token"), F.lit(buckets))).otherwise(F.xxhash64("token", "i", "j"))
    return rows.join(bits, "id").withColumn("key", key).groupBy("key").applyInArrow(meet, "a long, b long").distinct()


def join(docs: DataFrame, share: tuple[int, int] = SHARE, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; a component's id is its least doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return join_rows(keyed(docs), share, size, tile).select("doc_id", "n_shingles", "component_id")


def join_rows(rows: DataFrame, share: tuple[int, int] = SHARE, size: int = SHINGLE, tile: int = TILE, key: str = "_row") -> DataFrame:
    """``key, doc_id, n_shingles, component_id, first`` for every row of ``keyed``; ``first`` is true for one
    row of each component, that of the least doc_id (nulls last), then key."""
    arrow_batches(rows.sparkSession, 500)
    names = rows.select(key, F.col("doc_id").cast("long").alias("doc_id"))
    # From here to the components, a row's key is its id.
    docs = rows.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = crowded(docs, size)
    wide = stage(summaries(docs, levels, size, share), "jaccard_sets")
    classes = wide.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id"), F.min_by("prefix", "doc_id").alias("prefix"))
    classes = stage(classes.select("id", "n", "prefix"), "jaccard_classes")
    sums = stage(wide.drop("prefix"), "jaccard_sums")
    drop(wide)
    # Sets that meet: rows of shingles that two classes have among their first. Counts are added up before
    # they move, and joined back, so no shingle's rows are gathered; rows are two numbers each until then.
    first = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    index = F.col("n") - F.ceil(F.lit(2 * share[0]) * F.col("n") / F.lit(share[0] + share[1])) + 1
    first = first.select("token", (F.col("id") * 2 + (F.col("pos") < index).cast("long")).alias("packed"))
    low = (1 << 32) - 1
    several = first.groupBy("token").agg(F.sum(1 + F.col("packed").bitwiseAND(1) * (low + 1)).alias("sum"))
    several = several.select("token", F.col("sum").bitwiseAND(low).alias("g"), F.shiftright("sum", 32).alias("late")).filter("g > 1 and late > 0").drop("late")
    groups = first.join(several, "token").select("token", F.shiftright("packed", 1).alias("id"), (F.col("packed").bitwiseAND(1) == 1).alias("index"), "g")
    groups = stage(groups.join(classes.select("id", "n"), "id"), "jaccard_groups")
    drop(classes)
    # Shingles of one passage bring the same sets together again and again; one tile of each kind is enough.
    member = [F.bit_xor(F.xxhash64(F.lit(k), "id", "index")).alias(f"m{k}") for k in (1, 2)]
    kinds = groups.groupBy("token", "g").agg(*member).groupBy("g", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    tiles = stage(groups.join(kinds, "token"), "jaccard_tiles")
    drop(groups)
    buckets = max(4 * shuffle_partitions(docs.sparkSession), tiles.count() // 20_000)
    signs = stage(signatures(only(docs, stage(tiles.select("id").distinct(), "jaccard_ids")), size), "jaccard_signatures")
    bits = signs.select("id", "bits")

    # First every set is alone.
    pairs = stage(meetings(own_tiles(tiles.withColumn("c", F.col("id")), tile), bits, share, True, buckets), "jaccard_pairs")
    # Sets without any proposal now have none later either, unless a shingle of theirs has further tiles.
    crowd = tiles.filter(F.col("g") > tile).select("id")
    involved = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowd).distinct(), "jaccard_ids")
    sets = stage(arrays(only(docs, involved), size), "jaccard_arrays")
    old, tiles = tiles, stage(tiles.join(involved, "id"), "jaccard_tiles")
    drop(old)
    parts = components(stage(verify(pairs, sets, share), "jaccard_links"))
    # Then one set stands for its component under each shingle, with its nearest partner; last, all pairs of sets.
    for alone in (True, False):
        named = tiles.join(parts, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        if alone:
            one = F.min_by(F.struct("id", "n", "index"), F.struct((~F.col("index")).alias("late"), "n", "id"))
            named = named.groupBy("token", "c").agg(one.alias("one")).select("token", "c", "one.*")
        named = stage(named.select("token", "id", "n", "index", "c"), "jaccard_named")
        pairs = stage(meetings(all_tiles(named, tile), bits, share, alone, buckets), "jaccard_pairs")
        drop(named)
        if not pairs.isEmpty():
            links = stage(verify(pairs, sets, share), "jaccard_links")
            parts = components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links))
    known = sums.filter("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("id")).join(parts, "id", "left")
    known = known.select("n", "k1", "k2", F.coalesce("component", "id").alias("c"))
    found = sums.select("doc_id", "n", "k1", "k2").join(known, ["n", "k1", "k2"], "left")
    found = found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("c")).join(names, key)
    found = stage(found, "jaccard_found")
    best = found.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("best"))
    return found.join(best, "c").select(key, "doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col(key) == F.col(f"best.{key}")).alias("first"))


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with one of the staged ``ids``; these are broadcast only while few."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.withColumnRenamed("id", "doc_id")
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
