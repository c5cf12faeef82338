"""Stupid-backoff scores, computed relationally.

Words, and pairs of words that follow one another, are counted over all documents, each by its 64-bit
hash: two count tables, partitioned by hash. A word scores count(v w) / count(v) after v if that pair was
counted often enough, else ALPHA times its own share of all words; the first word of a document scores
its share. The documents' pairs are exploded and dealt out by the same hash, joined to the part of the
count table there, and what they score is summed by document.

Rows of the same part travel packed in arrays. The commonest words and pairs (a share of all that is at
least one in so many, so that no more than so many exist) are tables in every task, whose counts are not
joined at all: no hot key is left to the shuffles. What depends on the count of a word outside that table
goes on to that word's part, where it is joined to the count.

Defined results for odd input: a null text is empty; a text without words has score 0 and a null mean;
every row is a document of its own, also where rows share a doc_id or have none, and comes once in the
result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, drop, stage
from .words import ODD, mix, word_hashes

ALPHA, MIN_COUNT = 0.4, 2
#: A pair that is at least one in so many is in a table that every task has.
HEAD = 1 << 18
#: Words that keep an identity, all others being one unknown word; None is every word.
VOCABULARY = None
#: Words at most whose counts are sent to every task.
TABLE = 1 << 16
#: Characters of text whose pairs make one part.
PART_CHARS = 16_000_000
#: Documents whose sums are added up in one task.
GROUP_DOCS = 10_000
_BLOCK_WORDS = 1 << 20
_BLOCK_PAIRS = 1 << 21
_UNKNOWN = np.uint64(0x5BD1E995)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * ODD[0] + w * ODD[1])


@dataclass
class Unigrams:
    """Hashes of the table's words, sorted, with ids in order of count; the last id is any other word."""

    hashes: np.ndarray
    ids: np.ndarray
    counts: np.ndarray  # by id
    total: int

    def of(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(words), len(self.counts) - 1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.ids[at], len(self.counts) - 1)

    def names(self) -> np.ndarray:
        """Hashes by id; the last is the unknown word's."""
        out = np.full(len(self.counts), _UNKNOWN)
        out[self.ids] = self.hashes
        return out


def unigrams(docs: DataFrame, table: int) -> tuple[Unigrams, DataFrame]:
    """Counts of all words of all documents: the commonest on the driver, and all as a staged table ``w, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            # The row without a word has the number of all words.
            keys = pa.array(np.append(w.view(np.int64), 0), mask=np.arange(len(w) + 1) == len(w))
            return pa.RecordBatch.from_arrays([keys, pa.array(np.append(n, n.sum()), pa.int64())], ["w", "n"])

        for batch in batches:
            pending.append(word_hashes(batch.column(0))[0])
            if sum(map(len, pending)) >= _BLOCK_WORDS:
                yield flush()
        if pending:
            yield flush()

    counts = stage(docs.select("text").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "word_counts")
    # Sizes of 16 classes of counts per doubling show from which count on the table is filled, so
    # that only about as many rows as it holds are sorted and sent.
    level = F.floor(F.log2("n") * 16).cast("long")
    least, seen = 0, 0
    for at, n in sorted((tuple(r) for r in counts.groupBy(level).count().collect()), reverse=True):
        least, seen = at, seen + n
        if seen > table:
            break
    rows = counts.filter(level >= least).orderBy(F.col("n").desc(), F.col("w").asc_nulls_first()).limit(table + 1).collect()
    total = next((r.n for r in rows if r.w is None), 0)
    rows = [r for r in rows if r.w is not None]
    hashes = np.array([r.w for r in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    known = [r.n for r in rows]
    return Unigrams(hashes[order], order.astype(np.int64), np.array([*known, total - sum(known)], np.int64), total), counts


@dataclass
class Pairs:
    """Pairs of words within a text: keys, whether a word of theirs is outside the table, ids and names of both
    words, and the text each is of; of all texts, the words' bounds, ids and names."""

    key: np.ndarray
    rare: np.ndarray
    ids: tuple[np.ndarray, np.ndarray]
    names: tuple[np.ndarray, np.ndarray]
    text: np.ndarray
    begin: np.ndarray
    word_ids: np.ndarray
    word_names: np.ndarray

    @classmethod
    def of(cls, words: Unigrams, apart: bool, texts: pa.StringArray) -> "Pairs":
        names, begin = word_hashes(texts)
        ids, other = words.of(names), len(words.counts) - 1
        if not apart:
            names = np.where(ids == other, _UNKNOWN, names)
        text = np.repeat(np.arange(len(texts)), np.diff(begin))
        at = np.flatnonzero(text[1:] == text[:-1])
        x, y, v, w = names[at], names[at + 1], ids[at], ids[at + 1]
        return cls(pair_hash(x, y), ((v == other) | (w == other)) & apart, (v, w), (x, y), text[at], begin, ids, names)


def part_of(key: np.ndarray, rare: np.ndarray, parts: int) -> np.ndarray:
    part = (key % np.uint64(parts)).astype(np.int64)
    return np.where(rare, -1 - part, part)


def split(part: np.ndarray, *lists: np.ndarray) -> Iterator[tuple]:
    """``part`` and what of each list belongs to it."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    if len(part):
        yield from zip(part[order][np.append(0, cut)].tolist(), *(np.split(x[order], cut) for x in lists), strict=True)


COUNTS = "part int, keys array<long>, n array<long>"


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["part", "keys", "n"])


def pair_counts(docs: DataFrame, words: Unigrams, apart: bool, parts: int, min_count: int) -> DataFrame:
    """The count table of pairs, partitioned by hash: a staged row ``part, keys, n`` for each part.

    Pairs with a word outside the table of words have (negative) parts of their own. Pairs counted fewer
    than ``min_count`` times are left out, as they back off.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, rare = (np.concatenate(c) for c in zip(*pending, strict=True))
            pending.clear()
            rows = []
            for apart_, some in ((True, key[rare]), (False, key[~rare])):
                some, n = np.unique(some, return_counts=True)
                rows += split(part_of(some, np.full(len(some), apart_), parts), some.view(np.int64), n)
            return _counts(rows)

        for batch in batches:
            pairs = Pairs.of(words, apart, batch.column(0))
            pending.append((pairs.key, pairs.rare))
            if sum(len(k) for k, _ in pending) >= _BLOCK_PAIRS:
                yield flush()
        if pending:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        keys, n = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "n"))
        keys, at = np.unique(keys.view(np.uint64), return_inverse=True)
        n = np.bincount(at, n, len(keys)).astype(np.int64)
        often = n >= min_count
        return pa.Table.from_batches([_counts([(table.column("part")[0].as_py(), keys[often].view(np.int64), n[often])])])

    return stage(docs.select("text").mapInArrow(count, COUNTS).groupBy("part").applyInArrow(add, COUNTS), "pair_counts")


def common_pairs(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and counts of the pairs counted ``least`` times or more."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = (batch.column(c).flatten().to_numpy() for c in (1, 2))
            if (n >= least).any():
                yield _counts([(0, keys[n >= least], n[n >= least])])

    rows = counts.filter("part >= 0").mapInArrow(often, COUNTS).collect()
    none = np.zeros(0, np.int64)
    keys, n = (np.concatenate([none, *(np.array(r[c], np.int64) for r in rows)]) for c in ("keys", "n"))
    keys = keys.view(np.uint64)
    order = np.argsort(keys)
    return keys[order], n[order]


def look_up(keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Counts of the keys ``asked`` in a sorted table; 0 if they aren't there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, n[at], 0)


def score(
    docs: DataFrame,
    alpha: float = ALPHA,
    vocabulary: int | None = VOCABULARY,
    head: int = HEAD,
    min_count: int = MIN_COUNT,
    part_chars: int = PART_CHARS,
    table: int = TABLE,
) -> DataFrame:
    """``doc_id, n_words, log_score, mean_log_score`` (natural logarithms) for every document."""
    arrow_batches(docs.sparkSession, 500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars, n_docs = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts, groups = max(64, -(-int(chars or 0) // part_chars)), max(8, n_docs // GROUP_DOCS)
    words, all_counts = unigrams(docs, table if vocabulary is None else vocabulary)
    size = len(words.counts)
    other = size - 1  # the id of words outside the table
    apart = vocabulary is None and words.counts[other] > 0  # such words have counts of their own
    log_c = np.log(np.maximum(words.counts, 1))
    if apart:
        log_c[other] = 0.0  # their log counts are added in resolve()
    else:
        drop(all_counts)
    alone = log_c - np.log(max(words.total, 1))
    names = words.names()
    pair_table = pair_counts(docs, words, apart, parts, max(min_count, 1))
    hot_keys, hot_n = common_pairs(pair_table, max(words.total / head, 1)) if head else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def pair_score(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(n >= min_count, np.log(np.maximum(n, 1)) - log_c[v], np.log(alpha) + alone[w])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part: pairs with their documents, by ids; under negative parts, pairs with words outside
        the table (``first`` and ``second``, hashes for such words and ids for others), and such words that
        begin a document (``first`` only); and what documents score without the count tables."""
        kinds = (pa.int32(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.int32()), pa.list_(pa.float64()))
        none, turn = np.zeros(0, np.int64), 0
        for batch in batches:
            doc = batch.column(0).to_numpy()
            if not len(doc):
                continue
            named = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(2).fill_null(0).to_numpy()
            pairs = Pairs.of(words, apart, batch.column(1))
            (v, w), of = pairs.ids, pairs.text
            filled = np.flatnonzero(np.diff(pairs.begin))
            start = pairs.begin[filled]
            own = np.zeros(len(doc))
            own[filled] = alone[pairs.word_ids[start]]
            n = np.where(pairs.rare, 0, look_up(hot_keys, hot_n, pairs.key))
            hot = n > 0
            own += np.bincount(of[hot], pair_score(v[hot], w[hot], n[hot]), len(doc))
            by_id = ~hot & ~pairs.rare
            # Repeats of a pair in a document are counted here.
            entry, one, n = np.unique(of[by_id] * (size * size) + v[by_id] * size + w[by_id], return_index=True, return_counts=True)
            part = part_of(pairs.key[by_id][one], np.zeros(len(one), bool), parts)
            rows = [(p, b, none, none, d, c, np.zeros(0)) for p, b, d, c in split(part, entry % (size * size), doc[entry // (size * size)], n)]
            if pairs.rare.any():
                # A word's id takes the place of its hash where it has one.
                rare = np.flatnonzero(pairs.rare)
                x, y = (np.where(i[rare] == other, h[rare], i[rare].astype(np.uint64)) for i, h in zip(pairs.ids, pairs.names, strict=True))
                in_, key = of[rare], pairs.key[rare]
                order = np.lexsort((key, in_))
                x, y, in_, key = x[order], y[order], in_[order], key[order]
                new = np.flatnonzero(np.append(True, (np.diff(in_) != 0) | (key[1:] != key[:-1])))
                n = np.diff(np.append(new, len(key)))
                part = part_of(key[new], np.ones(len(new), bool), parts)
                rows += [(p, none, x, y, d, c, np.zeros(0)) for p, x, y, d, c in split(part, x[new].view(np.int64), y[new].view(np.int64), doc[in_[new]], n)]
            if apart:
                begins = pairs.word_ids[start] == other
                x = pairs.word_names[start[begins]].view(np.int64)
                rows += [(p, none, x, none, d, c, np.zeros(0)) for p, x, d, c in split(-1 - x % parts, x, doc[filled[begins]], np.ones(len(x), np.int64))]
            length = np.diff(pairs.begin)
            # The doc_ids take the place of the words; rows without one are apart.
            rows += [(turn % parts, none, i, none, doc[m], length[m], own[m]) for m, i in ((named, ids[named]), (~named, none)) if m.any()]
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "pairs", "first", "second", "docs", "n", "own"])

    def flat(rows: pa.Table, c: str) -> np.ndarray:
        return rows.column(c).combine_chunks().flatten().to_numpy()

    def by_group(docs: np.ndarray, n: np.ndarray, s: np.ndarray, ids: np.ndarray | None = None) -> list[tuple]:
        """Sums by document stay packed: a row per group of documents, not per document."""
        docs_, one, at = np.unique(docs, return_index=True, return_inverse=True)
        total, lengths = np.bincount(at, s, len(docs_)), np.bincount(at, n, len(docs_)).astype(np.int64)
        ids = np.zeros(0, np.int64) if ids is None else ids[one]
        group = (docs_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order])) + 1
        return [(int(group[x[0]]), ids[x] if len(ids) else ids, docs_[x], lengths[x], total[x]) for x in np.split(order, cut) if len(x)]

    sums_schema = "group long, words array<long>, docs array<long>, n array<long>, s array<double>"

    def packed(rows: list[tuple]) -> pa.Table:
        kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.float64()))
        columns = zip(*rows, strict=True) if rows else [()] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["group", "words", "docs", "n", "s"])

    def meet(table: pa.Table, counts: pa.Table) -> pa.Table:
        """Join a part's pairs to their counts. Sums by document; and, under negative groups, how often a
        document takes the log count of a word."""
        table = table.combine_chunks()
        if not table.num_rows:
            return packed([])
        keys, key_n = flat(counts, "keys").view(np.uint64), flat(counts, "n")
        long = {c: pc.list_value_length(table.column(c)).to_numpy() > 0 for c in ("own", "pairs", "first", "second")}
        named = long["own"] & long["first"]
        named, mine, dealt, rare, start = (table.filter(pa.array(m)) for m in (named, long["own"] & ~named, long["pairs"], long["second"], long["first"] & ~long["second"] & ~long["own"]))
        del table
        pairs, n = flat(dealt, "pairs"), flat(dealt, "n")
        distinct, which = np.unique(pairs, return_inverse=True)
        v, w = distinct // size, distinct % size
        count = look_up(keys, key_n, pair_hash(names[v], names[w]))
        scored = [pair_score(v, w, count)[which] * n, flat(mine, "own")]
        docs_ = [flat(dealt, "docs"), flat(mine, "docs")]
        rest = [(flat(start, "first"), flat(start, "docs"), flat(start, "n").astype(float))]
        if rare.num_rows:
            x, y, n = flat(rare, "first").view(np.uint64), flat(rare, "second").view(np.uint64), flat(rare, "n")
            v, w = (np.minimum(c, np.uint64(other)).astype(np.int64) for c in (x, y))
            count = look_up(keys, key_n, pair_hash(*(np.where(i == other, c, names[i]) for i, c in ((v, x), (w, y)))))
            scored.append(pair_score(v, w, count) * n)
            docs_.append(flat(rare, "docs"))
            often = count >= min_count
            for taken, hashes, sign in ((often & (v == other), x, -1.0), (~often & (w == other), y, 1.0)):
                rest.append((hashes[taken].view(np.int64), docs_[-1][taken], sign * n[taken]))
        lengths = np.concatenate([np.zeros(len(docs_[0])), flat(mine, "n"), *(np.zeros(len(x)) for x in docs_[2:])])
        rows = by_group(np.concatenate(docs_), lengths, np.concatenate(scored))
        rows += by_group(flat(named, "docs"), flat(named, "n"), flat(named, "own"), flat(named, "first"))
        at, of, times = (np.concatenate(c) for c in zip(*rest, strict=True))
        order = np.argsort(at % parts, kind="stable")
        cut = np.flatnonzero(np.diff((at % parts)[order])) + 1
        rows += [(-1 - int(at[x[0]] % parts), at[x], of[x], np.zeros(0, np.int64), times[x]) for x in np.split(order, cut) if len(x)]
        return packed(rows)

    def resolve(rest: pa.Table, counts: pa.Table) -> pa.Table:
        """Sums by document of the log counts that ``rest`` asks for."""
        if not rest.num_rows:
            return packed([])
        w, n = counts.column("w").to_numpy(), counts.column("n").to_numpy()
        order = np.argsort(w)
        asked = flat(rest, "words")
        log_n = np.log(n[order][np.searchsorted(w[order], asked)])
        return packed(by_group(flat(rest, "docs"), np.zeros(len(asked)), flat(rest, "s") * log_n))

    def add(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        doc, n, s = (flat(table, c) for c in ("docs", "n", "s"))
        rows, at = np.unique(doc, return_inverse=True)
        named = table.filter(pa.array(pc.list_value_length(table.column("words")).to_numpy() > 0))
        ids, known = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        place = np.searchsorted(rows, flat(named, "docs"))
        ids[place], known[place] = flat(named, "words"), True
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": pa.array(np.bincount(at, n, len(rows)).astype(np.int64)), "log_score": pa.array(np.bincount(at, s, len(rows)))})

    docs = docs.select(F.monotonically_increasing_id().alias("row"), "text", "doc_id")
    blocks = docs.mapInArrow(deal, "part int, pairs array<long>, first array<long>, second array<long>, docs array<long>, n array<int>, own array<double>")
    sums = blocks.groupBy("part").cogroup(pair_table.groupBy("part")).applyInArrow(meet, sums_schema)
    if apart:
        sums = stage(sums, "backoff_sums")
        drop(pair_table)
        least = int(words.counts[:other].min()) if other else words.total
        counts = all_counts.filter(F.col("w").isNotNull() & (F.col("n") <= least)).withColumn("group", -1 - F.pmod("w", F.lit(parts)))
        found = sums.filter("group < 0").groupBy("group").cogroup(counts.groupBy("group")).applyInArrow(resolve, sums_schema)
        sums = sums.filter("group >= 0").unionByName(found)
    out = sums.groupBy("group").applyInArrow(add, "doc_id long, n_words long, log_score double")
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
