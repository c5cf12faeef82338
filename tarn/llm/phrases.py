"""Collocations: phrases of two to five words, their counts, and how much more often their parts meet than by chance.

Passes over whole texts, none of which gathers a text or a key anywhere:

1. A sketch counts words and pairs by hash. A cell's count is at least that of each sequence in it, so a sequence in a cell
   below the threshold is out.
2. A second sketch counts three to five words where all pairs in them passed, as no sequence is more frequent than its pairs.
3. Sequences whose cells all passed are the candidates, distinct by language; few of them are wrong, none is missing.
4. Candidates are compiled into automata, a bounded number of phrases in each. A text is rewritten as words between single
   blanks, with a mark between pieces; patterns have the blanks on both sides, so they match whole words of one piece only.
   Every match counts, overlapping ones too, and counts are summed over tasks.

What remains is relational: exact counts against the threshold, cuts joined to the counts of their parts, phrases inside longer ones.

A sketch's cells grow with the corpus up to ``MOST_BITS``; beyond that bounds are looser, candidates more, and results the same. Words are
told apart by 64-bit hashes until they are candidates; from there on by their text.

Defined results for odd input: null and empty texts and empty pieces hold no words; a null language is ``und``, one called so is the same; repeated
rows count each; rows may share a doc_id or have none; words may be of any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, drop, shuffle_partitions, stage
from .words import ODD, mix

LEAST, LONGEST, TOP = 100, 5, 2000
#: Cells of a sketch: one for so many characters, within these powers of two; cells of a block.
CHARS_A_CELL, LEAST_BITS, MOST_BITS, CELL_BITS = 48, 22, 30, 16
#: Bytes of rewritten texts that are worked on at once.
BLOCK_BYTES = 1 << 20
#: Hashes that a task gathers before it hands their counts on, and phrases that it remembers to have told.
GATHERED, REMEMBERED = 1 << 22, 1 << 20
#: Phrases and bytes of an automaton at most.
PHRASES, BYTES = 150_000, 3_000_000
#: Shares of a language in the final order, and languages whose totals are broadcast at most.
SALTS, FEW_LANGUAGES = 64, 10_000
MARK = b"\xff"  # never in UTF-8
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0a\x0b\x0c\x0d\x09", bytes(range(97, 123)) + MARK * 10 + b" ")


def rewritten(texts: list[bytes]) -> bytes:
    """All words of all texts between single blanks, with MARK as a word of its own between pieces."""
    data = b" " + MARK.join(texts).translate(_LOWER).replace(MARK, b" \xff ") + b" "
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data


def blocks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Parts of rewritten texts, each with the words after it that its last sequences reach into, and those words alone."""
    at, last = 0, len(data) - 1
    while at < last:
        end = data.find(b" ", at + BLOCK_BYTES)
        end = tail = last if end < 0 else end
        for _ in range(LONGEST - 1):
            tail = data.find(b" ", tail + 1) if tail < last else last
        yield data[at : tail + 1], data[end : tail + 1]
        at = end


def hashed(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: a hash per word, which holds the language's seed too; where each word begins; which words are marks."""
    raw = np.frombuffer(data, np.uint8)
    blanks = np.flatnonzero(raw == 32)
    sums = np.zeros(len(blanks), np.uint64)
    for at in range(0, len(raw), BLOCK_BYTES):  # a word may be longer than a block
        part = raw[at : at + BLOCK_BYTES]
        first = int(np.searchsorted(blanks, at, side="right")) - 1  # the word that goes on here
        inner = blanks[first + 1 : np.searchsorted(blanks, at + len(part))]
        starts = np.concatenate(([at], inner))
        place = np.arange(at, at + len(part)) - np.repeat(np.concatenate(([blanks[first]], inner)), np.diff(np.append(starts, at + len(part))))
        weight = ODD[place & 4095]
        far = np.flatnonzero(place > 4095)
        weight[far] *= ODD[4095 - (place[far] >> 12 & 4095)]
        sums[first : first + len(starts)] += np.add.reduceat(part * weight, starts - at)
    starts, lengths = blanks[:-1] + 1, np.diff(blanks) - 1
    words = mix(sums[:-1] + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(words ^ np.uint64(seed)), starts, raw[starts] == MARK[0]


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def sequences(words: np.ndarray, marks: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: the hashes of the sequences from each word on, and which lie within a piece."""
    h, whole = words, ~marks
    yield 1, h, whole
    for k in range(2, longest + 1):
        n = len(words) - k + 1
        if n < 1:
            return
        h = mix(h[:n] * np.uint64(0x9E3779B97F4A7C15) + words[k - 1 :])
        whole = whole[:n] & ~marks[k - 1 :]
        yield k, h, whole


class Bound:
    """Which cells of a sketch reached the threshold: a bit a cell."""

    def __init__(self, bits: int, blocks: dict[int, bytes]) -> None:
        self.bits = bits
        self.cells = np.zeros(1 << max(bits - 3, 0), np.uint8)
        for block, part in blocks.items():
            size = 1 << (CELL_BITS - 3)
            self.cells[block * size : block * size + size] = np.frombuffer(part, np.uint8)

    def passes(self, h: np.ndarray) -> np.ndarray:
        cell = h >> np.uint64(64 - self.bits)
        return (self.cells[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def texts_by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        out.setdefault(lang, []).append((text or "").encode())
    return out


def passing(words: np.ndarray, marks: np.ndarray, bounds: list[Bound]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For 1, 2, ... words: hashes, and the places where the sequence and all sequences in it can be frequent.

    ``bounds``: the first is for words and pairs, the second, if it is known yet, for the longer ones.
    """
    inside = None
    for k, h, whole in sequences(words, marks):
        if k == 1:
            ok = whole & bounds[0].passes(h)
        else:
            ok = inside[:-1] & inside[1:]
            at = np.flatnonzero(ok)
            bound = bounds[0] if k == 2 else bounds[1] if len(bounds) > 1 else None
            if bound:
                ok[at] = bound.passes(h[at])
        yield k, h, ok
        inside = ok


def hashed_blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By language and block: the block, how many words are its own, and what ``hashed`` gives for it."""
    for lang, part in texts_by_language(batch).items():
        seed = seed_of(lang)
        for data, tail in blocks(rewritten(part)):
            words, starts, marks = hashed(data, seed)
            yield lang, data, len(words) - max(tail.count(b" ") - 1, 0), words, starts, marks


def _counted(gathered: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """A row per block of cells: low halves of the cells and their counts, held at 255 as LEAST is less."""
    cells, n = np.unique(np.concatenate(gathered), return_counts=True)
    groups = cells >> np.uint32(CELL_BITS)
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    low, n = (cells & np.uint32((1 << CELL_BITS) - 1)).astype(np.uint16), np.minimum(n, 255).astype(np.uint8)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    columns = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (low, n)]
    return pa.RecordBatch.from_arrays([pa.array(groups[edges[:-1]].astype(np.int32)), *columns], ["block", "cells", "counts"])


def _merge(rows: pa.Table) -> pa.Table:
    """Of one block of cells: a bit for each cell whose counts reach LEAST."""
    total = np.zeros(1 << CELL_BITS, np.int64)
    for cells, n in zip(rows.column("cells").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        total[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.uint8)
    bits = np.packbits(total >= LEAST, bitorder="little").tobytes()
    return pa.table({"block": rows.column("block")[:1], "bits": pa.array([bits], pa.binary())})


def sketch(texts: DataFrame, bits: int, known: Broadcast | None = None) -> Bound:
    """The bound of words and pairs, or, if that is ``known``, of the longer sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for batch in batches:
            for _, _, own, words, _, marks in hashed_blocks(batch):
                steps = passing(words, marks, known.value) if known else sequences(words, marks, 2)
                found = [(h[:own][ok[:own]] >> np.uint64(64 - bits)).astype(np.uint32) for k, h, ok in steps if not known or k > 2]
                gathered += found
                size += sum(map(len, found))
                if size >= GATHERED:
                    yield _counted(gathered, bits)
                    gathered, size = [], 0
        if size:
            yield _counted(gathered, bits)

    merged = texts.mapInArrow(run, "block int, cells binary, counts binary").groupBy("block").applyInArrow(_merge, "block int, bits binary")
    return Bound(bits, {r["block"]: r["bits"] for r in merged.collect()})  # a bit a cell, 2 ** MOST_BITS bits at most


def candidates(texts: DataFrame, bounds: Broadcast) -> DataFrame:
    """``lang, phrase`` of all sequences, single words too, that can be frequent.

    A task hands on what it found in shares by hash, a row each; the shares of all tasks are put together by hash.
    """
    shares = 8 * shuffle_partitions(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, tuple[str, str]] = {}

        def hand_on() -> pa.RecordBatch:
            codes = np.fromiter(told, np.uint64, len(told))
            found = pa.array(list(told.values()), pa.struct([("lang", pa.string()), ("phrase", pa.string())]))
            share = codes % np.uint64(shares)
            order = np.argsort(share, kind="stable")
            kinds, starts = np.unique(share[order], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), found.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), lists], ["share", "found"])

        for batch in batches:
            for lang, data, own, words, starts, marks in hashed_blocks(batch):
                ends = np.append(starts[1:] - 1, len(data) - 1)
                for k, h, ok in passing(words, marks, bounds.value):
                    at = np.flatnonzero(ok[:own])
                    codes, first = np.unique(h[at], return_index=True)
                    for code, place in zip(codes.tolist(), at[first].tolist(), strict=True):
                        if code not in told:
                            told[code] = (lang, data[starts[place] : ends[place + k - 1]].decode())
            if len(told) > REMEMBERED:
                yield hand_on()
                told.clear()
        if told:
            yield hand_on()

    packed = texts.mapInArrow(run, "share long, found array<struct<lang string, phrase string>>")
    return packed.groupBy("share").applyInArrow(_distinct, "lang string, phrase string")


def _distinct(rows: pa.Table) -> pa.Table:
    found = pa.chunked_array([c.flatten() for c in rows.column("found").chunks])
    table = pa.Table.from_arrays([pa.chunked_array([c.field(i) for c in found.chunks], pa.string()) for i in range(2)], ["lang", "phrase"])
    return table.group_by(["lang", "phrase"]).aggregate([]).select(["lang", "phrase"])


_compiled: dict[tuple[str, str], ahocorasick.Automaton] = {}


def compiled(name: str, lang: str, phrases: list[str]) -> ahocorasick.Automaton:
    """Patterns of bytes with the blanks that guard them; those of one name stay with the worker for its next tasks."""
    if any(n != name for n, _ in _compiled):
        _compiled.clear()
    if (name, lang) not in _compiled:
        found = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            found.add_word(f" {p} ".encode().decode("latin-1"), i)
        found.make_automaton()
        _compiled[name, lang] = found
    return _compiled[name, lang]


def matches(found: ahocorasick.Automaton, data: bytes, n: int) -> np.ndarray:
    hits = np.fromiter(map(itemgetter(1), found.iter(data.decode("latin-1"))), np.int64)
    return np.bincount(hits, minlength=n)


def counts(texts: DataFrame, phrases: Broadcast, name: str) -> DataFrame:
    """``lang, phrase, f``, summed: how often each phrase of the broadcast (by language) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in texts_by_language(batch).items():
                own = phrases.value.get(lang)
                if not own:
                    continue
                found = compiled(name, lang, own)
                n = total.setdefault(lang, np.zeros(len(own), np.int64))
                for data, tail in blocks(rewritten(part)):
                    n += matches(found, data, len(own))
                    n -= matches(found, tail, len(own))  # the next block has these
        for lang, n in total.items():
            at = np.flatnonzero(n)
            told = pa.array([phrases.value[lang][i] for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), told, pa.array(n[at], pa.int64())], ["lang", "phrase", "f"])

    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_totals(texts: DataFrame) -> DataFrame:
    """``lang, n``: all words, counted by Spark alone."""
    words = F.regexp_count(F.translate("text", ".,;:!?\x0a\x0b\x0c\x0d", " " * 10), F.lit(r"[^\x20\x09]+"))
    return texts.groupBy("lang").agg(F.sum(F.coalesce(words, F.lit(0)).cast("long")).alias("n"))


def dealt(found: DataFrame) -> Iterator[tuple[DataFrame, DataFrame | None]]:
    """The candidates in groups that an automaton holds, and the languages whose texts a group concerns (None: all).

    Languages are kept whole where they fit, so that few texts are scanned more than once.
    """
    sizes = found.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("bytes"))
    key = F.xxhash64("lang", "phrase")
    if sizes.count() > FEW_LANGUAGES:
        n, size = sizes.agg(F.sum("n"), F.sum("bytes")).first()
        groups = max(-(-n // PHRASES), -(-size // BYTES))
        for g in range(groups):
            yield found.filter(F.pmod(key, F.lit(groups)) == g), None
        return
    units = []
    for r in sizes.collect():
        cut = max(-(-r["n"] // PHRASES), -(-r["bytes"] // BYTES))
        units += [(r["n"] / cut / PHRASES, r["bytes"] / cut / BYTES, r["lang"], cut, i) for i in range(cut)]
    groups: list[list] = []
    for unit in sorted(units, key=lambda u: (-max(u[:2]), u[2], u[4])):
        group = next((g for g in groups if all(sum(u[i] for u in g) + unit[i] <= 1.05 for i in (0, 1))), None)
        if group is None:
            groups.append(group := [])
        group.append(unit)
    for group in groups:
        table = found.sparkSession.createDataFrame([u[2:] for u in group], "lang string, _cut int, _part int")
        mine = found.join(F.broadcast(table), "lang").filter(F.pmod(key, F.col("_cut")) == F.col("_part"))
        yield mine, table.select("lang").distinct()


def frequent(docs: DataFrame) -> DataFrame:
    """Staged ``lang, phrase, f`` of all words and phrases of up to LONGEST words that occur LEAST times or more."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    bits = min(max((chars // CHARS_A_CELL).bit_length(), LEAST_BITS), MOST_BITS)
    send = spark.sparkContext.broadcast
    pairs = sketch(texts, bits)
    longer = sketch(texts, bits, send([pairs]))
    found = stage(candidates(texts, send([pairs, longer])), "candidates")
    parts = []
    for g, (mine, langs) in enumerate(dealt(found)):
        own: dict[str, list[str]] = {}
        for r in mine.select("lang", "phrase").collect():  # about PHRASES rows at most
            own.setdefault(r["lang"], []).append(r["phrase"])
        phrases = send({lang: sorted(p) for lang, p in own.items()})
        some = texts if langs is None else texts.join(F.broadcast(langs), "lang", "left_semi")
        parts.append(stage(counts(some, phrases, f"{found._scratch}-{g}").filter(F.col("f") >= LEAST), "phrase_counts"))
        phrases.unpersist()
    drop(found)
    if not parts:
        return spark.createDataFrame([], "lang string, phrase string, f long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases."""
    known = frequent(docs)
    totals = stage(word_totals(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")), "word_totals")
    words = F.split("phrase", " ", -1)
    phrases = known.filter(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    joined = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    # Phrases that a longer one as frequent holds are dropped, whatever becomes of the longer one.
    spans = F.expr("flatten(transform(sequence(2, size(w) - 1), n -> transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))))")
    held = phrases.filter(F.size("w") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = phrases.join(held, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * 100)
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    side = F.broadcast(totals) if totals.count() <= FEW_LANGUAGES else totals
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(side, "lang")
    # Decimals hold 38 digits; div gives the whole quotient.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    # The best of each share of a language first, so that no task orders a whole language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = scored.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("at") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
