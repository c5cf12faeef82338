"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents are tokenised once and cut where they exceed a sequence. Pieces go by falling length, a band of
lengths at a time; the gaps of the open sequences are a table of their own. A round range-sorts the
band's pieces and the gaps together by falling size and sweeps over them: each gap is put on a stack, each
piece takes the gap on top, which is the smallest that fits and that no piece before it took. So several
pieces that want one gap are settled by their rank, and the lower one has it. A gap that holds any of the
band's pieces several times over counts as often. Every task sweeps its own range; pieces that find their
task's stack empty go on to the gaps that ranges before theirs have left, which the ranges' counts alone
tell (these, a row per range, are what the driver sees). Then the gaps shrink, and the round repeats.
New sequences, no more than the band's rest of words fills, are opened only after a round over the gaps
there are, and what finds no place in the last round opens its own.

Rounds are a fixed number, however many documents there are; every round's tables are staged, so a lost
executor costs its tasks of one round.

Defined results for odd input: a null text is empty; an empty text is one piece, the end id alone;
repeated rows are documents of their own, and so may have equal doc_ids; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, drop, global_rank, stage
from .words import word_table

CAPACITY, END_ID = 4096, 1
CACHED_WORDS = 1_500_000
#: Parts of a sequence that bound the bands of lengths. As many of a band's pieces as its number fit a new sequence.
BANDS = (1, 2, 3, 4, 5, 6, 8, 16, 32, 64, 256)
#: Rows that a task sweeps, and tasks at most.
SWEEP_ROWS, SWEEP_TASKS = 200_000, 20_000
#: Their own ids show where one word ends and the next begins when many are encoded as one text.
_MARK = "!"
#: Words by which a tokenizer shows whether it parts them at blanks and ignores case.
_TRIAL = "The quick Brown fox, 12 JUMPS over it's lazy DOG! Na\u00efve \u00c9t\u00e9 \u6771\u4eac x_1 end."


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts. Where blanks part words for good, and the case of A-Z does not matter, a word's ids do
    not depend on its neighbours: words are then found by their hashes and encoded once. A tokenizer that
    fails a trial of this encodes whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.direct([_MARK])[0].tolist()
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        whole = self.direct([_TRIAL, *_TRIAL.split()])
        self.by_word = all(np.array_equal(whole[0], x) for x in (np.concatenate(whole[1:]), *self.direct([_TRIAL.lower(), _TRIAL.replace(" ", "\t\n ")])))

    def direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word; many are encoded as one text, with marks between them."""
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if _MARK not in w] if len(self.mark) == 1 else []
        for s in range(0, len(plain), 500):
            part = plain[s : s + 500]
            (ids,) = self.direct([f" {_MARK} ".join([words[i] for i in part])])
            cut = np.flatnonzero(ids == self.mark[0])
            if len(cut) == len(part) - 1:
                for i, a, b in zip(part, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.direct([words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        if not self.by_word:
            return self.direct(texts.fill_null("").to_pylist())
        hashes, first, start, length, raw = word_table(texts)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        near = np.minimum(place, max(len(self.keys) - 1, 0))
        known = self.keys[near] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        new = np.flatnonzero(~known)
        data = raw.tobytes()
        found = self.words([data[a : a + n].decode() for a, n in zip(start[example[new]].tolist(), length[example[new]].tolist(), strict=True)])
        at, n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        at[known], n[known] = self.at[near[known]], self.n[near[known]]
        n[new] = [len(x) for x in found]
        at[new] = len(self.ids) + np.cumsum(n[new]) - n[new]
        ids = np.concatenate([self.ids, *found])
        if len(self.keys) < CACHED_WORDS:
            self.keys, self.at, self.n = (np.insert(x, place[new], y[new]) for x, y in ((self.keys, distinct), (self.at, at), (self.n, n)))
            self.ids = ids
        lengths = n[which]
        ends = np.cumsum(lengths)
        flat = ids[np.repeat(at[which] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.append(0, ends)[first]
        out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        # The special tokens' own strings are single ids wherever they stand.
        for i in {i for s in self.special for i in np.flatnonzero(pc.match_substring(texts, s).fill_null(False))}:
            (out[i],) = self.direct([texts[i].as_py()])
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a worker, kept over its tasks."""
    return Encoder(path)


PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as pieces of ``capacity`` tokens at most."""
    arrow_batches(docs.sparkSession, 500)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(code.encode(batch.column(1))):
                ids = np.append(ids, end_id).astype("<u4")
                for k, s in enumerate(range(0, len(ids), capacity)):
                    owner.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(min(capacity, len(ids) - s))
                    crc.append(zlib.crc32(ids[s : s + capacity].tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, t) for c, t in zip((piece, start, length, crc), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


@dataclass
class Sweep:
    """What a sweep gives: ``placed`` pieces with their ``seq``, pieces ``left`` numbered from 0, and their sums."""

    placed: DataFrame
    left: DataFrame
    n_left: int
    words_left: int


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]


def sweep(left: DataFrame, gaps: DataFrame, most: int, tasks: int) -> Sweep:
    """Match pieces of ``most`` tokens at most to ``gaps`` (``seq, free``)."""
    spark = left.sparkSession
    kinds = {f.name: f.dataType for f in left.schema.fields}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in _PIECE[:-1]]
    times = F.greatest(F.floor(F.col("free") / most), F.lit(1)).cast("int")
    rows = left.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), *_PIECE, F.lit(None).cast("long").alias("seq"), F.lit(0).alias("slots"))
    # Gaps come before pieces of their size; among gaps that hold any piece, the smallest is put on top.
    rows = rows.unionByName(
        gaps.select(F.least("free", F.lit(most)).cast("long").alias("size"), F.lit(0).alias("kind"), (-F.col("free")).alias("tie"), *none, F.col("seq").alias("rank"), "seq", times.alias("slots"))
    )
    order = [F.col("size").desc(), F.col("kind"), F.col("tie"), F.col("rank")]
    fields = [*_PIECE, "kind", "seq", "slots", "part", "at"]
    schema = ", ".join([f"{c} {kinds[c].simpleString()}" for c in _PIECE]) + ", kind int, seq long, slots int, part int, at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces with a gap (kind 1) or without one (2, numbered by ``at``), and gaps left (0) with their first slot ``at``."""
        part, seqs, slots, lost = TaskContext.get().partitionId(), [], [], 0
        for batch in batches:
            kind, seq, times = (batch.column(fields.index(c)).to_pylist() for c in ("kind", "seq", "slots"))
            at = [0] * len(kind)
            for i, k in enumerate(kind):
                if k == 0:
                    seqs.append(seq[i])
                    slots.append(times[i])
                elif seqs:
                    seq[i] = seqs[-1]
                    slots[-1] -= 1
                    if not slots[-1]:
                        seqs.pop()
                        slots.pop()
                else:
                    kind[i], at[i] = 2, lost
                    lost += 1
            cols = [*batch.columns[: len(_PIECE)], pa.array(kind, pa.int32()), pa.array(seq, pa.int64()), pa.array(times, pa.int32()), pa.array([part] * len(kind), pa.int32()), pa.array(at, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, fields).filter(pa.array(kind, pa.int32()).cast(pa.bool_()))
        if seqs:
            n = len(seqs)
            types = [f.type for f in batch.schema][: len(_PIECE)]
            ends = np.cumsum(slots)
            cols = [*(pa.nulls(n, t) for t in types), pa.array([0] * n, pa.int32()), pa.array(seqs, pa.int64()), pa.array(slots, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(ends - slots, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, fields)

    dealt = rows.repartitionByRange(tasks, *order) if tasks > 1 else rows.repartition(1)  # few rows need no ranges
    ordered = dealt.sortWithinPartitions(*order).select(*_PIECE, "kind", "seq", "slots")
    met = stage(ordered.mapInArrow(run, schema), "pack_met")
    sums = met.groupBy("part").agg(
        F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)), F.sum(F.when(F.col("kind") == 0, F.col("slots")).otherwise(0)), F.sum(F.when(F.col("kind") == 2, F.col("length")).otherwise(0))
    )
    sums = sorted(tuple(r) for r in sums.collect())
    # Ranges' stacks lie on one another: intervals (part, first piece, end, range of the gaps, their top slot).
    stack, moves, starts, n_left = [], [], [], 0
    for part, lost, slots, _ in sums:
        at = 0
        while at < lost and stack:
            of, low, high = stack.pop()
            n = min(lost - at, high - low)
            moves.append((part, at, at + n, of, high - 1))
            at += n
            if high - n > low:
                stack.append((of, low, high - n))
        starts.append((part, at, n_left))
        n_left += lost - at
        if slots:
            stack.append((part, 0, slots))
    placed, lost = met.filter("kind = 1").select(*_PIECE, "seq"), met.filter("kind = 2")
    words_left = sum(s[3] for s in sums)
    if moves:
        table = F.broadcast(spark.createDataFrame(moves, "part int, first long, end long, of int, top long"))  # two rows a range at most
        going = lost.join(table, "part").filter("at >= first and at < end").select(*_PIECE, "of", (F.col("top") - F.col("at") + F.col("first")).alias("slot"))
        wanted = table.select(F.col("of").alias("part"), (F.col("top") - F.col("end") + F.col("first") + 1).alias("low"), "top")
        free = met.filter("kind = 0").join(F.broadcast(wanted), "part").withColumn("a", F.greatest("at", "low")).withColumn("b", F.least(F.col("at") + F.col("slots") - 1, F.col("top")))
        free = free.filter("a <= b").select(F.col("part").alias("of"), "seq", F.explode(F.sequence("a", "b")).alias("slot"))
        carried = stage(going.join(free, ["of", "slot"]).select(*_PIECE, "seq"), "pack_carried")
        words_left -= int(carried.agg(F.sum("length")).first()[0])
        placed = placed.unionByName(carried)
    table = F.broadcast(spark.createDataFrame(starts or [(0, 0, 0)], "part int, taken long, before long"))  # a row a range
    rest = lost.join(table, "part").filter("at >= taken").select(*_PIECE, (F.col("at") - F.col("taken") + F.col("before")).alias("left"))
    return Sweep(placed, rest, n_left, words_left)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, path or default_tokenizer(), capacity, end_id), "pack_pieces")
    ranked = global_rank(cut, [F.col("length").desc(), F.xxhash64("doc_id", "piece", "ids_crc32")], "rank").select(*_PIECE)
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # a row per length: capacity at most
    gaps = stage(spark.createDataFrame([], "seq long, free long"), "pack_gaps")
    steps: list[DataFrame] = []
    opened = before = 0

    def put(placed: DataFrame, new: int, smallest: int) -> None:
        """Take the placed pieces' tokens off their gaps, of which ``new`` are opened now."""
        nonlocal gaps, opened
        steps.append(placed.withColumn("step", F.lit(len(steps))))
        fresh = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("free"))
        taken = placed.select("seq", (-F.col("length")).alias("free"))
        old, opened = gaps, opened + new
        gaps = stage(old.unionByName(fresh).unionByName(taken).groupBy("seq").agg(F.sum("free").alias("free")).filter(F.col("free") >= smallest), "pack_gaps")
        drop(old)

    bounds = [*dict.fromkeys(capacity // k for k in BANDS), 0]
    smallest = min(counts, default=0)
    for high, low in pairwise(bounds):
        band = {n: k for n, k in counts.items() if low < n <= high}
        if not band:
            continue
        most, least = max(band), min(band)
        n_left, words_left = sum(band.values()), sum(n * k for n, k in band.items())
        left = ranked.filter((F.col("length") > low) & (F.col("length") <= high)).withColumn("left", F.col("rank") - before)
        before += n_left
        for attempt in range(3 if high <= capacity // 8 else 2):
            if not n_left or (attempt == 0 and not opened) or (attempt and capacity // most == 1):
                continue
            if attempt and (new := -(-words_left // capacity)):
                fresh = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("free"))
                old, opened = gaps, opened + new
                gaps = stage(old.unionByName(fresh), "pack_gaps")
                drop(old)
            done = sweep(left, gaps.filter(F.col("free") >= least), most, min(-(-(n_left + opened) // sweep_rows), SWEEP_TASKS))
            left, n_left, words_left = done.left, done.n_left, done.words_left
            put(done.placed, 0, smallest)
        if n_left:
            each = capacity // most
            put(left.select(*_PIECE, (F.floor(F.col("left") / each) + opened).cast("long").alias("seq")), -(-n_left // each), smallest)
    if not steps:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    rows = functools.reduce(DataFrame.unionByName, steps)
    within = Window.partitionBy("seq").orderBy("step", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum("length").over(within) - F.col("length")
    return rows.select(*_PIECE[:-1], F.col("seq").alias("sequence_id"), offset.alias("offset"))
