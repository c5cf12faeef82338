"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nyström landmarks.

The kernel of two stretches of text sums, over all sequences of ORDER symbols, the product of their weights in
both; an occurrence that spans k symbols weighs DECAY ** k, and spans of at most ORDER + GAPS symbols count. So
an insult still meets its like when characters are left out of it or put between its letters.

Labelled sentences are learned from by their documents' labels: a document is toxic if one window of one of its
sentences is. Windows stand for toxic documents first by their telling words, or telling beginnings or ends of words, then by
what the last fit scores highest; clean documents give windows at random and those that score highest. A linear machine
is fitted to the Nyström features of the windows. As its decision is a sum over landmarks, and the kernel is a
sum over sequences, the two sums change places: a weight per sequence, in one table, scores every place of every
whole text exactly as the landmarks would, with a few table lookups a character.

Defined results for odd input: a null, empty or letterless text gets the score of a text without any sequence, which is low;
documents without a label are scored like others; of several labels of one doc_id the largest counts, null
labels, labels of no document and rows without a doc_id teach nothing; without labels of both kinds, every document's score is the
share of toxic ones among those labelled, 0 if there are none; repeated rows get the same result each; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: The kernel: symbols of a sequence, symbols it may skip, and what each symbol spanned costs.
ORDER, GAPS, DECAY = 4, 3, 0.9
#: A window: all sequences that start at so many places that follow one another.
PLACES = 10
#: The sample to learn from: documents of each label at most, and the characters of a stretch of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 6000
#: Nyström landmarks of each label (as many again are chosen by a first fit), windows of clean documents and of telling words
#: as they are hidden, and rounds of choosing windows anew.
LANDMARKS, WINDOWS, ROUNDS = 64, 4000, 5
#: A word, or a beginning or end of so many letters, stands for toxic documents if it is so many deviations more frequent in their sentences.
TELLING, SHORTEST, LONGEST = 4.0, 3, 8
#: One in so many documents of the sample turns decisions into probabilities and is kept from the fit.
APART_EVERY = 5
SYMBOLS = 32
#: Places that are worked on at once.
BLOCK = 1 << 15
STEPS = [d for d in itertools.product(range(1, GAPS + 2), repeat=ORDER - 1) if sum(d) < ORDER + GAPS]


def _classes() -> np.ndarray:
    """Letters are symbols of their own whatever their case; blanks, other ASCII and the rest have classes."""
    out = np.full(256, 28, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[97:123] = out[65:91] = np.arange(1, 27)
    out[128:] = 29 + np.arange(128) % 3
    return out


CLASSES = _classes()


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one row, each text between blanks and followed by places of symbol 0, and where each begins; of
    characters that are no letters and follow one another, the first alone counts."""
    pad = b"\x00" * (PLACES + ORDER + GAPS)
    data = np.frombuffer(b"".join(b" " + t.replace(b"\x00", b" ") + b" " + pad for t in texts), np.uint8)
    out = CLASSES[data]
    out[data == 0] = 0
    plain = (out == 27) | (out == 28)
    kept = np.ones(len(out), bool)
    kept[1:] = ~(plain[1:] & plain[:-1])
    begins = np.cumsum([0, *(len(t) + len(pad) + 2 for t in texts)])
    sizes = np.add.reduceat(kept, begins[:-1], dtype=np.int64) if texts else np.zeros(0, np.int64)
    return out[kept], np.concatenate(([0], np.cumsum(sizes)))


def sequences(row: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The span and the codes of the sequences from each place, for every way to skip; the last places have none."""
    n = len(row) - ORDER - GAPS + 1
    pairs = {d: row[:-d] * SYMBOLS + row[d:] for d in range(1, GAPS + 2)}
    high = {d: p[:n] * SYMBOLS**2 for d, p in pairs.items()}
    for a, b, c in STEPS:
        yield a + b + c + 1, high[a] + pairs[c][a + b : a + b + n]


def places(row: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The summed weights of the sequences from each place; the last places have none."""
    by_span: dict[int, np.ndarray] = {}
    for span, codes in sequences(row.astype(np.int32)):
        found = table.take(codes)
        by_span[span] = by_span[span] + found if span in by_span else found
    return sum(DECAY**k * x.astype(np.float64) for k, x in by_span.items())


def windows(row: np.ndarray, starts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest sum of weights over a window of each text, and the first place where such a window starts.

    A window of padding holds nothing; it stands for a text without any sequence. Long texts are read block by block.
    """
    best, at = np.zeros(len(starts) - 1), starts[1:] - 1
    row = np.concatenate((row, np.zeros(PLACES + ORDER + GAPS, row.dtype)))
    for begin in range(0, int(starts[-1]), BLOCK):
        end = min(begin + BLOCK, int(starts[-1]))
        run = np.concatenate(([0.0], np.cumsum(places(row[begin : end + PLACES + ORDER + GAPS - 1], table))))
        sums = run[PLACES : PLACES + end - begin] - run[: end - begin]
        sums[row[begin:end] == 0] = 0
        first, last = np.searchsorted(starts, begin, side="right") - 1, np.searchsorted(starts, end)
        edges = np.maximum(starts[first:last] - begin, 0)
        top = np.maximum.reduceat(sums, edges)
        for t in np.flatnonzero(top > best[first:last]).tolist():
            stretch = sums[edges[t] : edges[t + 1] if t + 1 < len(edges) else None]
            best[first + t], at[first + t] = top[t], begin + edges[t] + int(stretch.argmax())
    return best, at


@dataclass
class Machine:
    """A weight per sequence, the offset, and slope and offset of the probability; ``table`` None: ``share`` for all."""

    table: np.ndarray | None
    offset: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    share: float = 0.0

    def decisions(self, texts: list[bytes]) -> np.ndarray:
        row, starts = symbols(texts)
        return windows(row, starts, self.table)[0] + self.offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.shift, -40, 40)))


def of_windows(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all sequences of the windows that start at places ``at``."""
    row = np.concatenate((row.astype(np.int32), np.zeros(PLACES + ORDER + GAPS, np.int32)))
    codes, weights = [], []
    for span, found in sequences(row):
        codes.append(found[at[:, None] + np.arange(PLACES)])
        weights.append(np.full(PLACES, DECAY**span))
    return np.concatenate(codes, 1), np.concatenate(weights)


def has_padding(codes: np.ndarray) -> np.ndarray:
    return (codes < SYMBOLS**3) | (codes // SYMBOLS**2 % SYMBOLS == 0) | (codes // SYMBOLS % SYMBOLS == 0) | (codes % SYMBOLS == 0)


class Landmarks:
    """Sequence weights of the landmarks, and the Nyström map of windows to features."""

    def __init__(self, texts: list[bytes], more: np.ndarray | None = None) -> None:
        """``texts`` are a window each; ``more`` has codes of further windows."""
        row, starts = symbols(texts)
        codes, weights = of_windows(row, starts[:-1])
        if more is not None:
            codes = np.concatenate((codes, more))
        self.codes = np.unique(codes[~has_padding(codes)])
        self.place = np.zeros(SYMBOLS**ORDER, np.int32)
        self.place[self.codes] = np.arange(1, len(self.codes) + 1)
        self.of = np.zeros((len(self.codes) + 1, len(codes)))
        for j, c in enumerate(codes):
            np.add.at(self.of[:, j], self.place[c], weights)
        self.of[0] = 0
        values, vectors = np.linalg.eigh(self.of.T @ self.of)
        kept = values > values.max(initial=0) * 1e-9
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def features(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        kernel = np.zeros((len(codes), self.of.shape[1]))
        for k, w in enumerate(weights):
            found = self.place[codes[:, k]]
            some = np.flatnonzero(found)
            kernel[some] += w * self.of[found[some]]
        return kernel @ self.root

    def table(self, primal: np.ndarray) -> np.ndarray:
        """The weight of each sequence in the decision: the landmarks' weights by what they hold of it."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        out[self.codes] = (self.of @ (self.root @ primal))[1:]
        return out


def separate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 50) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes of equal weight, by Newton steps on its active rows."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(weight @ np.maximum(0, 1 - y * (x @ v)) ** 2 + penalty @ v**2)

    for _ in range(rounds):
        active = y * (x @ w) < 1
        h = (x[active] * weight[active, None]).T @ x[active] + np.diag(penalty)
        new = np.linalg.solve(h, (x[active] * weight[active, None]).T @ y[active])
        step, now = 1.0, loss(w)
        while step > 1e-6 and loss(w + step * (new - w)) > now:
            step /= 2
        moved = step * (new - w)
        w = w + moved
        if np.abs(moved).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def probability(f: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve of decisions, with the toxic ones weighing ``share`` in all.

    It is one half where the fewest documents are on the wrong side, in the middle of the widest such gap.
    """
    positive = y > 0
    weight = np.where(positive, share / max(positive.sum(), 1), (1 - share) / max((~positive).sum(), 1))
    order = np.argsort(f, kind="stable")
    values = f[order]
    wrong = np.concatenate(([0.0], np.cumsum(np.where(positive[order], weight[order], -weight[order]))))
    edges = np.concatenate(([values[0] - 2], values, [values[-1] + 2]))
    gaps = np.where(wrong <= wrong.min() + 1e-12, np.diff(edges), -1.0)
    middle = edges[gaps.argmax()] + gaps.max() / 2
    x, slope = f - middle, 1.0
    for _ in range(50):  # Newton steps for the slope alone, which a small penalty bounds
        p = 1 / (1 + np.exp(-np.clip(slope * x, -40, 40)))
        move = (weight @ (x * (positive - p)) - 1e-3 * slope) / (weight @ (x * x * p * (1 - p)) + 1e-3)
        slope = min(max(slope + move, slope / 2, 1e-3), 2 * slope)
    return float(slope), float(-slope * middle)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]


def words(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]+", text.lower()))


def pieces(word: str) -> set[str]:
    """The word between blanks, its beginnings and its ends; a blank shows that a word begins or ends there."""
    cuts = range(SHORTEST, min(len(word), LONGEST + 1))
    return {f" {word} ", *(f" {word[:k]}" for k in cuts), *(f"{word[-k:]} " for k in cuts)}


def telling_pieces(toxic: list[str], clean: list[str]) -> list[str]:
    """Words, or beginnings or ends of words, that toxic sentences hold by TELLING deviations more than clean ones.

    The most telling one comes first; then its sentences go, and the next one is chosen by those that are left, so
    that a piece tells of itself and not of its neighbours. None is measured by the most telling one: insults of a less
    common language count as well. A stem with many endings counts as one. Equal sentences count once, so copies of a
    document tell no more than it does; three toxic sentences at least hold a piece.
    """
    parts = [{s.strip().lower() for t in part for s in sentences(t)} for part in (toxic, clean)]
    parts[0] -= parts[1]
    share = len(parts[0]) / max(len(parts[0]) + len(parts[1]), 1)
    rows = [words(s) for s in sorted(parts[0])]
    now: Counter = Counter()
    for ws in rows:
        now.update(set().union(*map(pieces, ws)))
    now = Counter({p: k for p, k in now.items() if k >= 3})
    cut: dict[str, set[str]] = {}

    def held(ws: set[str]) -> set[str]:
        return set().union(*(cut[w] if w in cut else cut.setdefault(w, pieces(w) & now.keys()) for w in ws))

    against: Counter = Counter()
    for s in parts[1]:
        against.update(held(words(s)))

    def telling(p: str) -> float:
        expected = (now[p] + against[p]) * share
        return (now[p] - expected) / np.sqrt(expected * (1 - share) + 1)

    now = Counter({p: k for p, k in now.items() if telling(p) >= TELLING})
    found = [held(ws) & now.keys() for ws in rows]
    where: dict[str, list[int]] = {}
    for i, ps in enumerate(found):
        for p in ps:
            where.setdefault(p, []).append(i)
    left, out = set(range(len(rows))), []
    while now and len(out) < LANDMARKS:
        # Of equally telling pieces the longest one says most.
        best = max(now, key=lambda p: (telling(p), len(p), p))
        if now[best] < 3 or telling(best) < TELLING:
            break
        out.append(best)
        gone = left & set(where[best])
        left -= gone
        now.subtract(p for i in gone for p in found[i])
    return out


def marred(word: str, rng: np.random.Generator) -> list[str]:
    """The word as those write it who hide it: set apart, with one letter more, with one sign for a letter."""
    at = int(rng.integers(1, max(len(word), 2)))
    return [rng.choice(list(" .-*")).join(word), word[:at] + chr(rng.integers(97, 123)) + word[at:], word[:at] + "*" + word[at + 1 :]]


def split(rows: list[str]) -> tuple[list[str], list[str]]:
    """Most of the rows, and those that are kept apart; few rows serve as both."""
    if len(rows) < 2 * APART_EVERY:
        return rows, rows
    return [r for i, r in enumerate(rows) if i % APART_EVERY], rows[::APART_EVERY]


def train(toxic: list[str], clean: list[str], share: float, seed: int = 13) -> Machine:
    """Fit a machine to stretches of documents of both labels."""
    toxic, clean = sorted({t for t in toxic if t.strip()}), sorted({t for t in clean if t.strip()})
    if not toxic or not clean:
        return Machine(None, share=share)
    rng = np.random.default_rng(seed)
    (toxic, toxic_apart), (clean, clean_apart) = (split([part[i] for i in rng.permutation(len(part))]) for part in (toxic, clean))
    telling = telling_pieces(toxic, clean)
    stems = set(telling)
    # The telling words of toxic documents; without any, documents say no more than all their words.
    chosen = [w for t in toxic for w in sorted(words(t)) if stems & pieces(w)] or [w for t in toxic for w in words(t)]
    marks = [p.strip().encode() for p in telling]
    marks += [w.encode() for w, _ in sorted(Counter(chosen).items(), key=lambda x: (-x[1], x[0])) if w.encode() not in marks]
    marks = marks[:LANDMARKS]
    hidden = [x.encode() for w in chosen for x in (w, *marred(w, rng))]
    hidden = [hidden[i] for i in rng.permutation(len(hidden))[:WINDOWS]]
    plain = [s.encode() for t in clean for s in sentences(t)]
    plain = [plain[i] for i in rng.permutation(len(plain))[:WINDOWS]]
    own = marks + [s[:PLACES] for s in plain[:LANDMARKS]]
    toxic_rows, clean_rows, plain_rows, hidden_rows = (symbols(x) for x in ([t.encode() for t in toxic], [t.encode() for t in clean], plain, hidden))
    good, weights = of_windows(hidden_rows[0], hidden_rows[1][:-1])
    bad = of_windows(plain_rows[0], plain_rows[1][:-1])[0]
    shown_codes, landmarks = good[:0], Landmarks(own)
    x = [landmarks.features(c, weights) for c in (good, bad, shown_codes)]
    machine = Machine(None, share=share)
    for k in range(ROUNDS):
        primal, machine.offset = separate(np.concatenate((x[0], x[2], x[1])), np.repeat([1.0, -1.0], [len(x[0]) + len(x[2]), len(x[1])]))
        machine.table = landmarks.table(primal)
        top_clean, at_clean = windows(*clean_rows, machine.table)
        top, at = windows(*toxic_rows, machine.table)
        # A toxic document none of whose windows is on the toxic side shows no reason for its label; a clean one, of the
        # highest twentieth, that is beyond most toxic ones has a doubtful label.
        shown = top + machine.offset > 0
        clear = top_clean <= max(np.quantile(top_clean, 0.95), np.median(top[shown]) if shown.any() else 0.0)
        likest = of_windows(clean_rows[0], at_clean[clear])[0]
        bad, shown_codes = np.concatenate((bad, likest)), of_windows(toxic_rows[0], at[shown])[0]
        if k == 0:
            # The windows that are hardest to tell become landmarks: clean ones like toxic ones, and toxic ones as they stand.
            hard = likest[np.argsort(-top_clean[clear], kind="stable")[:LANDMARKS]]
            some = shown_codes[rng.permutation(len(shown_codes))[:LANDMARKS]]
            landmarks = Landmarks(own, np.unique(np.concatenate((hard, some)), axis=0))
            x = [landmarks.features(c, weights) for c in (good, bad, shown_codes)]
        else:
            x = [x[0], np.concatenate((x[1], landmarks.features(likest, weights))), landmarks.features(shown_codes, weights)]
    f = machine.decisions([t.encode() for t in toxic_apart + clean_apart])
    machine.slope, machine.shift = probability(f, np.repeat([1, -1], [len(toxic_apart), len(clean_apart)]), min(max(share, 0.001), 0.999))
    return machine


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, seed: int = 13) -> Machine:
    """Train on ``sample`` labelled documents of each label at most, in a seeded hash order; held-out ones never."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max(F.col("toxic").cast("double")) >= 1).alias("toxic"))
    known = docs.select("doc_id").distinct().join(known, "doc_id")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sizes.get(True, 0) / total if total else 0.0
    # A hash filter leaves about twice the sample, so that what is ordered for the final choice is bounded too.
    h = F.xxhash64(F.lit(seed), "doc_id")
    limits = {k: int(min(1.0, 2 * sample / n) * (1 << 40)) for k, n in sizes.items()}
    some = F.pmod(h, F.lit(1 << 40)) < F.when(F.col("toxic"), limits.get(True, 0)).otherwise(limits.get(False, 0))
    picks = [known.filter(some & (F.col("toxic") == k)).orderBy(h, "doc_id").limit(sample) for k in (True, False)]
    picked = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * sample rows at most
    length = F.length("text")
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.greatest(length - SAMPLE_CHARS, F.lit(0)) + 1).cast("int")
    stretch = F.substring(F.col("text"), at + 1, F.lit(SAMPLE_CHARS))
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(picked, "doc_id")
    # One text for a doc_id, the one with the least hash, should several rows share it.
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by(stretch, F.xxhash64("text")).alias("t"))
    rows = sorted((r["doc_id"], r["toxic"], r["t"]) for r in one.collect())
    return train([t for _, k, t in rows if k], [t for _, k, t in rows if not k], share, seed)


def score(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    arrow_batches(docs.sparkSession)
    machine = machine or fit(docs, labels)
    spread = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = spread.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
            found = machine.scores(texts) if texts else np.zeros(0)
            labels = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), labels], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
