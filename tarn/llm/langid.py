"""Language ID with a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum
over a window feeds a softmax. The network is fitted on windows drawn from whole texts of a bounded, seeded
sample of labelled documents; it then reads every window of every text, and a document's prediction is the
mean of its windows' log probabilities.

One more class stands for no learned language; it is fitted on windows with shuffled letters and on random
letters of many scripts. A text is foreign to all learned languages if that class leads by more than it does
for any document of a part of the sample that is kept from training, so clean documents are not rejected.

Defined results for odd input: a null text, or one without any letter, is ``und`` with score 0; so is
every text if no labelled text is there to learn from, and none is foreign then; rows with a null language
are predicted but not learned from; repeated rows get the same result each, and rows may share a doc_id or
have none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, unused

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 12
#: The sample to learn from: documents at most, windows drawn from each, and their characters.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_CHARS = 3000, 2, 220
#: One in so many documents of the sample sets the limits of the class of no language.
LIMIT_EVERY = 5
TALL = max(WIDTHS)
# Letters of some scripts, as ranges of code points.
SCRIPTS = ((0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@dataclass
class Network:
    """``dense`` and ``offset`` have a column per label and a last one for no language."""

    labels: list[str]
    embed: np.ndarray  # 257 x DIM; row 256 is padding
    filters: np.ndarray  # TALL * DIM x all filters; a narrow filter is zero in its last rows
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    limits: np.ndarray | None = None  # by label: how far the last class leads for texts of that language

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        """Log probabilities by window; ``windows`` are rows of WINDOW + TALL - 1 byte ids."""
        top, _, _ = _pool(self, windows)
        z = np.maximum(top, 0) @ self.dense + self.offset
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _pool(net: Network, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = net.embed[ids]  # rows x places x DIM
    n, places = ids.shape[0], ids.shape[1] - TALL + 1
    flat = np.lib.stride_tricks.as_strided(x, (n, places, TALL * DIM), (x.strides[0], x.strides[1], x.strides[2]))
    flat = np.ascontiguousarray(flat).reshape(-1, TALL * DIM)
    y = (flat @ net.filters).reshape(n, places, -1)
    return y.max(1) + net.bias, y, flat


def _mask() -> np.ndarray:
    mask = np.zeros((TALL * DIM, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask


def windows_of(data: bytes) -> np.ndarray:
    """Whole text as rows of byte ids: windows follow one another, each with the next one's first places."""
    n = max(1, -(-len(data) // WINDOW))
    ids = np.full(n * WINDOW + TALL - 1, 256, np.uint16)
    ids[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(ids, (n, WINDOW + TALL - 1), (WINDOW * 2, 2))


def junk(windows: list[str], rng: np.random.Generator) -> list[str]:
    """Windows in no language: shuffled letters, and words of random letters of one script."""
    out = []
    for i, text in enumerate(windows):
        if i % 2:
            out.append("".join(rng.permutation(list(text))))
        else:
            low, high = SCRIPTS[0 if rng.random() < 0.5 else rng.integers(len(SCRIPTS))]
            letters = [chr(c) for c in rng.integers(low, high + 1, len(text))]
            for at in np.cumsum(rng.integers(2, 10, len(text) // 2 + 1)):
                if at < len(letters):
                    letters[at] = " "
            out.append("".join(letters))
    return out


def gradients(net: Network, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the mean cross-entropy of windows ``b`` with classes ``t``, by the network's fields in order."""
    top, act, flat = _pool(net, b)
    hidden = np.maximum(top, 0)
    z = hidden @ net.dense + net.offset
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(t)), t] -= 1
    p /= len(t)
    g_hidden = (p @ net.dense.T) * (top > 0)
    where = act.argmax(1)  # batch x filters: the place that won
    places = act.shape[1]
    taken = flat.reshape(len(t), places, -1)[np.arange(len(t))[:, None], where]  # batch x filters x TALL*DIM
    g_filters = np.einsum("bf,bfk->kf", g_hidden, taken) * _mask()
    g_flat = g_hidden[:, :, None] * net.filters.T[None]  # batch x filters x TALL*DIM
    g_embed = np.zeros_like(net.embed)
    byte = b[np.arange(len(t))[:, None, None], where[:, :, None] + np.arange(TALL)[None, None, :]]
    np.add.at(g_embed, byte.reshape(-1), g_flat.reshape(-1, DIM))
    g_embed[256] = 0
    return g_embed, g_filters, g_hidden.sum(0), hidden.T @ p, p.sum(0)


def fresh(labels: list[str], rng: np.random.Generator) -> Network:
    n_filters = len(WIDTHS) * FILTERS
    net = Network(
        labels,
        rng.normal(0, 0.5, (257, DIM)).astype(np.float32),
        (rng.normal(0, 0.2, (TALL * DIM, n_filters)) * _mask()).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.2, (n_filters, len(labels) + 1)).astype(np.float32),
        np.zeros(len(labels) + 1, np.float32),
    )
    net.embed[256] = 0
    return net


def train(windows: list[str], langs: list[str], seed: int = 7, epochs: int = 4, batch: int = 64, rate: float = 0.004) -> Network:
    """Adam on the cross-entropy of windows; everything seeded, so reruns give the same network."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    net = fresh(labels, rng)
    if not labels:
        return net
    classes = [labels.index(x) for x in langs] + [len(labels)] * len(windows[::2])
    rows = [windows_of(text.encode()) for text in [*windows, *junk(windows[::2], rng)]]
    ids, y = np.concatenate(rows), np.repeat(classes, [len(r) for r in rows])
    names = ("embed", "filters", "bias", "dense", "offset")
    moment = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            for k, g in zip(names, gradients(net, ids[pick], y[pick]), strict=True):
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, seed: int = 7) -> Network:
    """Train on ``sample`` labelled documents at most, taken in a seeded hash order; held-out ones never."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # A hash filter leaves about twice the sample, so that what tasks send for the final choice is bounded too.
    share = min(1.0, 2 * sample / max(labelled.count(), 1))
    key = (F.col("doc_id"), F.xxhash64("text"))
    some = F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(1 << 40)) < int(share * (1 << 40))
    last = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    starts = [F.pmod(F.xxhash64(F.lit(seed + 2 + k), *key), last).cast("int") for k in range(SAMPLE_WINDOWS)]
    windows = F.array_distinct(F.array(*(F.substring(F.col("text"), at + 1, F.lit(SAMPLE_CHARS)) for at in starts)))
    rows = (
        labelled.filter(some)
        .filter(has_letter(F.col("text")))
        .select(F.xxhash64(F.lit(seed), *key).alias("h"), F.col("doc_id"), windows.alias("windows"), F.col("lang").cast("string").alias("lang"))
        .orderBy("h", "doc_id", "windows", "lang")
        .limit(sample)
        .collect()
    )
    apart = rows[::LIMIT_EVERY] if len(rows) >= 2 * LIMIT_EVERY else []
    rows = [r for i, r in enumerate(rows) if not apart or i % LIMIT_EVERY]
    net = train([w for r in rows for w in r.windows], [r.lang for r in rows for _ in r.windows], seed)
    # Parts of the windows count too, as a text may be as short.
    net.limits = np.zeros(len(net.labels))
    texts = [(w[:n], r.lang) for r in apart for w in r.windows for n in (len(w), 60, 20, 8) if r.lang in net.labels]
    if texts:
        _, _, lead = predict_batch(net, [t for t, _ in texts])
        np.maximum.at(net.limits, [net.labels.index(x) for _, x in texts], lead)
    return net


def predict_batch(net: Network, texts: list[str | None], block: int = 32) -> tuple[list[str], list[float], list[float]]:
    """Predictions for whole texts, and by how much the class of no language leads; windows go through the
    network ``block`` at a time."""
    rows = [windows_of(t.encode()) if t else np.zeros((0, WINDOW + TALL - 1), np.uint16) for t in texts]
    ends = np.cumsum([len(r) for r in rows])
    total = np.zeros((len(texts), len(net.labels) + 1))
    pending: list[np.ndarray] = []
    count, done = 0, 0
    owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])

    def flush() -> None:
        nonlocal pending, count, done
        if pending:
            ids = np.concatenate(pending)
            np.add.at(total, owner[done : done + len(ids)], net.log_probs(ids))
            done += len(ids)
            pending, count = [], 0

    for r in rows:
        for at in range(0, len(r), block):
            pending.append(r[at : at + block])
            count += len(pending[-1])
            if count >= block:
                flush()
    flush()
    n = np.diff(np.concatenate(([0], ends)))
    mean = total / np.maximum(n, 1)[:, None]
    mean, other = mean[:, :-1], mean[:, -1]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    lead = other - mean[np.arange(len(best)), best]
    return [net.labels[i] for i in best], p[np.arange(len(best)), best].tolist(), lead.tolist()


def classify(docs: DataFrame, net: Network | None = None, added: tuple[str, str, str] = ("_lang", "_score", "_foreign")) -> DataFrame:
    """All columns of ``docs``, and three ``added``: language, score, whether foreign; from ``text`` alone; no rows move."""
    arrow_batches(docs.sparkSession)
    net = net or fit(docs)
    names = [*docs.columns, *added]
    rows = docs.select("*", F.when(has_letter(F.col("text")), F.col("text").cast("string")).alias(unused(docs, "_read")[0]))
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(names) - 3).to_pylist()
            langs, scores, lead = predict_batch(net, texts) if net.labels else ([], [0.0] * len(texts), [])
            limit = {} if net.limits is None else dict(zip(net.labels, net.limits.tolist(), strict=True))
            foreign = [t is not None and bool(langs) and lead[i] > limit.get(langs[i], 0.0) for i, t in enumerate(texts)]
            langs = ["und" if t is None or not langs else langs[i] for i, t in enumerate(texts)]
            scores = [0.0 if t is None else x for t, x in zip(texts, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(foreign, pa.bool_())], names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    net = net or fit(docs)
    found = classify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
