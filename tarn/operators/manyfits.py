"""Many Cox or logistic fits over the same rows: folds, penalties and groups all at once, without a copy of the rows per fit.

Subjects are sorted by group and time once, and packed into blocks, a row each. A round reads the blocks twice. First each block
sums the weights of its subjects, for every fit a vector; the driver adds these up from the latest block on, so that each block knows what
comes later. Then each block runs through its own times and adds up losses, gradients and Hessians. No round shuffles, and
what reaches the driver is a vector per block and fit.

A fit minimises ``loss + l1 * |b| + l2 / 2 * |b - centre| ** 2`` over the rows of the folds it may see. Steps that
don't lower this are halved in the next round; a fit says whether it converged, and what it last had if it did not.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stage

#: Subjects of a block, about; fits whose matrices are in memory at once.
BLOCK, AT_ONCE = 1 << 16, 16
#: Exponents are held within this.
CLIP = 50.0
NAMES = ["grp", "first", "tied", "time", "event", "x", "fold", "id"]


@dataclass
class Fit:
    """One fit, made in every group: its penalties (``l1`` and ``l2`` as a part of the group's rows if ``relative``) and the folds it sees."""

    l2: float = 0.0
    l1: float = 0.0
    folds: frozenset[int] | None = None
    relative: bool = False


@dataclass
class Result:
    beta: np.ndarray
    converged: bool
    rounds: int
    loss: float


@dataclass
class Blocks:
    """Packed rows; ``sizes``: rows by group and fold."""

    df: DataFrame
    features: int
    sizes: dict[str, dict[int, int]]
    groups: list[str] = field(default_factory=list)


def pack(rows: DataFrame, group: str, features: Sequence[str], fold: str | None = None, id: str | None = None, time: str = "time", event: str = "event", parts: int | None = None) -> Blocks:
    """Sort by group and time and pack. Rows without a time, an event or a feature take no part."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    cols = [F.col(group).cast("string").alias("grp"), F.col(time).cast("double").alias("time"), F.col(event).cast("double").alias("event"), x.alias("x")]
    cols += [(F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), (F.col(id).cast("long") if id else F.lit(0).cast("long")).alias("id")]
    usable = rows.dropna(subset=[group, time, event, *features]).select(*cols)
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = usable.repartitionByRange(parts, "grp", "time").sortWithinPartitions("grp", "time")
    kinds = "grp string, first double, tied boolean, time array<double>, event array<double>, x array<double>, fold array<int>, id array<long>"
    df = stage(ordered.mapInArrow(_packed(len(features)), kinds), "blocks")
    sizes: dict[str, dict[int, int]] = {}
    for r in df.select("grp", F.explode("fold").alias("fold")).groupBy("grp", "fold").count().collect():  # a row per group and fold
        sizes.setdefault(r["grp"], {})[r["fold"]] = r["count"]
    return Blocks(df, len(features), sizes, sorted(sizes))


def _packed(p: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(g: list, t: np.ndarray, e: np.ndarray, x: np.ndarray, fold: np.ndarray, ids: np.ndarray, a: int, b: int, tied: bool) -> list:
        return [g[a], float(t[a]), tied, t[a:b].tolist(), e[a:b].tolist(), x[a:b].ravel().tolist(), fold[a:b].tolist(), ids[a:b].tolist()]

    def batch_of(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.float64(), pa.bool_(), *(pa.list_(k) for k in (pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, tie = [], 0, None  # tie: group and time whose run was cut

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n, tie
            g = [k for part in held for k in part[0]]
            t, e, x, fold, ids = (np.concatenate([part[i] for part in held]) for i in range(1, 6))
            same = np.array([a == b for a, b in zip(g[1:], g[:-1], strict=True)], bool)
            change = np.flatnonzero(~(same & (t[1:] == t[:-1]))) + 1
            start, out = 0, []
            if tie is not None and (g[0], t[0]) == tie:  # the rest of a run goes apart
                start = int(change[0]) if len(change) else len(g)
                out.append(block(g, t, e, x, fold, ids, 0, start, True))
            end = len(g) if last else int(change[-1]) if len(change) else start
            if not last and not len(change) and start == 0:  # one time fills the block
                out.append(block(g, t, e, x, fold, ids, 0, len(g), True))
                tie, end = (g[0], t[0]), len(g)
            elif end > start:
                edges = [start, *(int(c) for c in np.flatnonzero(~same) + 1 if start < c < end), end]
                out += [block(g, t, e, x, fold, ids, a, b, False) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                tie = None
            end = max(end, start)
            held, n = ([(g[end:], t[end:], e[end:], x[end:], fold[end:], ids[end:])], len(g) - end) if end < len(g) else ([], 0)
            if out:
                yield batch_of(out)

        for b in batches:
            if len(b):
                x = b.column(3).flatten().to_numpy().reshape(len(b), p)
                held.append((b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy(), x, b.column(4).to_numpy(), b.column(5).to_numpy()))
                n += len(b)
                if n >= BLOCK:
                    yield from flush(False)
        if n:
            yield from flush(True)

    return run


def arrays(batch: pa.RecordBatch, k: int, p: int) -> tuple[np.ndarray, ...]:
    """Times, events, features, folds and ids of the block in row ``k``."""
    t, e, x, fold, ids = (batch.column(i)[k].values.to_numpy() for i in range(3, 8))
    return t, e, x.reshape(-1, p), fold, ids


def _weights(x: np.ndarray, fold: np.ndarray, beta: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linear predictors, masks and weights: subjects x fits."""
    eta = x @ beta.T
    mask = seen[:, fold].T.astype(np.float64)
    return eta, mask, np.exp(np.clip(eta, -CLIP, CLIP)) * mask


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _moments(w: np.ndarray, x: np.ndarray) -> Iterator[np.ndarray]:
    """Weights, weighted features, weighted products: one matrix of subjects x fits after another."""
    yield w
    for i in range(x.shape[1]):
        yield w * x[:, i : i + 1]
    for i, j in _pairs(x.shape[1]):
        yield w * (x[:, i] * x[:, j])[:, None]


def block_totals(x: np.ndarray, fold: np.ndarray, beta: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Moments x fits: the sums over a block."""
    return np.concatenate([np.stack([m.sum(0) for m in _moments(_weights(x, fold, beta[f : f + AT_ONCE], seen[f : f + AT_ONCE])[2], x)]) for f in range(0, len(beta), AT_ONCE)], 1)


def block_terms(t: np.ndarray, e: np.ndarray, x: np.ndarray, fold: np.ndarray, beta: np.ndarray, seen: np.ndarray, later: np.ndarray, tied: bool) -> np.ndarray:
    """(1 + p + pairs) x fits: losses, gradients and Hessians of a block's events; ``later`` are the moments of what comes after it,
    or, if ``tied``, from its own time on."""
    p, out = x.shape[1], []
    events = np.flatnonzero(e > 0)
    first = np.searchsorted(t, t[events], "left")
    for f in range(0, len(beta), AT_ONCE):
        eta, mask, w = _weights(x, fold, beta[f : f + AT_ONCE], seen[f : f + AT_ONCE])
        ahead = later[:, f : f + AT_ONCE]
        risk = [np.broadcast_to(a, (len(events), eta.shape[1])) if tied else np.cumsum(m[::-1], 0)[::-1][first] + a for m, a in zip(_moments(w, x), ahead, strict=True)]
        count = mask[events]
        s0 = np.where(risk[0] > 0, risk[0], 1.0)
        mean = [risk[1 + i] / s0 for i in range(p)]
        sums = [(count * (np.log(s0) - eta[events])).sum(0)]
        sums += [(count * (mean[i] - x[events, i][:, None])).sum(0) for i in range(p)]
        sums += [(count * (risk[1 + p + k] / s0 - mean[i] * mean[j])).sum(0) for k, (i, j) in enumerate(_pairs(p))]
        out.append(np.stack(sums))
    return np.concatenate(out, 1)


def cox_terms(blocks: Blocks, beta: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Groups x moments x fits: loss, gradient and Hessian at ``beta`` (groups x fits x features)."""
    p = blocks.features
    at = {g: i for i, g in enumerate(blocks.groups)}
    spark = blocks.df.sparkSession
    sent = spark.sparkContext.broadcast((at, beta, seen))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, beta, seen = sent.value
        for b in batches:
            for k in range(len(b)):
                _, _, x, fold, _ = arrays(b, k, p)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([block_totals(x, fold, beta[at[b.column(0)[k].as_py()]], seen).tobytes()], pa.binary())], ["grp", "first", "s"])

    shape = (1 + p + len(_pairs(p)), beta.shape[1])
    slots: dict[tuple[str, float], np.ndarray] = {}
    for r in blocks.df.mapInArrow(totals, "grp string, first double, s binary").collect():  # a row per block
        key = (r["grp"], r["first"])
        slots[key] = slots.get(key, 0) + np.frombuffer(r["s"]).reshape(shape)
    later: dict[tuple[str, float], tuple[np.ndarray, np.ndarray]] = {}
    group, run = None, np.zeros(shape)
    for key in sorted(slots, reverse=True):
        if key[0] != group:
            group, run = key[0], np.zeros(shape)
        later[key] = (run, run + slots[key])
        run = run + slots[key]
    ahead = spark.sparkContext.broadcast(later)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, beta, seen = sent.value
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k in range(len(b)):
                grp, tied = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                t, e, x, fold, _ = arrays(b, k, p)
                now = block_terms(t, e, x, fold, beta[at[grp]], seen, ahead.value[grp, b.column(1)[k].as_py()][int(tied)], tied)
                sums[grp] = sums[grp] + now if grp in sums else now
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["grp", "s"])

    out = np.zeros((len(at), *shape))
    for r in blocks.df.mapInArrow(terms, "grp string, s binary").collect():  # a row per task and group
        out[at[r["grp"]]] += np.frombuffer(r["s"]).reshape(shape)
    ahead.unpersist()
    sent.unpersist()
    return out


def logistic_terms(blocks: Blocks, beta: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The same for logistic classifiers of ``event``."""
    p = blocks.features
    at = {g: i for i, g in enumerate(blocks.groups)}
    sent = blocks.df.sparkSession.sparkContext.broadcast((at, beta, seen))
    shape = (1 + p + len(_pairs(p)), beta.shape[1])

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, beta, seen = sent.value
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for k in range(len(b)):
                grp = b.column(0)[k].as_py()
                _, y, x, fold, _ = arrays(b, k, p)
                now = logistic_sums(x, y[:, None], seen[:, fold].T.astype(np.float64), beta[at[grp]])
                sums[grp] = sums[grp] + now if grp in sums else now
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["grp", "s"])

    out = np.zeros((len(at), *shape))
    for r in blocks.df.mapInArrow(terms, "grp string, s binary").collect():  # a row per task and group
        out[at[r["grp"]]] += np.frombuffer(r["s"]).reshape(shape)
    sent.unpersist()
    return out


def logistic_sums(x: np.ndarray, y: np.ndarray, mask: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """(1 + p + pairs) x fits, for classes ``y`` and masks of subjects x fits."""
    eta = np.clip(x @ beta.T, -30, 30)
    q = 1 / (1 + np.exp(-eta))
    loss = (mask * (np.logaddexp(0, eta) - y * eta)).sum(0)
    slope, bend = mask * (q - y), mask * q * (1 - q)
    return np.concatenate((loss[None], x.T @ slope, np.stack([(x[:, i] * x[:, j]) @ bend for i, j in _pairs(x.shape[1])])))


def _target(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l1: float, l2: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The minimum of the quadratic approximation plus the penalty."""
    if l1 == 0:
        return beta - np.linalg.lstsq(hessian + np.diag(l2), gradient + l2 * (beta - centre), rcond=None)[0]
    new, slope = beta.copy(), gradient.copy()
    for _ in range(500):
        change = 0.0
        for j in range(len(beta)):
            if hessian[j, j] + l2[j] <= 0:
                continue
            t = hessian[j, j] * new[j] - slope[j] + l2[j] * centre[j]
            b = np.sign(t) * max(abs(t) - l1, 0.0) / (hessian[j, j] + l2[j])
            slope += hessian[:, j] * (b - new[j])
            change, new[j] = max(change, abs(b - new[j])), b
        if change < 1e-12:
            break
    return new


def solve(
    blocks: Blocks,
    fits: Sequence[Fit],
    centre: np.ndarray | None = None,
    terms: Callable[[Blocks, np.ndarray, np.ndarray], np.ndarray] = cox_terms,
    rounds: int = 60,
    cap: float = np.inf,
    free: Sequence[int] = (),
    tolerance: float = 1e-8,
) -> dict[tuple[str, int], Result]:
    """Results by group and place of the fit. Features in ``free`` are not penalised; coefficients beyond ``cap`` are given up."""
    p, g, n = blocks.features, len(blocks.groups), len(fits)
    centre = np.zeros(p) if centre is None else centre
    folds = 1 + max((f for by in blocks.sizes.values() for f in by), default=0)
    seen = np.array([[f.folds is None or k in f.folds for k in range(folds)] for f in fits], bool).reshape(n, folds)
    size = np.array([[sum(c for k, c in blocks.sizes[name].items() if s[k]) for s in seen] for name in blocks.groups], float).reshape(g, n)
    scale = np.where([f.relative for f in fits], size, 1.0)
    l1 = scale * np.array([f.l1 for f in fits])
    l2 = (scale * np.array([f.l2 for f in fits]))[:, :, None] * np.where(np.isin(np.arange(p), list(free)), 0.0, 1.0)
    beta = np.tile(centre, (g, n, 1))
    move, value = np.zeros((g, n, p)), np.full((g, n), np.inf)
    done, good, took = np.zeros((g, n), bool), np.zeros((g, n), bool), np.zeros((g, n), int)
    pairs = _pairs(p)
    for _ in range(rounds):
        live = np.flatnonzero(~done.all(0))  # fits that some group still needs
        if not len(live):
            break
        tried = beta + move
        found = terms(blocks, tried[:, live], seen[live])
        for i in range(g):
            for k, f in enumerate(live):
                if done[i, f]:
                    continue
                took[i, f] += 1
                b, s = tried[i, f], found[i, :, k]
                now = s[0] + l1[i, f] * np.abs(b).sum() + (l2[i, f] / 2 * (b - centre) ** 2).sum()
                if not now <= value[i, f] + 1e-10 * max(1.0, abs(now)):
                    move[i, f] /= 2
                    if np.abs(move[i, f]).max() < tolerance / 100:
                        done[i, f] = True  # no lower point on the way, nor a sign of a minimum
                    continue
                gained, beta[i, f], value[i, f] = value[i, f] - now, b, now
                h = np.zeros((p, p))
                for at, (a, c) in enumerate(pairs):
                    h[a, c] = h[c, a] = s[1 + p + at]
                move[i, f] = _target(b, s[1 : 1 + p], h, l1[i, f], l2[i, f], centre) - b
                if np.abs(move[i, f]).max(initial=0.0) < tolerance or gained < 1e-13 * max(1.0, abs(now)):
                    done[i, f] = good[i, f] = True
                elif np.abs(b).max(initial=0.0) > cap:
                    done[i, f] = True
    return {(name, f): Result(beta[i, f], bool(good[i, f]), int(took[i, f]), float(value[i, f])) for i, name in enumerate(blocks.groups) for f in range(n)}


def predict(blocks: Blocks, results: dict[tuple[Hashable, int], Result], scored: Sequence[frozenset[int]]) -> DataFrame:
    """``grp, fit, fold, id, time, event, risk``: each fit's linear predictor of the subjects of the folds ``scored`` for it."""
    p = blocks.features
    table = {g: np.array([results[g, f].beta for f in range(len(scored))]).reshape(len(scored), p) for g in blocks.groups}
    sent = blocks.df.sparkSession.sparkContext.broadcast((table, list(scored)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, scored = sent.value
        for b in batches:
            for k in range(len(b)):
                grp = b.column(0)[k].as_py()
                t, e, x, fold, ids = arrays(b, k, p)
                for f, own in enumerate(scored):
                    at = np.flatnonzero(np.isin(fold, list(own)))
                    if len(at):
                        risk = x[at] @ table[grp][f]
                        yield pa.RecordBatch.from_arrays([pa.array([grp] * len(at), pa.string()), pa.array(np.full(len(at), f, np.int32)), *(pa.array(c[at]) for c in (fold, ids, t, e)), pa.array(risk)], ["grp", "fit", "fold", "id", "time", "event", "risk"])

    return blocks.df.mapInArrow(run, "grp string, fit int, fold int, id long, time double, event double, risk double")
