"""Concordance within groups of any size: pairs are counted in blocks, and between blocks by their sums.

Subjects come packed in blocks sorted by time (``manyfits.pack``). A pair's two subjects are in one block, or in two; then their
risks are in one interval of the risk, or in two. So each block counts its own pairs; each interval of the risk, met by
a shuffle, counts its pairs of different blocks; and for pairs that differ in both, the sums of each block and interval are
enough. Every count is n log n in arrays of bounded size. Equal risks of a block are one row, so a common risk fills no interval.

A subject has a weight as the event of a pair and one as its later subject, each a vector: resamples of the same subjects
are counted at once. Weights that are whole numbers give exact sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .manyfits import Blocks, arrays

#: Rows of an interval of the risk, about; risks of a block from which intervals are chosen.
INTERVAL, SAMPLE = 1 << 16, 16

#: number, times, risks, event's weights and later subject's weights (rows x vector) of one count among a block's subjects
Scored = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin; NaN equals NaN."""
    new = np.zeros(len(sorted_by[0]), bool)
    new[:1] = True
    for a in sorted_by:
        new[1:] |= (a[1:] != a[:-1]) & ((a[1:] == a[1:]) | (a[:-1] == a[:-1]))
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the begin of its run and the end."""
    sizes = np.diff(np.append(starts, n))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def concordant(t: np.ndarray, r: np.ndarray, w: np.ndarray, m: np.ndarray, tie: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``w[i] * m[j]`` over pairs with ``t[j] > t[i]``: of those with ``r[j] < r[i]``, and of equal ones times ``tie``; and of all.

    Ranks of two times first differ in one bit. At each bit, rows are in the order of the ranks' bits above it, then of their
    risks; an event whose bit isn't set counts, of those with the same bits above, the ones with it and a lower risk.
    """
    zero = np.zeros(w.shape[1])
    times, rank = np.unique(t, return_inverse=True)
    if len(times) < 2:
        return zero, zero
    by_time = np.argsort(rank, kind="stable")
    starts = _runs(rank[by_time])
    ws, ms = np.add.reduceat(w[by_time], starts, 0), np.add.reduceat(m[by_time], starts, 0)
    total = (ws[:-1] * np.cumsum(ms[::-1], 0)[::-1][1:]).sum(0)
    order = np.argsort(r, kind="stable")
    r, rank, w, m = r[order], rank[order], w[order], m[order]
    starts = _runs(r)
    if len(starts) == 1:
        return tie * total, total
    risk = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(r))))
    found = zero.copy()
    for b in range(int(len(times) - 1).bit_length() - 1, -1, -1):
        node, later = rank >> (b + 1), (rank >> b) & 1
        events = np.flatnonzero((later == 0) & w.any(1))
        if len(events):
            before = np.concatenate((zero[None], np.cumsum(m * later[:, None], 0)))
            low, high = (x[events] for x in _spread(_runs(node, risk), len(rank)))
            first = _spread(_runs(node), len(rank))[0][events]
            counted = (1 - tie) * before[low] + tie * before[high] - before[first]
            found += (w[events] * counted).sum(0)
        order = np.argsort((rank >> b).astype(np.uint16 if len(times) <= 1 << 16 else np.int64), kind="stable")
        rank, risk, w, m = rank[order], risk[order], w[order], m[order]
    return found, total


def _sent(a: np.ndarray) -> bytes:
    small = a.astype(np.uint8)
    return b"B" + small.tobytes() if (small == a).all() else b"d" + a.astype(np.float64).tobytes()


def _got(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b, np.uint8 if b[:1] == b"B" else np.float64, offset=1).reshape(-1, width).astype(np.float64)


def concordance(blocks: Blocks, scored: Callable[..., Iterator[Scored]], width: int = 1) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """By group and number: the weight of concordant pairs, ties at a half, and of all pairs; vectors of ``width``.

    ``scored(group, times, events, features, folds, ids)`` gives what to count among the subjects of a block. What reaches the driver
    is a few numbers for each block and count, and a vector a count.
    """
    spark, p = blocks.df.sparkSession, blocks.features

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, float, bool, Scored]]:
        for b in batches:
            for k in range(len(b)):
                grp = b.column(0)[k].as_py()
                for s in scored(grp, *arrays(b, k, p)):
                    if len(s[1]):
                        yield grp, b.column(1)[k].as_py(), b.column(2)[k].as_py(), s

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, first, tied, (number, t, r, w, m) in of(batches):
            found, total = (np.zeros(width), np.zeros(width)) if tied else concordant(t, r, w, m)
            some = np.sort(r)[np.linspace(0, len(r) - 1, min(SAMPLE, len(r)) + 2).astype(int)[1:-1]] if len(r) > 2 else r
            sums = [pa.array([a.astype(np.float64).tobytes()], pa.binary()) for a in (np.concatenate((found, total, w.sum(0), m.sum(0))), some)]
            yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([first], pa.float64()), pa.array([number], pa.int32()), pa.array([len(r)], pa.int64()), *sums], ["grp", "first", "number", "n", "sums", "some"])

    sums: dict[tuple[str, int], np.ndarray] = {}
    chunks: dict[tuple[str, int], dict[float, np.ndarray]] = {}
    sizes: dict[tuple[str, int], int] = {}
    risks: dict[tuple[str, int], list[np.ndarray]] = {}
    for r in blocks.df.mapInArrow(inside, "grp string, first double, number int, n long, sums binary, some binary").toLocalIterator():  # a row per block and count
        key, own = (r["grp"], r["number"]), np.frombuffer(r["sums"]).reshape(4, width)
        sums[key] = sums.get(key, 0) + own[:2]
        at = chunks.setdefault(key, {})
        at[r["first"]] = at.get(r["first"], 0) + own[2:]
        sizes[key] = sizes.get(key, 0) + r["n"]
        risks.setdefault(key, []).append(np.frombuffer(r["some"]))
    keys, between = [k for k in sums if len(chunks[k]) > 1], {}
    for i, key in enumerate(keys):
        firsts = np.array(sorted(chunks[key]))
        ws, ms = np.stack([chunks[key][f] for f in firsts], 1)
        sums[key] = sums[key] + np.stack((np.zeros(width), (ws[:-1] * np.cumsum(ms[::-1], 0)[::-1][1:]).sum(0)))
        some, parts = np.sort(np.concatenate(risks[key])), -(-sizes[key] // INTERVAL)
        between[key] = (i, firsts, np.unique(some[np.arange(1, parts) * len(some) // parts]))
    if not keys:
        return {k: (s[0], s[1]) for k, s in sums.items()}
    sent = spark.sparkContext.broadcast(between)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = sent.value
        for grp, first, _, (number, _, r, w, m) in of(batches):
            if (grp, number) not in between:
                continue
            i, firsts, edges = between[grp, number]
            order = np.argsort(r, kind="stable")
            starts = _runs(r[order])
            r, w, m = r[order][starts], np.add.reduceat(w[order], starts, 0), np.add.reduceat(m[order], starts, 0)
            part, chunk = np.searchsorted(edges, r, "right"), int(np.searchsorted(firsts, first))
            cuts = [*_runs(part), len(r)]
            rows = [(i, int(part[a]), chunk, r[a:b].tobytes(), _sent(w[a:b]), _sent(m[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["count", "part", "chunk", "r", "w", "m"])

    def interval(rows: pa.Table) -> pa.Table:
        """An interval's pairs of different blocks, and its sums by block."""
        r = [np.frombuffer(x) for x in rows.column("r").to_pylist()]
        w, m = (np.concatenate([_got(x, width) for x in rows.column(c).to_pylist()]) for c in ("w", "m"))
        chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) for x in r])
        found, _ = concordant(chunk, np.concatenate(r), w, m)
        order = np.argsort(chunk, kind="stable")
        starts = _runs(chunk[order])
        ws, ms = (np.add.reduceat(x[order], starts, 0) for x in (w, m))
        n = len(starts)
        out = [[rows.column(c)[0].as_py()] * n for c in ("count", "part")]
        out += [chunk[order][starts].tolist(), [x.tobytes() for x in ws], [x.tobytes() for x in ms], [(found if k == 0 else np.zeros(width)).tobytes() for k in range(n)]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["count", "part", "chunk", "w", "m", "found"])

    def apart(rows: pa.Table) -> pa.Table:
        """Pairs that differ in block and interval, by the sums of each; with those of the intervals."""
        w, m, found = (np.frombuffer(b"".join(rows.column(c).to_pylist())).reshape(-1, width) for c in ("w", "m", "found"))
        more, _ = concordant(rows.column("chunk").to_numpy(), rows.column("part").to_numpy(), w, m, tie=0.0)
        return pa.table([pa.array([rows.column("count")[0].as_py()], pa.int32()), pa.array([(found.sum(0) + more).tobytes()], pa.binary())], ["count", "s"])

    met = blocks.df.mapInArrow(dealt, "count int, part int, chunk int, r binary, w binary, m binary").groupBy("count", "part")
    cells = met.applyInArrow(interval, "count int, part int, chunk int, w binary, m binary, found binary")
    for r in cells.groupBy("count").applyInArrow(apart, "count int, s binary").toLocalIterator():  # a row per count
        sums[keys[r["count"]]][0] += np.frombuffer(r["s"])
    sent.unpersist()
    return {k: (s[0], s[1]) for k, s in sums.items()}
