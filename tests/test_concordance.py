"""Concordance by blocks and intervals of the risk against all pairs."""

import numpy as np
import pytest

from tarn.operators import concordance as C
from tarn.operators import manyfits as M


def by_pairs(t, r, w, m, tie=0.5):
    later = t[None] > t[:, None]
    score = (r[None] < r[:, None]) + tie * (r[None] == r[:, None])
    return np.einsum("id,jd,ij->d", w, m, later * score), np.einsum("id,jd,ij->d", w, m, later * 1.0)


@pytest.mark.parametrize("tie", [0.5, 0.0])
def test_pairs_of_arrays(tie):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 130):
        t, r = rng.integers(0, max(1, n // 3), n).astype(float), rng.integers(0, max(1, n // 4), n).astype(float)
        w, m = rng.integers(0, 3, (n, 2)).astype(float), rng.integers(0, 3, (n, 2)).astype(float)
        got = C.concordant(t, np.where(r == 3, np.nan, r), w, m, tie)  # NaN comes last
        want = by_pairs(t, np.where(r == 3, 1e9, r), w, m, tie)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


@pytest.mark.parametrize("distinct", [1, 3, 200])
def test_groups_of_many_blocks_and_intervals(spark, monkeypatch, distinct):
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(C, "INTERVAL", 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rng = np.random.default_rng(distinct)
        n = 300
        g, t, r = rng.integers(0, 3, n) // 2, rng.integers(0, 40, n).astype(float), rng.integers(0, distinct, n).astype(float)
        t[g == 0] = np.where(rng.random((g == 0).sum()) < 0.3, 7.0, t[g == 0])  # a time that fills blocks
        e, m = rng.integers(0, 2, n).astype(float), rng.integers(0, 3, n).astype(float)
        df = spark.createDataFrame([(f"g{a}", *map(float, b)) for a, *b in zip(g, t, e, r, m, strict=True)], "grp string, time double, event double, r double, m double")
        blocks = M.pack(df, "grp", ["r", "m"])
        assert blocks.df.count() > 8 and blocks.df.filter("tied").count() > 1

        def scored(grp, t, e, x, fold, ids):
            weights = np.stack((np.ones(len(t)), x[:, 1]), 1)
            yield 0, t, x[:, 0], weights * e[:, None], weights
            yield 1, t, -x[:, 0], weights * e[:, None] / 3, weights

        got = C.concordance(blocks, scored, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 4
    for k in range(2):
        own = g == k
        weights = np.stack((np.ones(own.sum()), m[own]), 1)
        for number, (risk, part) in enumerate(((r, 1), (-r, 3))):
            want = by_pairs(t[own], risk[own], weights * e[own, None] / part, weights)
            assert got[f"g{k}", number][0] == pytest.approx(want[0]) and got[f"g{k}", number][1] == pytest.approx(want[1])
