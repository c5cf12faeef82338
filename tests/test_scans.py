import numpy as np
import pytest

from tarn.operators import scans


def events(seed=0, hot=300):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in (("hot", hot), ("a", 5), ("b", 1), ("c", 40)):
        t = np.cumsum(rng.choice([0, 0, 1, 2, 50, 4000], n)).astype(float)
        out += [(g, float(x), i, None if rng.random() < 0.1 else float(rng.normal())) for i, x in enumerate(t)]
    return out


def frame(spark, rows):
    odd = [(None, 1.0, 1, 1.0), ("a", None, 900, 1.0), ("a", 3.0, None, 1.0)]
    return spark.createDataFrame([*rows, *odd], "g string, at double, id long, v double")


@pytest.mark.parametrize("block", [1 << 16, 16, 3, 1])
def test_frames_and_fading_means_equal_plain_ones(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    data = events()
    blocks = scans.pack(frame(spark, data).repartition(5), "g", "at", "id", "v")
    if block < 20:
        assert blocks.df.filter("grp = 'hot'").count() >= 300 // block
    for width in (0.0, 3.0, 4500.0, 1e9):
        got = {(r["grp"], r["id"]): (r["n"], r["s"]) for r in scans.rolling(blocks, width).collect()}
        assert len(got) == len(data)
        for g, t, i, _ in data:
            own = [v for h, u, _, v in data if h == g and t - width <= u <= t and v is not None]
            assert got[g, i][0] == len(own) and got[g, i][1] == pytest.approx(sum(own), abs=1e-9)
    for tau in (0.5, 40.0, 1e7):
        got = {(r["grp"], r["id"]): r["mean"] for r in scans.ewm(blocks, tau).collect()}
        assert len(got) == len(data)
        for g, t, i, _ in data:
            own = [(np.exp(-(t - u) / tau), v) for h, u, j, v in data if h == g and (u, j) <= (t, i) and v is not None]
            w = sum(x for x, _ in own)
            if w > 1e-300:
                assert got[g, i] == pytest.approx(sum(x * v for x, v in own) / w, rel=1e-6, abs=1e-9)


def test_a_block_that_many_ask_is_copied(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK", 8)
    # A quiet start, whose block all rows of a burst reach back into.
    rows = [("g", float(i), i, 1.0) for i in range(8)] + [("g", 100.0 + i / 1000, 100 + i, 1.0) for i in range(200)]
    blocks = scans.pack(spark.createDataFrame(rows, "g string, at double, id long, v double"), "g", "at", "id", "v")
    got = {r["id"]: r["n"] for r in scans.rolling(blocks, 96.5).collect()}
    assert all(got[i] == sum(t - 96.5 <= u <= t for _, u, _, _ in rows) for _, t, i, _ in rows)


def test_no_rows(spark):
    blocks = scans.pack(frame(spark, []), "g", "at", "id", "v")
    assert scans.rolling(blocks, 1.0).collect() == [] and scans.ewm(blocks, 1.0).collect() == []
