"""Fits of many folds, penalties and draws at once against one-group fits; permuted labels against sorts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import manyfits as M
from tarn.operators import permutation as P
from tarn.operators.ranks import group_rank
from tarn.plans import models, permutations

from . import brute as plain

NAMES = ["x1", "x2", "x3"]


def subjects(spark, n=300, seed=0, ties=1):
    rng = np.random.default_rng(seed)
    x, fold, g = rng.normal(size=(n, 3)), rng.integers(0, 3, n), rng.integers(0, 2, n)
    t = np.where(rng.random(n) < 0.4 * ties, 7.0, rng.integers(1, 25, n).astype(float))  # a hot time
    e = rng.integers(0, 2, n)
    rows = [(f"g{g[i]}", float(t[i]), int(e[i]), *map(float, x[i]), int(fold[i]), i) for i in range(n)]
    df = spark.createDataFrame(rows + [("g0", None, 1, 0.0, 0.0, 0.0, 0, n), ("g1", 3.0, 1, None, 0.0, 0.0, 0, n + 1)], "grp string, time double, event int, x1 double, x2 double, x3 double, fold int, id long")
    return df, g, t, e.astype(float), x, fold


@pytest.mark.parametrize("block,batch", [(1 << 16, 10_000), (20, 6), (5, 3)])
def test_fits_equal_one_group_fits_whatever_the_blocks(spark, monkeypatch, block, batch):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "AT_ONCE", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df, g, t, e, x, fold = subjects(spark)
        blocks = M.pack(df, "grp", NAMES, "fold", "id")
        if block < 100:
            assert blocks.df.filter("tied").count() > 2
        alphas = (0.2, 0.05, 0.01)
        plan = [M.Fit(l2=2.0), M.Fit(l2=5.0, folds=frozenset([0, 2])), *(M.Fit(l1=a / 2, l2=a / 2, relative=True) for a in alphas)]
        got = M.solve(blocks, plan)
        centre = np.array([0.1, 0.0, -0.2])
        centred = M.solve(blocks, plan[:1], centre)
        risks = M.predict(blocks, got, [frozenset([1])] * len(plan)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.converged for r in [*got.values(), *centred.values()])
    for k, name in enumerate(("g0", "g1")):
        own = g == k
        part = own & (fold != 1)
        assert got[name, 0].beta == pytest.approx(plain.ridge_cox(t[own], e[own], x[own], 2.0)[0], abs=1e-6)
        assert got[name, 1].beta == pytest.approx(plain.ridge_cox(t[part], e[part], x[part], 5.0)[0], abs=1e-6)
        assert centred[name, 0].beta == pytest.approx(plain.ridge_cox(t[own], e[own], x[own], 2.0, centre)[0], abs=1e-6)
        want = plain.elastic_net_cox(t[own], e[own], x[own], np.array(alphas), 0.5)
        for i in range(3):
            assert got[name, 2 + i].beta == pytest.approx(want[i], abs=1e-5)
    assert len(risks) == len(plan) * (fold == 1).sum()
    for r in risks[::17]:
        assert r["fold"] == 1 and r["risk"] == pytest.approx(x[r["id"]] @ got[r["grp"], r["fit"]].beta)


def test_steep_fits_settle_or_say_that_they_did_not(spark):
    # Each step of the plain quadratic overshoots here.
    steep = spark.createDataFrame([("a", float(k), int(k % 5 != 0), float((-1) ** k * 40 * k), float(k == 3), 0.0, 0, k) for k in range(1, 40)], "grp string, time double, event int, x1 double, x2 double, x3 double, fold int, id long")
    blocks = M.pack(steep, "grp", NAMES)
    (fit,) = M.solve(blocks, [M.Fit(l2=1e-3, l1=1e-3)], rounds=200).values()
    t, e, x = (np.array(steep.select(*c).collect(), float) for c in (["time"], ["event"], NAMES))
    value = lambda b: plain.cox_terms(t[:, 0], e[:, 0], x @ b, x)[0] + 1e-3 * np.abs(b).sum() + 5e-4 * (b**2).sum()
    assert fit.converged and fit.loss == pytest.approx(value(fit.beta))
    for j in range(3):
        assert value(fit.beta) <= min(value(fit.beta + np.eye(3)[j] * s) for s in (1e-4, -1e-4)) + 1e-9
    endless = spark.createDataFrame([("a", float(k), 1, float(-k)) for k in range(1, 9)], "grp string, time double, event int, x1 double")
    (fit,) = M.solve(M.pack(endless, "grp", ["x1"]), [M.Fit()], cap=20.0).values()
    assert not fit.converged
    (fit,) = M.solve(M.pack(endless, "grp", ["x1"]), [M.Fit()], rounds=2).values()
    assert not fit.converged and fit.rounds == 2
    assert M.solve(M.pack(endless.limit(0), "grp", ["x1"]), [M.Fit()]) == {}


def test_logistic_terms_of_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=200) > 0.3).astype(int)
    df = spark.createDataFrame([("a", float(k), int(c), float(a), float(b), 1.0) for k, ((a, b), c) in enumerate(zip(x, y, strict=True))], "grp string, time double, event int, x1 double, x2 double, one double")
    (fit,) = M.solve(M.pack(df, "grp", ["x1", "x2", "one"]), [M.Fit(l2=1.0)], terms=M.logistic_terms, free=[2]).values()
    assert fit.converged and fit.beta == pytest.approx(plain.logistic_l2(x, y), abs=1e-6)


def test_ranks_within_groups(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.integers(4)}", int(rng.integers(5)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {r["id"]: r["place"] for r in group_rank(df, ["g"], [F.col("v").desc(), F.col("id")], "place").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in own] == list(range(len(own)))


def test_permuted_outcomes_are_permutations_within_arms(spark):
    df, *_ = subjects(spark, 120)
    x = df.dropna().withColumnRenamed("grp", "arm")
    got = permutations.permuted_outcomes(x, 4, "s").collect()
    own = {r["id"]: r for r in x.collect()}
    for arm in ("g0", "g1"):
        ids = sorted(i for i, r in own.items() if r["arm"] == arm)
        want = sorted((own[i]["time"], own[i]["event"]) for i in ids)
        for draw in range(4):
            rows = [r for r in got if r["arm"] == arm and r["draw"] == draw]
            assert sorted(r["id"] for r in rows) == ids and sorted((r["time"], r["event"]) for r in rows) == want
            assert all(r["x1"] == own[r["id"]]["x1"] for r in rows)
            same = sum((r["time"], r["event"]) == (own[r["id"]]["time"], own[r["id"]]["event"]) for r in rows)
            assert (same == len(ids)) == (draw == 0)


def vectors(spark, n, dims=4, groups=3):
    rng = np.random.default_rng(n)
    label = [f"l{k}" for k in rng.choice(groups, n, p=[0.6, 0.3, 0.1][:groups] if groups == 3 else None)]
    x = rng.normal(size=(n, dims)) + np.array([[0.3 * (k == "l1")] for k in label])
    rows = [(int(i), k, [float(v) for v in r]) for i, k, r in zip(rng.permutation(n) * 3, label, x, strict=True)]
    return spark.createDataFrame([*rows, (-1, None, [0.0] * dims), (None, "l0", [0.0] * dims)], "id long, label string, x array<double>"), rows


@pytest.mark.parametrize("most,bins", [(2000, 256), (5, 4), (1, 256)])
def test_labels_are_dealt_by_sorted_hashes(spark, monkeypatch, most, bins):
    monkeypatch.setattr(P, "SORTED", most)
    monkeypatch.setattr(P, "BINS", bins)
    monkeypatch.setattr(P, "CHUNK", 50)
    df, rows = vectors(spark, 230)
    sub = P.subjects(df, "id", "label", "x", "s")
    drawn = P.draw(sub, 7, "s")
    own = {r["id"]: r for r in sub.collect()}
    assert len(own) == len(rows)
    ids = np.array(sorted(own))
    u = np.array([own[i]["u"] for i in ids])
    got = drawn.assign(u, ids, drawn.places(P.pa.array([own[i]["label"] for i in ids])))
    sizes = [sum(r[1] == k for r in rows) for k in drawn.labels]
    for d in range(7):
        order = sorted(range(len(ids)), key=lambda i: ((int(drawn.a[d]) * int(u[i]) + int(drawn.b[d])) % P.PRIME, ids[i]))
        want = np.empty(len(ids), int)
        want[order] = np.repeat(range(len(sizes)), sizes)
        assert (got[:, d + 1] == want).all()
    assert all(drawn.labels[got[i, 0]] == own[ids[i]]["label"] for i in range(len(ids)))


def test_permanova_of_three_groups(spark):
    df, rows = vectors(spark, 150)
    (r,) = P.permanova(df, "id", "label", "x", 60, "s").collect()
    x, label = np.array([v for _, _, v in rows]), np.array([k for _, k, _ in rows])

    def statistic(y):
        total = ((x - x.mean(0)) ** 2).sum()
        within = sum(((x[y == k] - x[y == k].mean(0)) ** 2).sum() for k in set(y))
        return (total - within) / total, (total - within) / (len(set(y)) - 1) / (within / (len(y) - len(set(y))))

    r2, f = statistic(label)
    assert r["r2"] == pytest.approx(r2) and r["pseudo_f"] == pytest.approx(f) and r["permutations"] == 60
    sub = P.subjects(df, "id", "label", "x", "s")
    drawn = P.draw(sub, 60, "s")
    own = {s["id"]: s["u"] for s in sub.collect()}
    ids = np.array([i for i, _, _ in rows])
    places = drawn.assign(np.array([own[i] for i in ids]), ids, drawn.places(P.pa.array(list(label))))
    null = [statistic(places[:, d])[0] for d in range(1, 61)]
    assert r["p"] == pytest.approx((1 + sum(v >= r2 for v in null)) / 61)
    assert r["null_mean"] == pytest.approx(np.mean(null)) and r["null_q95"] == pytest.approx(np.quantile(null, 0.95))
    (one,) = P.permanova(df.filter("label = 'l0'"), "id", "label", "x", 5, "s").collect()
    assert one["r2"] is None and one["p"] is None
    (none,) = P.permanova(df.limit(0), "id", "label", "x", 5, "s").collect()
    assert none["r2"] is None


def test_classifier_of_each_draw_and_fold_equals_its_own_fit(spark):
    df, rows = vectors(spark, 160, dims=3, groups=2)
    sub = P.subjects(df, "id", "label", "x", "s").withColumn("fold", F.pmod(F.col("id") / 3, F.lit(3)).cast("long"))
    drawn = P.draw(sub, 4, "s")
    beta = permutations.classifier_rounds(sub, drawn, 3, 3, 1.0)
    own = sub.collect()
    ids = np.array([r["id"] for r in own])
    y = drawn.assign(np.array([r["u"] for r in own]), ids, drawn.places(P.pa.array([r["label"] for r in own])))
    x, fold = np.array([r["x"] for r in own]), ids // 3 % 3
    for d in range(5):
        for f in range(3):
            assert beta[d * 3 + f] == pytest.approx(plain.logistic_l2(x[fold != f], (y[fold != f, d] == 1).astype(float)), abs=1e-6)


def test_candidates_are_scored_on_folds_that_their_fit_has_not_seen(spark):
    df, g, t, e, x, fold = subjects(spark, 240, seed=3, ties=0)
    cv = models.cross_validated(M.pack(df, "grp", NAMES, "fold", "id"), [M.Fit(l2=1.0), M.Fit(l2=50.0)])
    got = {(r["grp"], r["outer"], r["candidate"]): r for r in cv.collect()}
    assert len(got) == 12

    def concordance(test, beta):
        r, a, b = x[test] @ beta, t[test], e[test]
        pairs = [(r[i] > r[j]) + 0.5 * (r[i] == r[j]) for i in range(len(r)) if b[i] for j in range(len(r)) if a[j] > a[i]]
        return np.mean(pairs)

    for k in range(2):
        for outer in range(3):
            for c, l2 in enumerate((1.0, 50.0)):
                inner = []
                for f in {0, 1, 2} - {outer}:
                    seen = (g == k) & (fold != outer) & (fold != f)
                    inner.append(concordance((g == k) & (fold == f), plain.ridge_cox(t[seen], e[seen], x[seen], l2)[0]))
                r = got[f"g{k}", outer, c]
                assert r["inner_c"] == pytest.approx(np.mean(inner), abs=1e-6)
                seen = (g == k) & (fold != outer)
                assert r["outer_c"] == pytest.approx(concordance((g == k) & (fold == outer), plain.ridge_cox(t[seen], e[seen], x[seen], l2)[0]), abs=1e-6)
                assert r["converged"]
