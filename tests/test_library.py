"""Functions and operators against identities, published tables and brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.functions import kernels, scalars, stats
from tarn.operators import audit, fits, moments, relational, resample, survival
from tarn.sources import tables
from tarn.streaming import rates

from . import brute as plain


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_special_functions():
    assert kernels.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert kernels.t_two_sided(0, 5) == pytest.approx(1)
    assert kernels.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert kernels.chi2_tail(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    for a, b, x in ((2.0, 3.0, 0.4), (0.5, 0.5, 0.9), (10, 2, 0.7)):
        assert kernels.beta_inc(a, b, x) + kernels.beta_inc(b, a, 1 - x) == pytest.approx(1)
    assert kernels.beta_inc(1, 1, 0.3) == pytest.approx(0.3)
    assert kernels.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.485714, abs=1e-6)
    assert kernels.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)


def test_cox_gradient_and_ties():
    rng = np.random.default_rng(0)
    x, t, e = rng.normal(size=(60, 3)), rng.integers(1, 15, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    b = rng.normal(size=3) * 0.3
    loss, g, h = plain.cox_terms(t, e, x @ b, x)
    for j in range(3):
        step = np.eye(3)[j] * 1e-5
        up, down = (plain.cox_terms(t, e, x @ (b + s), x) for s in (step, -step))
        assert (up[0] - down[0]) / 2e-5 == pytest.approx(g[j], rel=1e-4, abs=1e-6)
        assert (up[1] - down[1]) / 2e-5 == pytest.approx(h[j], rel=1e-4, abs=1e-5)
    brute = -sum(x[i] @ b - math.log(sum(math.exp(x[k] @ b) for k in range(60) if t[k] >= t[i])) for i in range(60) if e[i])
    assert loss == pytest.approx(brute)
    beta, fine = plain.ridge_cox(t, e, x, penalty=1.0)
    assert fine and np.abs(plain.cox_terms(t, e, x @ beta, x)[1] + beta).max() < 1e-4
    path = plain.elastic_net_cox(t, e, x, np.array([10.0, 0.1, 0.0]), 1.0)
    assert (path[0] == 0).all() and np.allclose(path[2], plain.ridge_cox(t, e, x)[0], atol=1e-3)


def test_concordance_kernel_equals_pairs():
    rng = np.random.default_rng(1)
    t, e, r, w = rng.integers(1, 20, 80).astype(float), rng.integers(0, 2, 80), rng.integers(0, 6, 80).astype(float), rng.uniform(0.5, 2, 80)
    num = den = 0.0
    for i in range(80):
        for j in range(80):
            if e[i] and t[i] < 15 and t[j] > t[i]:
                num += w[i] * (1.0 if r[i] > r[j] else 0.5 if r[i] == r[j] else 0.0)
                den += w[i]
    assert plain.uno_c(t, e, r, w, 15) == pytest.approx(num / den)
    assert plain.uno_c(t, np.zeros(80), r, w, 15) is None


def test_coral_keeps_the_spread():
    rng = np.random.default_rng(2)
    a, b = (m @ m.T for m in rng.normal(size=(2, 4, 4)))
    beta = rng.normal(size=4)
    moved = kernels.coral(beta, a, b)
    assert moved @ b @ moved == pytest.approx(beta @ a @ beta, rel=1e-6)


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 0), ("a", 2.0, 1), ("a", 3.0, 1), ("a", 3.0, 1)], "g string, time double, event int")
    km = {r["t"]: r["s"] for r in rows(survival.kaplan_meier(df, ["g"]))}
    assert km == pytest.approx({1.0: 0.8, 2.0: 0.6, 3.0: 0.0})
    g = {r["t"]: r["s"] for r in rows(survival.kaplan_meier(df, ["g"], flip=True))}
    assert g == pytest.approx({1.0: 1.0, 2.0: 0.75, 3.0: 0.75})


def test_asof_limits(spark):
    steps = spark.createDataFrame([("a", 2.0, 0.5), ("a", 4.0, 0.25)], "g string, t double, v double")
    q = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)], "g string, t double")
    right = {(r["g"], r["t"]): r["s"] for r in rows(relational.asof(q, steps, ["g"], "t", "t", "v", "s"))}
    left = {(r["g"], r["t"]): r["s"] for r in rows(relational.asof(q, steps, ["g"], "t", "t", "v", "s", left_limit=True))}
    assert right == {("a", 1.0): 1.0, ("a", 2.0): 0.5, ("a", 3.0): 0.5, ("b", 9.0): 1.0}
    assert left == {("a", 1.0): 1.0, ("a", 2.0): 1.0, ("a", 3.0): 0.5, ("b", 9.0): 1.0}


def test_nan_never_passes_a_threshold(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (0.5,)], "x double")
    r = df.agg(F.count_if(scalars.finite("x") >= 0.02).alias("n"), stats.finite_mean("x").alias("m")).first()
    assert (r.n, r.m) == (1, 0.5)


def test_guarded_correlation(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(5)] + [("v", float(i), float(2 * i)) for i in range(5)] + [("few", 1.0, 2.0)], "g string, x double, y double")
    r = {x["g"]: x["r"] for x in rows(df.groupBy("g").agg(stats.pearson("x", "y").alias("r")))}
    assert r["c"] is None and r["few"] is None and r["v"] == pytest.approx(1)


def test_quartile_cut_is_not_ntile(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(6)], "id int, x double").withColumn("g", F.lit(1))
    got = [r["bucket"] for r in sorted(rows(stats.quantile_bucket(df, "x", ["id"], ["g"])), key=lambda r: r["id"])]
    assert got == [1, 1, 2, 3, 4, 4]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(p)], "id int, p double, g int")
    q = {r["id"]: r["q"] for r in rows(stats.bh_adjust(df, "p", ["g"]))}
    assert [q[i] for i in range(5)] == [pytest.approx(0.02), pytest.approx(0.04), pytest.approx(0.04), pytest.approx(0.02), None]


def test_checked_join_refuses_duplicates(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(relational.CardinalityError):
        relational.checked_join(a, b, ["k"])
    assert relational.checked_join(a, b, ["k"], validate="one_to_many").count() == 3


def test_contract_lists_failures(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None)], "k int, x double")
    checks = audit.contract(df, {"unique": F.count("*") == F.count_distinct("k"), "some": F.count("x") > 0})
    assert {r["check_name"]: r["passed"] for r in rows(checks)} == {"unique": False, "some": True}
    with pytest.raises(audit.ContractError, match="unique"):
        audit.enforce(checks)
    with pytest.raises(audit.ContractError):
        audit.require_columns(df, ["missing"])
    with pytest.raises(audit.ContractError):
        audit.forbid_columns(df.withColumnRenamed("x", "survival_days"), ["survival"])


def test_identifiers(spark):
    df = spark.createDataFrame([("0514",), ("514.0",), ("5.5",), ("-3",), ("x",), (None,)], "v string")
    assert [r["i"] for r in rows(df.select(scalars.integer_id("v").alias("i")))] == ["514", "514", None, None, None, None]
    one = spark.createDataFrame([("cotc22-514",)], "v string")
    assert rows(one.select(scalars.trial_id("v").alias("t"))) == [{"t": "COTC022-0514"}]


def test_folds_are_balanced_and_stable(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id int, e int")
    a, b = (resample.stratified_folds(d, ["e"], "id", 5, "s") for d in (df, df.repartition(7)))
    assert sorted(map(str, rows(a))) == sorted(map(str, rows(b)))
    assert {r["count"] for r in rows(a.groupBy("fold", "e").count())} == {10}


def test_text_sources(spark, tmp_path):
    gmt = tmp_path / "a.gmt"
    gmt.write_text("S1\tdesc\ttp53\tTP53 \tbrca1\nbad\nS2\td\tx\n")
    got = {r["module"]: (r["genes"], r["source_gene_count"]) for r in rows(tables.gene_sets(spark, str(gmt), "L"))}
    assert got == {"S1": (["TP53", "BRCA1"], 3), "S2": (["X"], 1)}
    series = tmp_path / "s.txt"
    series.write_text('!title\t"t"\n!k = v1\n!k = v2\n!begin\n"id"\t"a"\ng1\t1\n!end\n')
    assert sorted(rows(tables.marked_table(spark, str(series), "!begin", "!end", ["id", "a"])), key=str) == [{"id": "g1", "a": "1"}, {"id": "id", "a": "a"}]
    assert [(r["key"], sorted(r["values"])) for r in rows(tables.key_values(spark, str(series)))] == [("k", ["v1", "v2"])]
    csv = tmp_path / "c.csv"
    csv.write_text("a;b;a\n1;2;3\n")
    assert tables.header_of(spark, str(csv), ";") == ["a", "b", "a"]
    doc = tmp_path / "d.json"
    doc.write_text('{"b": 1,\n "a": [1, 2]}')
    assert rows(tables.json_document(spark, str(doc), "a array<int>, b int")) == [{"a": [1, 2], "b": 1}]
    assert tables.inventory(spark, str(tmp_path)).count() == 4
    (m,) = rows(tables.manifest(spark, str(csv)))
    assert m["bytes"] == len(csv.read_bytes())


def test_stream_equals_table(spark, sf_dir, tmp_path):
    src = tmp_path / "in"
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.repartition(3).write.parquet(str(src))
    stream = rates.running_rates(rates.event_stream(spark, str(src)), late="3000 days")
    q = rates.write_rates(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"]): r["n"] for r in rows(spark.table("rates"))}
    assert got == {(r["start"], r["event_type"]): r["n"] for r in rows(rates.running_rates(e))}


def test_moments_and_axes(spark):
    from tarn.operators import moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) @ np.diag([3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "g int, v array<double>").repartition(3)
    for r in rows(moments.moments(df, "g", "v")):
        assert np.allclose(moments.covariance(r), np.cov(x[r["g"] :: 2].T, ddof=0))
    for r in rows(moments.principal_axes(moments.moments(df, "g", "v"), "g", 2)):
        mine = x[r["g"] :: 2]
        assert np.allclose(np.abs((mine - r["mean"]) @ np.array([r["axis0"], r["axis1"]]).T), np.abs(plain.principal_scores(mine, 2)))


def test_trial_ids_keep_long_numbers(spark):
    from tarn.functions import scalars

    got = spark.createDataFrame([("cotc22-12345",), ("cotc1234_7",)], "v string").select(scalars.trial_id("v").alias("t"))
    assert [r.t for r in got.collect()] == ["COTC022-12345", "COTC1234-0007"]


def subjects(spark, seed, groups=4, n=90):
    rng = np.random.default_rng(seed)
    data = []
    for g in range(groups):
        x = rng.normal(size=(n, 3))
        t, e = rng.integers(1, 25, n).astype(float), rng.integers(0, 2, n)
        data += [(f"g{g}", float(a), int(b), *map(float, z)) for a, b, z in zip(t, e, x, strict=True)]
    data += [("none", 1.0, 0, 0.1, 0.2, 0.3), ("none", 2.0, 0, 0.4, 0.5, 0.6)]
    arrays = {}
    for g in {r[0] for r in data}:
        own = [r for r in data if r[0] == g]
        arrays[g] = np.array([r[1] for r in own]), np.array([r[2] for r in own], float), np.array([r[3:] for r in own])
    return spark.createDataFrame(data, "g string, time double, event int, x1 double, x2 double, x3 double"), arrays


def test_cox_fits_by_sums_equal_one_group_fits(spark):
    df, arrays = subjects(spark, 1)
    centre = np.array([0.1, 0.0, -0.2])
    got = fits.newton(df, "g", ["x1", "x2", "x3"], lambda g: 1.0 if g == "g1" else 5.0, centre)
    for g, (t, e, x) in arrays.items():
        want, _ = plain.ridge_cox(t, e, x, 1.0 if g == "g1" else 5.0, centre)
        assert got[g][1] and got[g][0] == pytest.approx(want, abs=1e-5)


def test_a_fit_without_an_optimum_is_given_up(spark):
    df = spark.createDataFrame([("a", float(k), 1, float(-k)) for k in range(1, 9)], "g string, time double, event int, x1 double")
    assert not fits.newton(df, "g", ["x1"], lambda _: 0.0, cap=20.0)["a"][1]


def test_logistic_fit_by_sums_equals_one_group_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.0, -0.5] + rng.logistic(size=200) > 0.3).astype(int)
    df = spark.createDataFrame([("a", float(a), float(b), 1.0, int(c)) for (a, b), c in zip(x, y, strict=True)], "g string, x1 double, x2 double, one double, y int")
    got, fine = fits.newton(df, "g", ["x1", "x2", "one"], lambda _: np.array([1.0, 1.0, 1e-10]), terms=fits.logistic_terms)["a"]
    assert fine and got == pytest.approx(plain.logistic_l2(x, y), abs=1e-6)


def test_concordance_by_sums_equals_pairs(spark):
    df, arrays = subjects(spark, 6)
    df = df.withColumnRenamed("g", "grp").withColumn("risk", F.round("x1", 1)).withColumn("m", (F.floor(F.abs("x2") * 3)).cast("int"))
    got = {r["grp"]: r["c"] for r in rows(survival.uno_fast(df, "grp"))}
    assert got["none"] is None
    for g, (t, e, x) in arrays.items():
        if g != "none":
            assert got[g] == pytest.approx(plain.uno_c(t, e, np.round(x[:, 0], 1), np.ones(len(t)), np.inf))
    tau = df.groupBy("grp").agg(F.lit(15.0).alias("tau"))
    fast, pairs = ({r["grp"]: r["c"] for r in rows(d)} for d in (survival.uno_fast(df, "grp", tau), survival.uno_pairs(df, ["grp"], tau)))
    assert all(fast[g] == pytest.approx(pairs[g]) for g in pairs)
    often = df.withColumn("k", F.explode(F.expr("sequence(1, greatest(m, 1))"))).filter("m > 0")
    once, repeated = ({r["grp"]: r["c"] for r in rows(d)} for d in (survival.uno_fast(df, "grp", times="m"), survival.uno_fast(often, "grp")))
    assert all(once[g] == pytest.approx(repeated[g]) for g in repeated if g != "none")


def test_pairs_of_a_large_group_are_counted_in_blocks(spark):
    n = 100_000  # thousands of millions of pairs
    df = spark.range(n).select(F.lit("a").alias("grp"), (F.col("id") * 7919 % 1000).cast("double").alias("time"), (F.col("id") % 3).cast("int").alias("event"), (F.col("id") * 104729 % 5003).cast("double").alias("risk"))
    tau = df.groupBy("grp").agg(F.lit(900.0).alias("tau"))
    (fast,), (pairs,) = rows(survival.uno_fast(df, "grp", tau)), rows(survival.uno_pairs(df, ["grp"], tau))
    assert pairs["c"] == pytest.approx(fast["c"])
    # A risk that is unknown is in pairs, but never the lower one; NaN is the highest.
    odd = spark.createDataFrame([(1, 1.0, 1, None), (1, 2.0, 1, 3.0), (1, 3.0, 1, float("nan")), (1, 4.0, 0, 2.0), (1, 5.0, 0, None), (2, 1.0, 0, 1.0)], "grp int, time double, event int, risk double")
    (r,) = rows(survival.uno_pairs(odd, ["grp"], odd.groupBy("grp").agg(F.lit(9.0).alias("tau"))))
    assert r["grp"] == 1 and r["c"] == pytest.approx((0 + 1 + 1) / (4 + 3 + 2))


def test_principal_axes_equal_a_decomposition(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, id long, v array<double>")
    axes = moments.principal_axes(moments.moments(df, "g", "v"), "g", 2).first()
    got = (x - np.array(axes["mean"])) @ np.array([axes["axis0"], axes["axis1"]]).T
    assert got == pytest.approx(plain.principal_scores(x, 2), abs=1e-6)


def test_files_are_discovered_by_priority_and_overlap(spark, tmp_path):
    for name, ids in (("a_full/x", range(10)), ("a_part/x", range(5)), ("b/x", range(10)), ("a_backup/x", range(10))):
        f = tmp_path / f"{name}.csv"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("id,v\n" + "".join(f"{i},1\n" for i in ids))
    found = tables.discover(spark, str(tmp_path), [r"/a_[^/]+/", r"csv$"], ["_backup/"])
    ids = spark.createDataFrame([(str(i),) for i in range(10)], "id string")
    got = {r["path"].split("/")[-2]: (r["priority"], r["overlap"], r["chosen"]) for r in rows(tables.by_overlap(spark, found, ids, "id"))}
    assert got == {"a_full": (1, 1.0, True), "a_part": (1, 0.5, False), "b": (2, 1.0, False)}
    assert rows(tables.by_overlap(spark, found.filter("false"), ids, "id")) == []


def test_frozen_tables_must_stay_the_same(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "frozen")
    assert [tables.freeze_or_verify(x, path) for x in (df, df.orderBy("v"), df.distinct(), df.withColumn("k", F.col("k").cast("long")))] == ["frozen", "verified", "changed", "changed"]


def test_columns_are_chosen_by_name():
    got = tables.choose_columns(["o_date", "o_update", "x_status_code", "price"], ["date", "status", "price", "absent"], "o_")
    assert got == [("date", "o_date", 3), ("status", "x_status_code", 1), ("price", "price", 3)]


def test_frontier_of_two_equals_all_pairs(spark):
    rng = np.random.default_rng(11)
    data = [(f"g{i % 3}", i, float(rng.integers(0, 12)) + float(rng.choice([0, 5e-13])), float(rng.integers(0, 12))) for i in range(150)]
    data += [("g0", 900, None, 1.0), ("g0", 901, 3.0, None), ("g9", 902, 1.0, 1.0), ("g9", 903, 1.0, 1.0), (None, 904, 1.0, 2.0), (None, 905, 2.0, 2.0)]
    got = {r["id"] for r in rows(relational.not_dominated(spark.createDataFrame(data, "g string, id long, gain double, harm double"), ["g"], ["gain"], ["harm"]))}
    t, want = 1e-12, set()
    for g, i, x, y in data:
        rivals = [(a, b) for h, _, a, b in data if h == g and None not in (a, b, x, y)]
        if not any(a >= x - t and b <= y + t and (a > x + t or b < y - t) for a, b in rivals):
            want.add(i)
    assert got == want


def test_marked_tables_of_files_in_many_blocks(spark, tmp_path):
    folder = tmp_path / "marked"
    folder.mkdir()
    for k, n in enumerate((5, 300, 40)):
        body = "\n".join(f"{k}-{i}\t\"{'x' * (i % 13)}\"" for i in range(n))
        (folder / f"{k}.txt").write_text(f"before\tx\n!b\n{body}\n!e\nafter\tx\n!b\n!e\nlast\tx\n")
    (folder / "none.txt").write_text("no\tmarks\n!b\nopen\tx\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        got = tables.marked_table(spark, str(folder), "!b", "!e", ["id", "x"])
        assert got.rdd.getNumPartitions() > 1
        got = sorted((r["id"], r["x"]) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((f"{k}-{i}", "x" * (i % 13)) for k, n in enumerate((5, 300, 40)) for i in range(n))


def test_fisher_of_any_margins():
    def by_listing(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = [math.comb(k, i) * math.comb(n - k, r - i) / math.comb(n, r) for i in range(max(0, r + k - n), min(r, k) + 1)]
        return sum(x for x in p if x <= p[a - max(0, r + k - n)] + 1e-15)

    for t in ((0, 0, 0, 0), (0, 5, 7, 0), (3, 1, 1, 3), (40, 300, 25, 310), (1, 0, 0, 900), (200, 3, 5, 100)):
        assert kernels.fisher_two_sided(*t) == pytest.approx(by_listing(*t), abs=1e-9)
    # The table itself always counts, whatever its likelihood rounds to.
    assert kernels.fisher_two_sided(242, 1834, 37, 304) == pytest.approx(0.7151654179, abs=1e-9)
    assert 0 < kernels.fisher_two_sided(250_000_000, 250_010_000, 250_010_000, 250_000_000) < 1
    assert kernels.fisher_two_sided(10**8, 10**7, 10**7, 10**8) == pytest.approx(0, abs=1e-10)


def test_means_of_bootstrap_means_draw_sums_by_size(spark, monkeypatch):
    df = spark.createDataFrame([(f"c{g % 2}", g, k, float(g * k % 11)) for g in range(12) for k in range(3 + g % 5)], "c string, g int, k int, v double")
    each = resample.bootstrap_means(df, ["c", "g"], "k", "v", 70, "x").groupBy("c", "draw").agg(F.avg("m").alias("m"))
    want = {(r["c"], r["draw"]): r["m"] for r in each.collect()}
    for gathered in (resample.GATHERED, 5):
        monkeypatch.setattr(resample, "GATHERED", gathered)
        got = {(r["c"], r["draw"]): r["m"] for r in resample.mean_of_bootstrap_means(df, "g", "c", "k", "v", 70, "x").collect()}
        assert got == pytest.approx(want)


def test_resampled_rows_are_counted_without_a_row_per_draw(spark, monkeypatch):
    monkeypatch.setattr(resample, "PLACES", 8)
    monkeypatch.setattr(resample, "AT_ONCE", 16)
    sizes = {"a": 1, "b": 50, "c#|": 23}
    df = spark.createDataFrame([(g, i, n, f"{g}{i}") for g, n in sizes.items() for i in range(n)], "g string, i long, n long, name string")
    got = {(r["g"], r["i"]): r["times"] for r in resample.multiplicities(df, "g", "i", "n", 4, "s").collect() if r["name"] == f"{r['g']}{r['i']}"}
    want = {(g, i): [0] * 4 for g, n in sizes.items() for i in range(n)}
    for g, n in sizes.items():
        for d in range(4):
            for i in range(n):
                want[g, int(hashlib.sha256(f"s|{d}|{g}|{i}".encode()).hexdigest()[:8], 16) % n][d] += 1
    assert got == want


def test_bootstraps_of_large_groups_draw_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(f"g{k % 3}", k, float(k * k % 17)) for k in range(90) if k % 3 or k < 30], "g string, k int, v double")
    few = {(r["g"], r["draw"]): r["m"] for r in resample.bootstrap_means(df, ["g"], "k", "v", 70, "s").collect()}
    monkeypatch.setattr(resample, "GATHERED", 20)
    monkeypatch.setattr(resample, "DRAWS_AT_ONCE", 7)
    many = {(r["g"], r["draw"]): r["m"] for r in resample.bootstrap_means(df, ["g"], "k", "v", 70, "s").collect()}
    assert len(few) == 210 and few.keys() == many.keys()
    assert all(few[k] == pytest.approx(many[k]) for k in few)


def test_curves_just_before_each_time(spark):
    rng = np.random.default_rng(2)
    data = [(f"g{i % 2}", float(rng.integers(1, 12)), int(rng.integers(2)), i) for i in range(80)] + [("g0", None, 0, 900)]
    df = spark.createDataFrame(data, "g string, time double, event int, i int")
    got = {r["i"]: r["g_"] for r in survival.with_censoring_weight(df.withColumnRenamed("g", "grp"), ["grp"]).withColumnRenamed("g", "g_").collect()}
    for g, t, _, i in data:
        s = 1.0
        for u in sorted({r[1] for r in data if r[0] == g and r[1] is not None and t is not None and r[1] < t}):
            risk = [r for r in data if r[0] == g and r[1] is not None and r[1] >= u]
            s *= 1 - sum(r[1] == u and r[2] == 0 for r in risk) / len(risk)
        assert got[i] == pytest.approx(s)


def test_presence_and_looks(spark):
    df = spark.createDataFrame([(1, "2001-02-03", "A", 1.5), (2, None, "A", 2.5), (3, "no date", "B", None)], "o_key int, o_date string, o_status string, o_price double")
    assert rows(audit.presence(df, ["o_key", "o_price", "absent"])) == [
        {"column_name": "o_key", "present": True, "n_rows": 3, "n_filled": 3},
        {"column_name": "o_price", "present": True, "n_rows": 3, "n_filled": 2},
        {"column_name": "absent", "present": False, "n_rows": 3, "n_filled": None},
    ]
    fit = {r["concept"]: r["fit"] for r in rows(tables.looks_like(df, tables.choose_columns(df.columns, ["date", "key", "status", "price"], "o_")))}
    assert fit == {"date": 0.333333, "key": 1.0, "status": 0.333333, "price": 0.666667}
