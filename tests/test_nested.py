"""JSON walks against a recursive walk; checkpoints with every link of their chain broken."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import checkpoints, documents
from tarn.sources import tables


def walk(x, path="$"):
    if isinstance(x, dict):
        return [leaf for k, v in x.items() for leaf in walk(v, f"{path}.{k}")]
    if isinstance(x, list):
        return [leaf for i, v in enumerate(x) for leaf in walk(v, f"{path}[{i}]")]
    return [(path, x)]


def first(x, key):
    """The first hit depth first, an object's own field before what its others hold."""
    if isinstance(x, dict):
        if key in x:
            return x[key]
        x = list(x.values())
    for v in x if isinstance(x, list) else ():
        hit = first(v, key)
        if hit is not None:
            return hit
    return None


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([1, -7, "text", "", '{"k": 1}', "[2]", True, False, None, "é\"\\", "k"])
    if kind < 0.7:
        return {rng.choice(["k", "a", "b", "c.d", "", "z"]): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [made(rng, depth - 1) for _ in range(rng.randrange(4))]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    deep = {"k": 3}
    for i in range(14):
        deep = [deep] if i % 2 else {"a": deep}
    return [made(rng, 5) for _ in range(200)] + [deep, {"y": {"k": None, "u": {"k": 5}}, "z": [{"w": {"k": {"m": 1}}}]}, {}, [], 4, "s", None]


def frame(spark, docs):
    bad = [(1000, None), (1001, "no json"), (1002, '{"a": 1, "a": {"k": 2}}'), (1003, "")]
    return spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(docs)] + bad, "id long, doc string")


def as_text(v):
    return None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def test_leaves_are_those_of_a_recursive_walk(spark, docs):
    got = sorted((r["id"], r["at"], r["path"], r["value"]) for r in documents.leaves(frame(spark, docs), "doc", ["id"]).collect())
    want = [(i, path, as_text(v)) for i, x in enumerate(docs) for path, v in walk(x)]
    assert [(i, p, v) for i, _, p, v in got] == want  # also in depth-first order


def test_first_key_is_that_of_a_recursive_search(spark, docs):
    got = {r["id"]: r["value"] for r in documents.first_with_key(frame(spark, docs), "doc", ["id"], "k").collect()}
    want = {i: as_text(first(x, "k")) for i, x in enumerate(docs) if first(x, "k") is not None}
    assert got == want
    assert documents.first_with_key(frame(spark, []), "doc", ["id"], "k").collect() == []


def test_paths_are_counted_as_leaves_are(spark, docs):
    more = ['{"a": [1.5, 1e3, 12345678901234567890, -0]}', '{"b": "\\u00e9", "c[1]": [[2]]}', '{"a": 1} ', '[NaN]', "[1, {}]", '{"n": -7, "t": [true, null]}']
    df = frame(spark, docs).unionByName(spark.createDataFrame([(2000 + i, x) for i, x in enumerate(more)], "id long, doc string"))
    found = documents.leaves(df, "doc", ["id"])
    want = found.groupBy(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "kind").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, documents.path_counts(df, "doc").collect())) == sorted(map(tuple, want.collect()))
    again = documents._first_by_rounds(df, "doc", ["id"], "k").collect()
    assert sorted(map(tuple, documents.first_with_key(df, "doc", ["id"], "k").collect())) == sorted(map(tuple, again))


def doubled(rows):
    return rows.groupBy("key").agg(F.sum("x").alias("s"), F.max("t").alias("t"))


def state(run):
    return {r["key"]: r["reused"] for r in run.manifest.collect()}


def test_each_broken_link_recomputes_its_keys_alone(spark, tmp_path):
    folder, contract = str(tmp_path / "step"), {"step": 1}
    x = spark.createDataFrame([(k % 4, float(k), None if k % 3 else "t") for k in range(20)], "key int, x double, t string")
    done = checkpoints.resume(x, "key", contract, doubled, folder)
    assert set(state(done).values()) == {False}
    want = sorted(doubled(x).collect())
    calls = []

    def watched(rows):
        calls.append(sorted({r["key"] for r in rows.select("key").collect()}))
        return doubled(rows)

    # Nothing changed, whatever the rows' order and partitions.
    again = checkpoints.resume(x.repartition(5), "key", contract, watched, folder)
    assert set(state(again).values()) == {True} and sorted(again.output.collect()) == want and calls == [[]]
    # The input: a value, a null for an empty text, a row more, a key more; a key less.
    for change, touched in (
        (x.withColumn("x", F.when(F.col("x") == 5, 5.5).otherwise(F.col("x"))), [1]),
        (x.withColumn("t", F.when(F.col("x") == 10, "").otherwise(F.col("t"))), [2]),
        (x.unionByName(x.filter("x = 3")), [3]),
        (x.unionByName(spark.createDataFrame([(9, 1.0, "t")], x.schema)), [9]),
        (x.filter("key <> 0"), []),
    ):
        # The keys before this change that differ now are recomputed too; go back first.
        checkpoints.resume(x, "key", contract, doubled, folder)
        calls.clear()
        run = checkpoints.resume(change, "key", contract, watched, folder)
        assert calls == [touched]
        assert sorted(k for k, reused in state(run).items() if not reused) == touched
        assert sorted(run.output.collect(), key=str) == sorted(doubled(change).collect(), key=str)
    checkpoints.resume(x, "key", contract, doubled, folder)
    # The contract.
    calls.clear()
    checkpoints.resume(x, "key", {"step": 2}, watched, folder)
    assert calls == [[0, 1, 2, 3]]
    # The stored output: one row changed, one gone.
    for n, spoil in enumerate((lambda o: o.withColumn("s", F.when(F.col("key") == 2, 0.0).otherwise(F.col("s"))), lambda o: o.filter("key <> 1"))):
        at = tables.json_document(spark, f"{folder}/current.json", "output string, manifest string").first()
        spoilt = str(tmp_path / f"spoilt{n}")
        spoil(spark.read.parquet(at["output"])).write.parquet(spoilt)
        tables.write_document(spark, f"{folder}/current.json", {"output": spoilt, "manifest": at["manifest"]})
        calls.clear()
        run = checkpoints.resume(x, "key", {"step": 2}, watched, folder)
        assert len(calls) == 1 and len(calls[0]) == 1 and sorted(run.output.collect()) == want


def test_a_run_that_breaks_leaves_the_last_state(spark, tmp_path):
    folder = str(tmp_path / "step")
    x = spark.createDataFrame([(k % 3, float(k), "t") for k in range(9)], "key int, x double, t string")
    checkpoints.resume(x, "key", {}, doubled, folder)
    with pytest.raises(ZeroDivisionError):
        checkpoints.resume(x.filter("x > 0"), "key", {}, lambda rows: 1 / 0, folder)
    assert set(state(checkpoints.resume(x, "key", {}, doubled, folder)).values()) == {True}


def test_steps_chain_by_their_digests(spark, tmp_path):
    x = spark.createDataFrame([(k % 3, float(k), "t") for k in range(9)], "key int, x double, t string")
    flat = lambda rows: rows.select("key", (F.col("x") > 3).alias("high"))

    def chain(rows):
        a = checkpoints.resume(rows, "key", {"n": 1}, flat, str(tmp_path / "a"))
        b = checkpoints.resume(a.output, "key", {"n": 2}, lambda r: r.groupBy("key").agg(F.count_if("high").alias("n")), str(tmp_path / "b"))
        return state(a), state(b)

    assert all(not v for s in chain(x) for v in s.values())
    # The first step's input differs, but not its output, so the second one is reused.
    a, b = chain(x.withColumn("x", F.when(F.col("x") == 8, 80.0).otherwise(F.col("x"))))
    assert a == {0: True, 1: True, 2: False} and set(b.values()) == {True}
