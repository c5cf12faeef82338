import random

import pytest

from tarn.operators.intervals import overlap_join


def sides(seed):
    rng = random.Random(seed)
    lengths = [0.0, 0.5, 1.0, 3.0, 40.0, 4000.0]
    make = lambda n: [(i, rng.choice("abx"), s := float(rng.randrange(-50, 300)) / rng.choice([1, 2]), s + rng.choice(lengths)) for i in range(n)]
    return make(160), make(120) + [(900, "a", None, 4.0), (901, "a", 4.0, None), (902, "a", 9.0, 3.0)]


@pytest.mark.parametrize("width", [None, 0.3, 7.0, 1e6])
def test_every_pair_once(spark, width):
    left, right = sides(2)
    a = spark.createDataFrame(left, "i int, k string, a double, b double")
    b = spark.createDataFrame(right, "j int, k string, c double, d double")
    meets = lambda x, y: None not in (y[2], y[3]) and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]
    df = overlap_join(a, b, ("a", "b"), ("c", "d"), ["k"], width)
    assert sorted((r["i"], r["j"]) for r in df.collect()) == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and meets(x, y))
    plan = df._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    free = overlap_join(a, b.drop("k"), ("a", "b"), ("c", "d"), width=width)
    assert sorted((r["i"], r["j"]) for r in free.collect()) == sorted((x[0], y[0]) for x in left for y in right if meets(x, y))


def test_a_long_interval_is_copied_into_few_buckets(spark):
    a = spark.createDataFrame([(0, 0.0, 1e9)] + [(i, float(i), i + 1.0) for i in range(1, 50)], "i int, a double, b double")
    b = spark.createDataFrame([(i, float(i), i + 1.0) for i in range(50)], "j int, c double, d double")
    df = overlap_join(a, b, ("a", "b"), ("c", "d"), width=1.0)
    assert df.count() == 50 + 49
    none = overlap_join(a.limit(0), b, ("a", "b"), ("c", "d"))
    assert none.collect() == [] and none.columns == ["i", "a", "b", "j", "c", "d"]
