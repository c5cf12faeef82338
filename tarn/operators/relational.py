"""Joins with stated cardinality, as-of lookups, reconciliation, dominance, set overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stage


class CardinalityError(ValueError):
    """A join's key is not as unique as was stated."""


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "key") -> None:
    """Raise if a key comes twice; one aggregated row reaches the driver."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise CardinalityError(f"{what} is not unique: {twice[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that first checks the sides it states to be unique."""
    if validate in ("one_to_one", "one_to_many"):
        require_unique(left, keys, "left key")
    if validate in ("one_to_one", "many_to_one"):
        require_unique(right, keys, "right key")
    return left.join(right, list(keys), how)


def reconcile(current: DataFrame, historical: DataFrame, key: str, value: str) -> DataFrame:
    """Each key as SAME, DIFFERENT, CURRENT_ONLY or HISTORICAL_ONLY."""
    a = current.select(key, F.col(value).alias("current"), F.lit(True).alias("_a"))
    b = historical.select(key, F.col(value).alias("historical"), F.lit(True).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "CURRENT_ONLY")
        .when(F.col("_a").isNull(), "HISTORICAL_ONLY")
        .when(F.col("current").eqNullSafe(F.col("historical")), "SAME")
        .otherwise("DIFFERENT")
    )
    return a.join(b, key, "full_outer").select(key, "current", "historical", status.alias("status"))


def asof(queries: DataFrame, steps: DataFrame, by: Sequence[str], at: str, step_at: str, value: str, name: str, before_first: float = 1.0, left_limit: bool = False) -> DataFrame:
    """A step function's value at each query: the last step at or before it (or strictly before).

    Steps and queries are sorted together in each group and the last step is carried on, so that the
    work is one sort instead of a range join.
    """
    tie = 0 if left_limit else 1
    q = queries.withColumn("_q", F.lit(True)).withColumn("_t", F.col(at)).withColumn("_o", F.lit(tie)).withColumn("_v", F.lit(None).cast("double"))
    s = steps.select(*by, F.lit(False).alias("_q"), F.col(step_at).alias("_t"), F.lit(1 - tie).alias("_o"), F.col(value).cast("double").alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = q.unionByName(s, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(w))
    return out.filter("_q").withColumn(name, F.coalesce(name, F.lit(before_first))).drop("_q", "_t", "_o", "_v")


def not_dominated(df: DataFrame, by: Sequence[str], larger: Sequence[str], smaller: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Rows that no other of their group matches everywhere and beats somewhere (a Pareto frontier).

    Two objectives need no pairs: a row is beaten on one if the best other value among rows ahead of it
    there, a step function, matches its own. More objectives are an anti join on inequalities in a group.
    """
    if len(larger) + len(smaller) == 2:
        return _not_dominated_on_two(df, by, [F.col(c) for c in larger] + [-F.col(c) for c in smaller], tolerance)
    a, b = df.alias("a"), df.alias("b")
    gains = [F.col(f"b.{c}") - F.col(f"a.{c}") for c in larger] + [F.col(f"a.{c}") - F.col(f"b.{c}") for c in smaller]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    matches, beats = [g >= -tolerance for g in gains], [g > tolerance for g in gains]
    return a.join(b, reduce(Column.__and__, [*same, *matches, reduce(Column.__or__, beats)]), "left_anti")


def _not_dominated_on_two(df: DataFrame, by: Sequence[str], goals: Sequence[Column], tolerance: float) -> DataFrame:
    rows = stage(df.withColumns({f"_goal{i}": g.cast("double") for i, g in enumerate(goals)}), "goals")
    out = rows
    for x, y in (("_goal0", "_goal1"), ("_goal1", "_goal0")):
        ahead = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        steps = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, (-F.col(x)).alias("_at")).agg(F.max(y).alias("_y"))
        steps = steps.withColumn("_best", F.max("_y").over(ahead)).select(*by, "_at", "_best")
        out = asof(out.withColumn("_ask", -F.col(x) - tolerance), steps, by, "_ask", "_at", "_best", "_rival", before_first=float("-inf"), left_limit=True)
        out = out.filter(~F.coalesce(F.col("_rival") >= F.col(y) - tolerance, F.lit(False))).drop("_ask", "_rival")
    return out.select(*df.columns)


def overlaps(members: DataFrame, group: str, item: str) -> DataFrame:
    """``a, b, n_a, n_b, n_both, jaccard, over_smaller`` for all pairs of groups that share an item."""
    m = members.select(group, item).distinct()
    sizes = m.groupBy(group).agg(F.count("*").alias("n"))
    a, b = m.select(F.col(group).alias("a"), item), m.select(F.col(group).alias("b"), item)
    both = a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    out = both.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "n_a", "n_b", "n_both", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"), (F.col("n_both") / F.least("n_a", "n_b")).alias("over_smaller"))


def first_complete_key(left: DataFrame, right: DataFrame, transforms: dict[str, tuple[Column, Column]]) -> str | None:
    """The first transform whose keys are unique on both sides and cover the left side, or None."""
    for name, (a, b) in transforms.items():
        x, y = left.select(a.alias("k")), right.select(b.alias("k"))
        n = x.agg(F.count("*"), F.count("k"), F.count_distinct("k")).first()
        m = y.agg(F.count("k"), F.count_distinct("k")).first()
        if n[0] == n[1] == n[2] and m[0] == m[1] and x.join(y, "k", "left_anti").isEmpty():
            return name
    return None


def crosswalk(values: DataFrame, mapping: DataFrame, source: str, target: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """Values carried from source to target keys along a sparse mapping, added up by target; unmapped ones are dropped."""
    return values.join(mapping, source).groupBy(*by, target).agg(F.sum(weight).alias(weight))
