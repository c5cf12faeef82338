"""Contracts as data: checks are rows with a name, what was observed, and whether it passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not meet its contract."""


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    if missing := missing_columns(df, names):
        raise ContractError(f"missing columns: {missing}")


def forbidden_columns(df: DataFrame, words: Sequence[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def forbid_columns(df: DataFrame, words: Sequence[str]) -> None:
    if found := forbidden_columns(df, words):
        raise ContractError(f"forbidden columns: {found}")


def presence(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column_name, present, n_rows, n_filled``: of each name, whether it is there, and how many rows it has a value in."""
    there = [n for n in names if n in df.columns]
    row = df.agg(F.count("*").alias("n"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(there)))
    entries = [F.struct(F.lit(n).alias("column_name"), F.lit(n in there).alias("present"), F.col("n").alias("n_rows"), (F.col(f"c{there.index(n)}") if n in there else F.lit(None).cast("long")).alias("n_filled")) for n in names]
    return row.select(F.inline(F.array(*entries)))


def contract(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``check_name, passed``: every check is an aggregate expression, all in one pass over the table."""
    row = df.agg(*(F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(checks.values())))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("passed")) for i, n in enumerate(checks)))))


def enforce(checks: DataFrame) -> None:
    """Raise with the names of the checks that failed."""
    if failed := [r.check_name for r in checks.filter("NOT passed").collect()]:
        raise ContractError(f"failed: {failed}")


def replay(observed: DataFrame, expected: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Both sides of a recomputed table, their difference, and whether it is within tolerance; a missing side fails."""
    a = observed.select(*keys, F.col(value).alias("observed"))
    b = expected.select(*keys, F.col(value).alias("expected"))
    diff = F.abs(F.col("observed") - F.col("expected"))
    return a.join(b, list(keys), "full_outer").withColumn("abs_diff", diff).withColumn("passed", F.coalesce(diff <= tolerance, F.lit(False)))


def signature(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, n, signature`` that do not depend on the rows' order: how many rows, and the sum of their digests' first 60 bits.

    Digests are added up before they move, so no group's rows are gathered.
    """
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c not in by))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(digest).cast("string").alias("signature"))
