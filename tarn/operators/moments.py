"""Sums, cross products and what follows from them, without gathering a group's vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row


def moments(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, n, s, ss``: count, sum and sum of outer products of each group's vectors of one length.

    Every batch is summed where it lies; only a row per batch and group is shuffled.
    """
    kind = df.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, n long, s array<double>, ss array<double>"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for g, v in pdf.dropna().groupby(group)[vector]:
                x = np.array(v.tolist(), float)
                rows.append((g, len(x), x.sum(0), (x.T @ x).reshape(-1)))
            yield pd.DataFrame(rows, columns=[group, "n", "s", "ss"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [int(pdf["n"].sum())], "s": [np.sum(pdf["s"].tolist(), 0)], "ss": [np.sum(pdf["ss"].tolist(), 0)]})

    return df.select(group, vector).mapInPandas(part, schema).groupBy(group).applyInPandas(total, schema)


def covariance(row: Row | pd.Series) -> np.ndarray:
    """Population covariance of a row of moments."""
    s = np.array(row["s"], float)
    return np.array(row["ss"], float).reshape(len(s), -1) / row["n"] - np.outer(s, s) / row["n"] ** 2


def principal_axes(sums: DataFrame, group: str, k: int) -> DataFrame:
    """``group, mean, axis0 ...``: the first k axes of each group, each with its largest loading positive."""
    kind = sums.schema[group].dataType.simpleString()
    names = [f"axis{i}" for i in range(k)]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                v = np.linalg.eigh(covariance(r))[1][:, ::-1][:, :k]
                v = v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])
                rows.append((r[group], np.array(r["s"]) / r["n"], *v.T))
            yield pd.DataFrame(rows, columns=[group, "mean", *names])

    return sums.mapInPandas(fit, f"{group} {kind}, mean array<double>, " + ", ".join(f"{n} array<double>" for n in names))
