"""Connected components over an edge table, as rounds of joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage

_PAIR = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of some edges: each node is linked to the least node it reaches, at most one edge a node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def contract(edges: DataFrame) -> DataFrame:
    """Each partition's edges replaced by a spanning forest, a bounded batch after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.mapInArrow(run, _PAIR)


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: for every node of ``edges(a, b)`` the least node that it reaches.

    Rounds of large-star and small-star steps: a node's neighbours are linked to its least neighbour,
    until the edges are stars. A hub's minimum is aggregated before it is shuffled, and its edges meet
    it in a join, whose hot keys Spark can split; no node's edges are gathered.
    """
    edges = stage(contract(edges.select("a", "b").filter("a <> b")).distinct(), "edges")
    before = None
    while True:
        # Large star: u's greater neighbours go to the least of u and its neighbours.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "edges")
        # Small star: u, and its lesser neighbours, go to the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = stage(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        drop(edges, large)
        edges = small
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
