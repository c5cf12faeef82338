"""Search in JSON documents of any shape and depth: a round of explodes per level, nothing is shuffled to walk.

A node is held as its VARIANT, which knows its type, and as its text, which knows the order of its fields;
a level's containers are exploded into their children until none is left. Children keep ``at``, the places on
the way to them, so a document's depth-first order is the order of these arrays.

Defined results: documents that are null or not valid JSON, or that hold a field twice in one object, have no
nodes; scalars at the root are leaves with the path ``$``; empty containers have no leaves.

Most documents need no rounds: where all that is asked for are counts or one hit, a document that is plain (objects and arrays of texts,
whole numbers, booleans and nulls, of bounded depth and size) is parsed once, in a task. All others take the rounds.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import drop, stage


def _kind(node: str = "node") -> Column:
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def _roots(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    text = F.col(column).cast("string")
    nodes = df.select(*ids, F.array().cast("array<int>").alias("at"), F.lit("$").alias("path"), text.alias("text"), F.try_parse_json(text).alias("node"))
    return nodes.filter("node IS NOT NULL").withColumn("kind", _kind())


def _children(nodes: DataFrame, ids: Sequence[str], first: str | None = None) -> DataFrame:
    """All children of the containers among ``nodes``; of objects with a field ``first``, that one alone."""
    texts = F.map_entries(F.from_json("text", "map<string,string>"))
    nodes_of = F.map_values(F.from_json("text", "map<string,variant>"))
    fields = F.transform(F.arrays_zip(texts.alias("e"), nodes_of.alias("n")), lambda z: F.struct(z["e"]["key"].alias("key"), z["e"]["value"].alias("text"), z["n"].alias("node")))
    if first is not None:
        own = F.filter(fields, lambda z: z["key"] == first)
        fields = F.when(F.size(own) > 0, own).otherwise(fields)
    values = F.arrays_zip(F.from_json("text", "array<string>").alias("t"), F.from_json("text", "array<variant>").alias("n"))
    items = F.transform(values, lambda z: F.struct(F.lit(None).cast("string").alias("key"), z["t"].alias("text"), z["n"].alias("node")))
    below = F.when(F.col("kind") == "OBJECT", fields).otherwise(items)
    out = nodes.filter(F.col("kind").isin("OBJECT", "ARRAY")).select(*ids, "at", "path", F.posexplode(below).alias("place", "child"))
    step = F.when(F.col("child.key").isNotNull(), F.concat(F.lit("."), F.col("child.key"))).otherwise(F.concat(F.lit("["), F.col("place").cast("string"), F.lit("]")))
    out = out.select(*ids, F.concat("at", F.array("place")).alias("at"), F.concat("path", step).alias("path"), F.col("child.text").alias("text"), F.col("child.node").alias("node"), F.col("child.key").alias("key"))
    return out.withColumn("kind", F.coalesce(_kind(), F.lit("VOID")))


#: Depth and bytes of a document that is walked in one go.
DEEP, LARGE = 64, 1 << 22
_KINDS = {str: "STRING", int: "BIGINT", bool: "BOOLEAN", type(None): "VOID"}


class _NotPlain(Exception):
    pass


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _NotPlain
    return out


def _whole(text: str) -> int:
    if len(text) > 18 or text == "-0":
        raise _NotPlain
    return int(text)


def _no(text: str) -> None:
    raise _NotPlain


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_whole, parse_float=_no, parse_constant=_no)


def _walked(doc: bytes, walk: Callable):
    """What ``walk`` gives for a plain document; raises one of ``_OTHERS`` for any other."""
    if len(doc) > LARGE or b"\\u" in doc:
        raise _NotPlain
    root = _DECODER.decode(doc.decode())
    if type(root) is not dict and type(root) is not list:
        raise _NotPlain
    return walk(root)


_OTHERS = (_NotPlain, ValueError, RecursionError)


def _tally(x, path: str, found: list, depth: int) -> None:
    if depth > DEEP:
        raise _NotPlain
    for k, v in x.items() if type(x) is dict else (("", v) for v in x):
        if "[" in k or "]" in k:
            raise _NotPlain
        at = f"{path}.{k}" if type(x) is dict else path + "[]"
        kind = _KINDS.get(type(v))
        if kind:
            found.append((at, kind))
        else:
            _tally(v, at, found, depth + 1)


def _first(x, key: str, path: str, depth: int) -> tuple | None:
    if depth > DEEP:
        raise _NotPlain
    if type(x) is dict:
        if key in x:
            return None if x[key] is None else (f"{path}.{key}", x[key])
        below = ((f"{path}.{k}", v) for k, v in x.items())
    else:
        below = ((f"{path}[{i}]", v) for i, v in enumerate(x))
    for at, v in below:
        if (type(v) is dict or type(v) is list) and (hit := _first(v, key, at, depth + 1)):
            return hit
    return None


def path_counts(df: DataFrame, column: str) -> DataFrame:
    """``path, kind, n``: how many scalars each path leads to, with places in arrays left out (``[]``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rest = Counter(), []
            for doc in batch.column(0).to_pylist():
                found: list = []
                try:
                    _walked(doc, lambda root, found=found: _tally(root, "$", found, 0))
                    counts.update(found)
                except _OTHERS:
                    rest.append(doc)
            none = [None] * len(rest)
            out = ([k[0] for k in counts] + none, [k[1] for k in counts] + none, [*counts.values()] + none, [None] * len(counts) + rest)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "kind", "n", "rest"])

    docs = df.select(F.col(column).cast("string").cast("binary").alias("doc")).filter("doc IS NOT NULL")
    parts = stage(docs.mapInArrow(run, "path string, kind string, n long, rest binary"), "paths")
    counts, rest = parts.filter("rest IS NULL").select("path", "kind", "n"), parts.filter("rest IS NOT NULL")
    if not rest.isEmpty():
        found = leaves(rest.select(F.col("rest").cast("string").alias("doc")), "doc", [])
        counts = counts.unionByName(found.select(F.regexp_replace("path", r"\[\d+\]", "[]").alias("path"), "kind", F.lit(1).cast("long").alias("n")))
    return counts.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def leaves(df: DataFrame, column: str, ids: Sequence[str]) -> DataFrame:
    """``ids, at, path, kind, value``: every scalar of every document, with where it is. As deep as documents go."""
    level, found = stage(_roots(df, column, ids), "json"), []
    columns = [*ids, "at", "path", "kind", F.when(F.col("kind") != "VOID", F.col("text")).alias("value")]
    while True:
        # A string at the root still has its quotes as text; within a container it has none.
        own = level.withColumn("text", F.col("node").cast("string")) if not found else level
        found.append(stage(own.filter(~F.col("kind").isin("OBJECT", "ARRAY")).select(*columns), "leaves"))
        deeper = stage(_children(level, ids), "json")
        drop(level)
        if deeper.isEmpty():
            drop(deeper)
            break
        level = deeper
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def first_with_key(df: DataFrame, column: str, ids: Sequence[str], key: str) -> DataFrame:
    """``ids, path, kind, value``: for each document the first field called ``key``, depth first; documents without one are left out.

    An object's own field comes before all that its other fields hold. One that is null counts as no hit, and what
    is below its object isn't searched.
    """
    own = df.select(*ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, doc in enumerate(batch.column(len(batch.columns) - 1).to_pylist()):
                try:
                    hit = _walked(doc, lambda root: _first(root, key, "$", 0))
                    if hit:
                        path, v = hit
                        if type(v) not in _KINDS:
                            raise _NotPlain
                        rows.append((k, path, _KINDS[type(v)], v if type(v) is str else json.dumps(v), None))
                except _OTHERS:
                    rows.append((k, None, None, None, doc))
            at = pa.array([r[0] for r in rows], pa.int64())
            out = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.binary()), 1)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *out], [*batch.schema.names[:-1], "path", "kind", "value", "rest"])

    kinds = T.StructType([*own.schema.fields, *(T.StructField(c, T.StringType()) for c in ("path", "kind", "value")), T.StructField("rest", T.BinaryType())])
    docs = df.select(*ids, F.col(column).cast("string").cast("binary").alias("_doc")).filter("_doc IS NOT NULL")
    hits = stage(docs.mapInArrow(run, kinds), "hits")
    rest, hits = hits.filter("rest IS NOT NULL"), hits.filter("rest IS NULL").select(*ids, "path", "kind", "value")
    if rest.isEmpty():
        return hits
    return hits.unionByName(_first_by_rounds(rest.select(*ids, F.col("rest").cast("string").alias("_doc")), "_doc", ids, key))


def _first_by_rounds(df: DataFrame, column: str, ids: Sequence[str], key: str) -> DataFrame:
    level, found = stage(_roots(df, column, ids), "json"), []
    while not level.isEmpty():
        below = stage(_children(level, ids, first=key), "json")
        drop(level)
        hit = F.col("key").eqNullSafe(key)
        found.append(stage(below.filter(hit & (F.col("kind") != "VOID")).select(*ids, "at", "path", "kind", F.col("text").alias("value")), "hits"))
        level = stage(below.filter(~hit), "json")
        drop(below)
    drop(level)
    if not found:
        return df.select(*ids, *(F.lit("").alias(c) for c in ("path", "kind", "value"))).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    # The object's place orders hits, as it is met before anything below it.
    order = F.struct(F.slice("at", 1, F.size("at") - 1), "at")
    best = out.groupBy(*ids).agg(F.min_by(F.struct("path", "kind", "value"), order).alias("hit"))
    return best.select(*ids, "hit.*")
