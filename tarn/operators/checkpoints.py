"""A step that reuses what an earlier run left, key by key, as far as a chain of hashes vouches for it.

For every key a manifest holds the digest of the key's input, of the step's contract, and of what the step put out. A
key is reused only if all three hold now: its input and the contract are the same, and the stored output still
has its digest. All other keys are computed anew. A step whose input is another step's output is chained to it, as
its input digest is that step's output digest.

A run writes its outputs and its manifest as new tables and then moves one pointer document over the old one, so
a run that is lost halfway leaves the last state as it was. Digests are sums over rows, made on the executors, and keys
are joined, so neither keys nor rows reach the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import exists
from ..sources import tables

#: A row's SHA-256 is added up in four parts of 15 hexadecimal digits each.
_PARTS = 4


def digests(df: DataFrame, key: str, name: str) -> DataFrame:
    """``key, name``: by key, a digest of its rows and columns that doesn't depend on their order."""
    columns = sorted(c for c in df.columns if c != key)
    # Nulls differ from empty texts, as fields that are null are left out of the JSON.
    row = F.sha2(F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(c) for c in columns))), 256)
    sums = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(_PARTS)]
    kinds = F.lit(json.dumps([(c, df.schema[c].dataType.simpleString()) for c in columns]))
    return df.groupBy(key).agg(F.sha2(F.concat_ws("|", kinds, F.count("*").cast("string"), *sums), 256).alias(name))


def contract_digest(contract: dict) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True).encode()).hexdigest()


@dataclass
class Run:
    """``output``: the step's rows for all keys; ``manifest``: ``key, input_digest, contract_digest, output_digest, reused``."""

    output: DataFrame
    manifest: DataFrame


def resume(df: DataFrame, key: str, contract: dict, step: Callable[[DataFrame], DataFrame], folder: str) -> Run:
    """Run ``step`` on the keys of ``df`` that nothing valid in ``folder`` covers.

    ``step`` must give rows with ``key``, those of a key from that key's input alone. A key without any output has no
    row there, and its digest is that of no rows.
    """
    spark, mine = df.sparkSession, contract_digest(contract)
    inputs = digests(df, key, "input_digest")
    pointer = f"{folder}/current.json"
    if exists(spark, pointer):
        at = tables.json_document(spark, pointer, "output string, manifest string").first()
        old, known = spark.read.parquet(at["output"]), spark.read.parquet(at["manifest"])
        stored = digests(old, key, "stored_digest")
        fits = known.drop("reused").filter(F.col("contract_digest") == mine).join(stored, key, "left")
        fits = fits.filter(F.col("output_digest").eqNullSafe(F.col("stored_digest"))).select(key, "input_digest", "contract_digest", "output_digest")
        valid = fits.join(inputs, [key, "input_digest"], "left_semi")
        stale = df.join(valid, key, "left_anti")
        kept = old.join(valid, key, "left_semi")
    else:
        valid = stale = kept = None
    run = uuid.uuid4().hex
    fresh_path, output_path, manifest_path = (f"{folder}/{kind}-{run}" for kind in ("fresh", "output", "manifest"))
    step(df if stale is None else stale).write.parquet(fresh_path)
    fresh = spark.read.parquet(fresh_path)
    (fresh if kept is None else kept.unionByName(fresh)).write.parquet(output_path)
    entries = (inputs if valid is None else inputs.join(valid, key, "left_anti")).withColumn("contract_digest", F.lit(mine))
    entries = entries.join(digests(fresh, key, "output_digest"), key, "left").withColumn("reused", F.lit(False))
    if valid is not None:
        entries = entries.unionByName(valid.withColumn("reused", F.lit(True)))
    entries.write.parquet(manifest_path)
    tables.write_document(spark, pointer, {"output": output_path, "manifest": manifest_path})
    return Run(spark.read.parquet(output_path), spark.read.parquet(manifest_path))
