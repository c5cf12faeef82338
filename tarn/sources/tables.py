"""Readers and writers: delimited text, JSON, Parquet, gene sets, series matrices, file manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header; strict where a schema is given, else all columns are text.

    The delimiter is taken from the first line if none is given.
    """
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        line = first[0][0] if first else ""
        sep = max("\t,;|", key=line.count)
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header's names as they stand, duplicates included."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].split(sep) if first else []


def write_delimited(df: DataFrame, path: str, sep: str = "\t", digits: int | None = None) -> None:
    """Text with a header; doubles rounded to ``digits`` if given. Spark commits the files atomically."""
    if digits is not None:
        df = df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def gene_sets(spark: SparkSession, path: str, library: str) -> DataFrame:
    """``library, module, description, genes, source_gene_count``: ragged tab-separated set lines."""
    parts = F.split("value", "\t")
    genes = F.filter(F.transform(F.slice(parts, 3, 1_000_000), lambda g: F.upper(F.trim(g))), lambda g: g != "")
    return (
        spark.read.text(path)
        .filter(F.size(parts) >= 3)
        .select(F.lit(library).alias("library"), parts[0].alias("module"), parts[1].alias("description"), F.array_distinct(genes).alias("genes"), F.size(genes).alias("source_gene_count"))
    )


def marked_table(spark: SparkSession, path: str, begin: str, end: str, names: Sequence[str]) -> DataFrame:
    """The tab-separated tables between two marker lines in text files (gzip included), one in each file at most.

    Files are read line by line and in parallel: a line's place is its block's start in the file and its place in
    the block, and the markers' places, two a file, say which lines are between them. A file without both has no table.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), place.alias("place"))
    at = lambda mark: F.min(F.when(F.col("value") == mark, F.col("place")))
    marks = lines.filter(F.col("value").isin(begin, end)).groupBy("file").agg(at(begin).alias("first"), at(end).alias("last"))
    body = lines.join(marks, "file").filter((F.col("place") > F.col("first")) & (F.col("place") < F.col("last")))
    cells = F.split("value", "\t")
    return body.select(*(F.regexp_replace(F.get(cells, F.lit(i)), '^"|"$', "").alias(n) for i, n in enumerate(names)))


def key_values(spark: SparkSession, path: str, mark: str = "!", sep: str = "=") -> DataFrame:
    """``key, values`` of marked metadata lines, in file order within a key."""
    return (
        spark.read.text(path)
        .filter(F.col("value").startswith(mark) & F.contains("value", F.lit(sep)))
        .select(F.trim(F.substring_index(F.expr(f"substring(value, {len(mark) + 1})"), sep, 1)).alias("key"), F.trim(F.expr(f"substring(value, instr(value, '{sep}') + 1)")).alias("v"))
        .groupBy("key")
        .agg(F.collect_list("v").alias("values"))
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, bytes, modified`` without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def schema_inventory(name: str, df: DataFrame) -> DataFrame:
    """One row: table, rows, columns, and whether an id or event column is there."""
    low = [c.lower() for c in df.columns]
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        "n_rows",
        F.lit(len(low)).alias("n_columns"),
        F.lit(any(c.endswith(("_id", "key")) for c in low)).alias("has_id"),
        F.lit(any("event" in c or "status" in c for c in low)).alias("has_event"),
    )


def discover(spark: SparkSession, folder: str, patterns: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``path, bytes, modified, priority`` of the files below a folder that match a pattern, the first one counting,
    and none of ``exclude``."""
    files = inventory(spark, folder)
    for x in exclude:
        files = files.filter(~F.col("path").rlike(x))
    priority = F.coalesce(*(F.when(F.col("path").rlike(x), i + 1) for i, x in enumerate(patterns)))
    return files.withColumn("priority", priority).filter("priority IS NOT NULL")


def by_overlap(spark: SparkSession, files: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The files with the share of ``ids`` (``id``) that their ``column`` has; the best of the first priority is chosen."""
    paths = [r["path"] for r in files.select("path").collect()]  # candidates of one study: few
    rows = spark.read.option("header", True).csv(paths).select(F.input_file_name().alias("path"), F.col(column).alias("id")) if paths else None
    total = F.lit(float(ids.count()))
    if rows is None:
        return files.withColumns({"overlap": F.lit(0.0), "chosen": F.lit(False)})
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    shares = rows.join(ids.distinct(), "id").groupBy(name("path").alias("_p")).agg((F.count_distinct("id") / total).alias("overlap"))
    out = files.join(shares, name("path") == F.col("_p"), "left").drop("_p").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    first = F.struct("priority", -F.col("overlap"), "path")
    best = out.agg(F.min(first).alias("best")).select("best.*").withColumnsRenamed({"priority": "_priority", "path": "_path"}).select("_path")
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("path") == F.col("_path")).drop("_path")  # one row


def choose_columns(names: Sequence[str], concepts: Sequence[str], prefix: str = "") -> list[tuple[str, str, int]]:
    """``concept, column, score``: the column whose name is a concept (3), ends with it (2) or holds it (1)."""
    out = []
    for k in concepts:
        scored = [(3 if n.removeprefix(prefix) == k else 2 if n.endswith(k) else int(k in n), n) for n in names]
        score, name = min(((s, n) for s, n in scored if s), key=lambda x: (-x[0], len(x[1]), x[1]), default=(0, ""))
        if score:
            out.append((k, name, score))
    return out


#: What the values of a concept's column look like: a share of rows between 0 and 1.
LOOKS = {
    "date": lambda c: F.avg(F.coalesce(F.try_to_timestamp(c.cast("string")).isNotNull(), F.lit(False)).cast("double")),
    "price": lambda c: F.avg(F.coalesce(c.cast("string").rlike(r"^-?\d+\.\d+$"), F.lit(False)).cast("double")),
    "status": lambda c: 1.0 - F.count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1)),
    "key": lambda c: F.count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1)),
}


def looks_like(df: DataFrame, chosen: Sequence[tuple[str, str, int]]) -> DataFrame:
    """``concept, column_name, score, fit``: chosen columns, and how far their values look like the concept."""
    row = df.agg(*(LOOKS[k](F.col(c)).alias(f"f{i}") for i, (k, c, _) in enumerate(chosen)))
    entries = [F.struct(F.lit(k).alias("concept"), F.lit(c).alias("column_name"), F.lit(n).alias("score"), F.round(F.col(f"f{i}"), 6).alias("fit")) for i, (k, c, n) in enumerate(chosen)]
    return row.select(F.inline(F.array(*entries)))


def freeze_or_verify(df: DataFrame, path: str) -> str:
    """``frozen`` if nothing is at ``path`` and the table is written there, else ``verified`` or ``changed``.

    Equal are tables with the same columns and the same rows, in any order and as often.
    """
    spark = df.sparkSession
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        df.write.parquet(path)
        return "frozen"
    old = spark.read.parquet(path)
    if old.dtypes != df.dtypes:
        return "changed"
    return "verified" if old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty() else "changed"


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A JSON document with sorted keys, written under a temporary name and moved over what is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, temporary = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.tmp"))
    out = target.getFileSystem(conf).create(temporary, True)
    try:
        out.write(bytearray(json.dumps(document, sort_keys=True, ensure_ascii=False).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)
