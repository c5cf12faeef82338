"""Probes, marked tables, array bundles and sinks."""

from __future__ import annotations

import io
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..shared import scratch
from ..sources import arrays, tables, workbooks
from .entities import table
from .registry import query
from .resampling import _PANELS, key_sql, matched_panels


@query(
    "s3_header_probe",
    """WITH c(place, column_name) AS (VALUES (0, 'nationkey'), (1, 'name'), (2, 'regionkey'), (3, 'regionkey'), (4, 'name'))
    SELECT place, column_name, count(*) OVER (PARTITION BY column_name) > 1 AS duplicated, (SELECT count(*) FROM nation) AS n_lines, (SELECT count(*) FROM nation WHERE n_nationkey % 7 = 3) AS n_ragged FROM c""",
)
def header_probe(spark, d):
    """The header of a joined table as it stands, which names columns twice; a reader that renames duplicates would hide it. Then the lines that don't fit it."""
    path = scratch(spark, "header")
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = [c[2:] for c in both.columns]
    short = F.when(F.col("n_nationkey") % 7 == 3, F.lit("")).otherwise(F.concat(F.lit(","), "r_name"))  # a field is missing
    line = F.concat(F.concat_ws(",", *(F.col(c).cast("string") for c in both.columns[:-1])), short)
    both.select(line.alias("value")).write.text(f"{path}/lines")
    spark.createDataFrame([(",".join(names),)], "value string").write.text(f"{path}/header")
    found = tables.header_of(spark, f"{path}/header")
    lines = spark.read.text(f"{path}/lines").agg(F.count("*").alias("n_lines"), F.count_if(F.size(F.split("value", ",")) != len(found)).alias("n_ragged"))
    entries = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("column_name"), F.lit(found.count(n) > 1).alias("duplicated")) for i, n in enumerate(found)]
    return lines.select("n_lines", "n_ragged", F.inline(F.array(*entries)))


@query("s7_parquet_scan", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def parquet_scan(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))


def _bundle(spark, d) -> str:
    """Embeddings as shards of named arrays, in the order of their ids."""
    arrays.register(spark)
    path = scratch(spark, "bundle")
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", "embedding")
    rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").write.format("arrays").option("rows", 200).mode("append").save(path)
    return path


@query("s10_array_bundle", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def array_bundle(spark, d):
    """Named arrays written as bundles, a shard at a time, and read back from them."""
    b = spark.read.format("arrays").option("rows", 64).load(_bundle(spark, d))
    return b.select("vec_id", "label", F.size("embedding").alias("n"), F.col("embedding")[0].cast("double").alias("first"), F.get("embedding", F.lit(63)).cast("double").alias("last"))


BOOK_ROWS = 5000


def _books(spark, d) -> str:
    """Customers and their orders in workbooks of about BOOK_ROWS rows each, two sheets a workbook."""
    path = scratch(spark, "books")
    store, root = arrays.open_fs(path)
    store.create_dir(root, recursive=True)
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    books = F.lit(max(1, -(-(c.count() + o.count()) // BOOK_ROWS)))
    c = c.select(F.lit(0).alias("kind"), F.col("c_custkey").alias("key"), F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"), F.lit(None).cast("timestamp").alias("at"))
    # An order of an even key has no amount: a gap in its row.
    o = o.select(F.lit(1).alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("name"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice")).alias("amount"), F.col("o_orderdate").alias("at"))
    # Dealt by the key of each row: a customer with very many orders is in many workbooks.
    rows = c.unionByName(o).withColumn("book", F.pmod(F.xxhash64("kind", "key"), books))

    def book(key, x):
        x = x.sort_values(["kind", "key"]).astype(object).where(lambda v: v.notna(), None)
        part = lambda k: x[x["kind"] == k]
        at = [v and v.to_pydatetime() for v in part(1)["at"]]
        sheets = {
            "customers": (["id", "label", "balance"], zip(*(part(0)[n] for n in ("key", "name", "amount")), strict=True)),
            "orders & more": (["id", "customer", "total", "status", "date"], zip(*(part(1)[n] for n in ("key", "customer", "amount", "name")), at, strict=True)),
        }
        data = io.BytesIO()
        workbooks.write(data, sheets)
        # An attempt writes under a name of its own; the last one to end gives the same workbook its name.
        store, root = arrays.open_fs(path)
        temporary = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(data.getvalue())
        store.move(temporary, f"{root}/book-{key[0]}.xlsx")
        return pd.DataFrame({"n": [len(x)]})

    rows.groupBy("book").applyInPandas(book, "n long").agg(F.sum("n")).collect()
    return path


@query(
    "s6_workbooks",
    """SELECT 'customers' AS sheet, count(*) AS n, count(c_acctbal) AS filled, round(sum(c_acctbal), 2) AS total, NULL::VARCHAR AS first_date, NULL::VARCHAR AS last_date FROM customer
    UNION ALL SELECT 'orders & more', count(*), count(*) FILTER (o_orderkey % 2 = 1), round(sum(o_totalprice) FILTER (o_orderkey % 2 = 1), 2), CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR), CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) FROM orders""",
)
def read_workbooks(spark, d):
    """All sheets of all workbooks of a folder, a partition a sheet; rows with gaps, dates as dates."""
    path = _books(spark, d)
    c = workbooks.table(spark, path, "customers", "id long, label string, balance double").select(F.lit("customers").alias("sheet"), F.col("balance").alias("v"), F.lit(None).cast("date").alias("date"))
    o = workbooks.table(spark, path, "orders & more", "id long, total double, status string, date date").select(F.lit("orders & more").alias("sheet"), F.col("total").alias("v"), "date")
    return c.unionByName(o).groupBy("sheet").agg(F.count("*").alias("n"), F.count("v").alias("filled"), F.round(F.sum("v"), 2).alias("total"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


def _series(spark, d) -> str:
    path = scratch(spark, "series")
    lines = F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "n_name"))), "\n")
    names = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("!nation = "), F.col("n_name")))), "\n")
    text = F.concat(F.lit("!title = nations\n"), names, F.lit("\n!table_begin\n"), lines, F.lit("\n!table_end\n!after = none"))
    table(spark, d, "nation").agg(text.alias("value")).write.option("compression", "gzip").text(path)
    return path


@query("s12_series_matrix", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, n_name AS name FROM nation")
def series_matrix(spark, d):
    """The table between two marker lines of a compressed text."""
    return tables.marked_table(spark, _series(spark, d), "!table_begin", "!table_end", ["id", "name"])


@query("s12b_platform_table", "SELECT CAST(p_partkey AS VARCHAR) AS probe, p_brand AS brand, p_type AS kind FROM part")
def platform_table(spark, d):
    """Annotation tables between their markers, with headers of their own; a file a partition."""
    path = scratch(spark, "platform")
    lines = table(spark, d, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", "p_type").alias("value")).repartition(3)

    def framed(batches):
        yield pa.RecordBatch.from_pydict({"value": ["^PLATFORM = parts", "!platform_table_begin", "probe\tbrand\tkind"]})
        yield from (pa.RecordBatch.from_arrays([b.column(0)], ["value"]) for b in batches)
        yield pa.RecordBatch.from_pydict({"value": ["!platform_table_end", "after\tthe\ttable"]})

    lines.mapInArrow(framed, "value string").write.text(path)
    return tables.marked_table(spark, path, "!platform_table_begin", "!platform_table_end", ["probe", "brand", "kind"]).filter("probe <> 'probe'")


@query(
    "s12c_key_values",
    "SELECT 'title' AS key, 1 AS n, 'nations' AS last UNION ALL SELECT 'after', 1, 'none' UNION ALL SELECT 'nation', CAST(count(*) AS INTEGER), max(n_name) FROM nation",
)
def key_values(spark, d):
    return tables.key_values(spark, _series(spark, d)).select("key", F.size("values").alias("n"), F.array_max("values").alias("last"))


@query(
    "s23_file_discovery",
    """WITH f AS (SELECT unnest(['nation_full', 'nation_even', 'other_nation']) AS name, unnest([1, 1, 2]) AS priority, unnest([1, 2, 1]) AS step),
    s AS (SELECT name, priority, count(*) FILTER (n_nationkey % step = 0) / CAST(count(*) AS DOUBLE) AS overlap FROM nation, f GROUP BY 1, 2)
    SELECT name, priority, round(overlap, 6) AS overlap, row_number() OVER (ORDER BY priority, overlap DESC, name) = 1 AS chosen FROM s""",
)
def file_discovery(spark, d):
    """Candidate files below a folder, without excluded ones, by priority of their names and overlap with the ids sought."""
    root = scratch(spark, "candidates")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    for name, step in (("nation_full", 1), ("nation_even", 2), ("other_nation", 1), ("nation_full_backup", 1)):
        n.filter(F.col("n_nationkey") % step == 0).coalesce(1).write.option("header", True).csv(f"{root}/{name}")
    found = tables.discover(spark, root, [r"/nation_[^/]+/[^/]+\.csv$", r"\.csv$"], [r"_backup/"])
    return tables.by_overlap(spark, found, n.select(F.col("n_nationkey").cast("string").alias("id")), "n_nationkey").select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name"), "priority", F.round("overlap", 6).alias("overlap"), "chosen"
    )


@query(
    "j19_column_choice",
    """WITH k AS (SELECT unnest(['price', 'date', 'status', 'key']) AS concept), c AS (SELECT column_name AS c FROM (DESCRIBE orders)),
    s AS (SELECT concept, c, CASE WHEN substr(c, 3) = concept THEN 3 WHEN ends_with(c, concept) THEN 2 WHEN contains(c, concept) THEN 1 ELSE 0 END AS score FROM k, c),
    b AS (SELECT concept, c AS column_name, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY score DESC, length(c), c) = 1),
    f AS (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 0.0 ELSE 1.0 END) AS price, avg(CASE WHEN o_orderdate IS NULL THEN 0.0 ELSE 1.0 END) AS date, 1 - count(DISTINCT o_orderstatus) / count(*) AS status, count(DISTINCT o_custkey) / count(*) AS key FROM orders)
    SELECT concept, column_name, score, round(CASE concept WHEN 'price' THEN price WHEN 'date' THEN date WHEN 'status' THEN status ELSE key END, 6) AS fit FROM b, f""",
)
def column_choice(spark, d):
    """For each concept, the column whose name says it best, equal, at the end, or within, and how far its values look like it."""
    o = table(spark, d, "orders")
    return tables.looks_like(o, tables.choose_columns(o.columns, ("price", "date", "status", "key"), prefix="o_"))


@query(
    "i8_freeze_or_verify",
    "SELECT 'first' AS run, 'frozen' AS status, count(*) AS n FROM nation UNION ALL SELECT 'again', 'verified', count(*) FROM nation UNION ALL SELECT 'changed', CASE WHEN count(*) FILTER (n_nationkey <> 3) = count(*) THEN 'verified' ELSE 'changed' END, count(*) FILTER (n_nationkey <> 3) FROM nation",
)
def freeze_or_verify(spark, d):
    """A table is frozen when it is first seen; later it must be the same."""
    path = scratch(spark, "frozen")
    n = table(spark, d, "nation")
    runs = [(k, tables.freeze_or_verify(x, path), x.count()) for k, x in (("first", n), ("again", n.orderBy(F.col("n_name").desc())), ("changed", n.filter("n_nationkey <> 3")))]
    return spark.createDataFrame(runs, "run string, status string, n long")


@query(
    "s22_file_inventory",
    "SELECT 'c_nationkey=' || coalesce(CAST(c_nationkey AS VARCHAR), '__HIVE_DEFAULT_PARTITION__') AS folder, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT c_nationkey, c_mktsegment, sum(strlen(c_name) + 1) AS bytes FROM customer GROUP BY 1, 2) GROUP BY 1",
)
def file_inventory(spark, d):
    """A tree of files as it stands: paths and sizes by folder."""
    path = scratch(spark, "inventory")
    c = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.col("c_name").alias("value"))
    c.repartition("c_nationkey", "c_mktsegment").write.partitionBy("c_nationkey", "c_mktsegment").text(path)
    files = tables.inventory(spark, path).filter("bytes > 0")
    return files.groupBy(F.regexp_extract("path", "c_nationkey=[^/]*", 0).alias("folder")).agg(F.count_distinct("path").alias("n_files"), F.sum("bytes").alias("bytes"))


@query(
    "s25_panel_sink",
    f"""WITH {_PANELS}, c AS (SELECT need.s, draw, need.stratum, p.item, n, row_number() OVER (PARTITION BY need.s, draw, need.stratum ORDER BY {key_sql("'panel'", 'need.s', 'draw', 'p.item')}, p.item) AS k
    FROM need JOIN p ON p.stratum = need.stratum AND p.s <> need.s, (SELECT unnest(range(0, 5)) AS draw)) SELECT s, draw, count(*) AS n, count(DISTINCT item) AS items FROM c WHERE k <= n GROUP BY 1, 2""",
)
def panel_sink(spark, d):
    """Panels written by set and draw, and counted from what was written."""
    path = scratch(spark, "panels")
    matched_panels(spark, d).write.partitionBy("s").parquet(path)
    return spark.read.parquet(path).groupBy("s", "draw").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"))


@query(
    "s11_array_scan",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)
    SELECT place // 100 AS part, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS energy FROM r WHERE place >= 100 GROUP BY 1""",
)
def array_scan(spark, d):
    """All rows but the first hundred of one array of a bundle, by byte ranges: each task seeks to its rows, and no other bytes are read."""
    x = spark.read.format("arrays").options(rows=50, start=100, columns="embedding", place="place").load(_bundle(spark, d))
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return x.groupBy(F.floor(F.col("place") / 100).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum(square), 4).alias("energy"))


@query("s20_atomic_document", "SELECT r_name AS key, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def atomic_document(spark, d):
    """One JSON document, seen whole or not at all, also when it replaces another."""
    path = f"{scratch(spark, 'document')}/summary.json"
    by = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("key")).agg(F.count("*").alias("n"))
    tables.write_document(spark, path, {})
    tables.write_document(spark, path, {"counts": [r.asDict() for r in by.collect()]})  # a row per region
    return tables.json_document(spark, path, "counts array<struct<key string, n long>>").select(F.inline("counts"))
