"""Nested documents searched and listed, and steps resumed from checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checkpoints, documents
from ..shared import scratch, stage
from ..sources import tables
from .entities import DELTAS, deltas, table
from .registry import query


def _orders(spark, d):
    """``id, doc``: each order as a JSON document; what its lines hold differs from line to line."""
    part = F.struct(F.col("l_partkey").alias("key"), F.when(F.col("l_returnflag") == "R", F.col("l_returnflag")).alias("flag"))
    extra = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.array(F.struct(F.col("l_linestatus").alias("flag"), F.lit("x[1].y").alias("note")))))
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("s"), part.alias("part"), extra.alias("extra"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["n"].alias("n"), x["part"].alias("part"), x["extra"].alias("extra")))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(lines.alias("lines"))
    return li.select("id", F.to_json(F.struct(F.col("id").alias("order"), "lines")).alias("doc"))


_LINES = "l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS i, l_linenumber AS n, l_returnflag AS r, l_linestatus AS s FROM lineitem)"


@query(
    "f13_first_key",
    f"""WITH {_LINES}, h AS (SELECT id, i, 0 AS j, '$.lines[' || i || '].part.flag' AS path, r AS value FROM l WHERE r = 'R' UNION ALL SELECT id, i, 1, '$.lines[' || i || '].extra[0][0].flag', s FROM l WHERE n % 3 = 0)
    SELECT id, path, value FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY i, j) = 1""",
)
def first_key(spark, d):
    """The first field of a name, wherever it is in a document."""
    return documents.first_with_key(_orders(spark, d), "doc", ["id"], "flag").select("id", "path", "value")


@query(
    "f13b_json_paths",
    f"""WITH {_LINES}, p AS (SELECT '$.order' AS path, 'BIGINT' AS kind FROM (SELECT DISTINCT id FROM l) UNION ALL SELECT unnest(['$.lines[].n', '$.lines[].part.key']), 'BIGINT' FROM l UNION ALL SELECT '$.lines[].part.flag', 'STRING' FROM l WHERE r = 'R'
    UNION ALL SELECT unnest(['$.lines[].extra[][].flag', '$.lines[].extra[][].note']), 'STRING' FROM l WHERE n % 3 = 0 UNION ALL SELECT '$.k', 'BIGINT' FROM events) SELECT path, kind, count(*) AS n FROM p GROUP BY 1, 2""",
)
def json_paths(spark, d):
    """Every path to a scalar, in two kinds of documents, places in arrays left out, and how often it leads to one."""
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("props").alias("doc"))
    return documents.path_counts(_orders(spark, d).unionByName(events), "doc")


def manifest_of(spark, folder):
    return tables.json_document(spark, f"{folder}/current.json", "manifest string").first()["manifest"]


@query(
    "i7_chained_checkpoints",
    f"""WITH {DELTAS}, s AS (SELECT DISTINCT scenario FROM deltas)
    SELECT run, count(*) FILTER (again) AS computed, count(*) FILTER (NOT again) AS reused, round(any_value(total), 2) AS total FROM (
      SELECT run, CASE run WHEN 'first' THEN true WHEN 'same' THEN false WHEN 'contract' THEN true WHEN 'input' THEN scenario % 7 = 3 ELSE scenario % 5 = 1 END AS again,
        CASE WHEN run IN ('first', 'same') THEN (SELECT sum(metric) FROM deltas) WHEN run = 'contract' THEN (SELECT sum(2 * metric) FROM deltas) ELSE (SELECT sum(2 * metric) + 2 * count(*) FILTER (scenario % 7 = 3) FROM deltas) END AS total
      FROM s, (SELECT unnest(['first', 'same', 'contract', 'input', 'output']) AS run)) GROUP BY 1""",
)
def chained_checkpoints(spark, d):
    """A step over scenarios, run five times: what is reused when nothing, the contract, the input or the stored output changed."""
    folder = scratch(spark, "checkpoints")
    x = deltas(spark, d).select("scenario", "model", "replicate", "metric")
    changed = x.withColumn("metric", F.when(F.col("scenario") % 7 == 3, F.col("metric") + 1).otherwise(F.col("metric")))

    def step(factor):
        return lambda rows: rows.groupBy("scenario", "model").agg(F.sum(F.col("metric") * factor).alias("total"))

    out = []
    for run, rows, factor in (("first", x, 1), ("same", x, 1), ("contract", x, 2), ("input", changed, 2), ("output", changed, 2)):
        if run == "output":  # someone writes over a part of what the last run left
            spoilt = done.output.withColumn("total", F.when(F.col("scenario") % 5 == 1, F.col("total") * 2).otherwise(F.col("total")))
            tables.write_document(spark, f"{folder}/current.json", {"output": stage(spoilt, "spoilt")._scratch, "manifest": manifest_of(spark, folder)})
        done = checkpoints.resume(rows, "scenario", {"step": "totals", "factor": factor}, step(factor), folder)
        n = done.manifest.agg(F.count_if(~F.col("reused")).alias("computed"), F.count_if("reused").alias("reused"))
        out.append(n.withColumn("run", F.lit(run)).crossJoin(done.output.agg(F.round(F.sum("total"), 2).alias("total"))))  # a row each
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.select("run", "computed", "reused", "total")
