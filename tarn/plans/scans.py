"""Scans, projections, casts and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..shared import scratch
from ..sources import tables
from .entities import DELTAS, DESIGN, deltas, design, table
from .registry import query


@query("s1_delimited_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def delimited_round_trip(spark, d):
    path = scratch(spark, "nation-tsv")
    tables.write_delimited(table(spark, d, "nation"), path)
    return tables.delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int", "\t")


@query("s2_sniffed_delimiter", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sniffed(spark, d):
    path = scratch(spark, "region-csv")
    tables.write_delimited(table(spark, d, "region"), path, sep=";")
    return tables.delimited(spark, path)


@query("s4_pruned_read", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01'")
def pruned(spark, d):
    return table(spark, d, "lineitem").filter("l_shipdate < '2000-01-01'").select("l_orderkey", "l_quantity")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_COLUMNS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6}


@query(
    "s5_shape_inventory",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({_COLUMNS[t]} AS INTEGER) AS n_columns, true AS has_id, {str(t in ('orders', 'lineitem', 'events')).lower()} AS has_event FROM {t}" for t in _TABLES
    ),
)
def shapes(spark, d):
    return reduce(DataFrame.unionAll, (tables.schema_inventory(t, table(spark, d, t)) for t in _TABLES))


@query("s8_json_round_trip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark, d):
    path = scratch(spark, "events-json")
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    e.write.json(path)
    return tables.json_lines(spark, path, "event_id long, props struct<k: long>").select("event_id", "props.k")


@query("s9_json_semi_join", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def json_semi_join(spark, d):
    few = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, d, "events").select("event_id", "user_id").join(few, "user_id", "left_semi")


@query(
    "s13_gene_set_lines",
    """SELECT 'parts' AS library, p_brand AS module, p_type AS description, CAST(count(DISTINCT upper(p_name)) AS INTEGER) AS n_genes,
    CAST(count(*) AS INTEGER) AS source_gene_count FROM part GROUP BY p_brand, p_type""",
)
def gene_set_lines(spark, d):
    path = scratch(spark, "sets-gmt")
    lines = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.concat_ws("\t", F.col("p_brand"), F.col("p_type"), F.array_join(F.collect_list("p_name"), "\t")).alias("value"))
    lines.select("value").write.text(path)
    return tables.gene_sets(spark, path, "parts").select("library", "module", "description", F.size("genes").alias("n_genes"), "source_gene_count")


@query("s19_rounded_sink", "SELECT c_custkey, round(c_acctbal / 3, 2) AS third FROM customer")
def rounded_sink(spark, d):
    path = scratch(spark, "customer-csv")
    tables.write_delimited(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 3).alias("third")), path, ",", digits=2)
    return tables.delimited(spark, path, "c_custkey bigint, third double", ",")


@query("s21_content_manifest")
def content_manifest(spark, d):
    path = scratch(spark, "manifest")
    table(spark, d, "nation").coalesce(1).write.json(path)
    return tables.manifest(spark, path).select("bytes", "sha256")


@query("p1_mask_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def mask(spark, d):
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)).select("o_orderkey", "o_totalprice")


@query("p2_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def in_list(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("p3_project_rename", "SELECT c_custkey AS subject, c_name AS name, c_acctbal AS balance FROM customer")
def project(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query("p4_optional_columns", "SELECT DISTINCT n_name AS gene, CAST(n_regionkey AS VARCHAR) AS chromosome, '' AS description FROM nation")
def optional_columns(spark, d):
    names = {"n_name": "gene", "n_regionkey": "chromosome", "n_comment": "description"}
    n = table(spark, d, "nation")
    have = [F.col(a).cast("string").alias(b) if a in n.columns else F.lit("").alias(b) for a, b in names.items()]
    return n.select(*have).dropDuplicates()


@query(
    "p4b_alias_canonical",
    """SELECT user_id AS scenario, lower(event_type) AS model, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS fraction, value AS metric FROM events""",
)
def alias_canonical(spark, d):
    aliases = {"scenario": ("scenario_id", "user_id"), "model": ("model_id", "event_type"), "metric": ("uno_c", "value")}
    e = table(spark, d, "events")
    chosen = {k: F.coalesce(*(F.col(c) for c in names if c in e.columns)) for k, names in aliases.items()}
    percent = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select(chosen["scenario"].alias("scenario"), F.lower(chosen["model"]).alias("model"), percent.alias("fraction"), chosen["metric"].alias("metric"))


@query(
    "p5_case_column",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS discount_class FROM lineitem",
)
def case_column(spark, d):
    c = F.when(F.col("l_discount") > 0.05, "high").when(F.col("l_discount") > 0, "low").otherwise("none")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", c.alias("discount_class"))


@query(
    "p6_first_reason",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice < 50000 THEN 'too_small'
    WHEN o_orderpriority LIKE '5%' THEN 'low_priority' ELSE 'eligible' END AS reason FROM orders""",
)
def first_reason(spark, d):
    r = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 50000, "too_small").when(F.col("o_orderpriority").startswith("5"), "low_priority").otherwise("eligible")
    return table(spark, d, "orders").select("o_orderkey", r.alias("reason"))


@query(
    "p7_operational_class",
    f"""WITH {DELTAS} SELECT scenario, model, replicate, CASE WHEN delta IS NULL THEN 'not_assessable' WHEN delta >= 0.02 THEN 'beneficial'
    WHEN delta <= -0.02 THEN 'harmful' ELSE 'neutral' END AS class FROM deltas""",
)
def operational_class(spark, d):
    x = S.finite("delta")
    c = F.when(x.isNull(), "not_assessable").when(x >= 0.02, "beneficial").when(x <= -0.02, "harmful").otherwise("neutral")
    return deltas(spark, d).select("scenario", "model", "replicate", c.alias("class"))


@query(
    "p8_regime_group",
    f"""WITH {DESIGN} SELECT scenario, CASE WHEN starts_with(regime, 'R0') OR starts_with(regime, 'R1') THEN 'favourable'
    WHEN starts_with(regime, 'R5') THEN 'inverted' ELSE 'mixed' END AS mechanism FROM design""",
)
def regime_group(spark, d):
    r = F.col("regime")
    g = F.when(r.startswith("R0") | r.startswith("R1"), "favourable").when(r.startswith("R5"), "inverted").otherwise("mixed")
    return design(spark, d).select("scenario", g.alias("mechanism"))


@query("p9_severe_mask", f"WITH {DESIGN} SELECT scenario, (severity = 2 OR events <= 10 OR starts_with(regime, 'R5')) AS severe FROM design")
def severe(spark, d):
    return design(spark, d).select("scenario", ((F.col("severity") == 2) | (F.col("events") <= 10) | F.col("regime").startswith("R5")).alias("severe"))


@query("p10_strict_cast", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def strict_cast(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("p11_lenient_cast", "SELECT o_orderkey, TRY_CAST(o_orderpriority AS DOUBLE) AS whole, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS first FROM orders")
def lenient_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.lenient("o_orderpriority").alias("whole"), S.lenient(F.substring("o_orderpriority", 1, 1)).alias("first"))


@query("p12_finite_filter", "SELECT event_id, round(ln(value), 6) AS x FROM events WHERE value > 0 AND isfinite(ln(value)) AND event_id % 1 = 0")
def finite_filter(spark, d):
    x = F.when(F.col("value") > 0, F.ln("value"))
    return table(spark, d, "events").select("event_id", S.rounded(x).alias("x")).filter(S.is_finite("x"))


@query("p13_missing_token", "SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END), ''), '<MISSING>') AS kind FROM events")
def missing_token(spark, d):
    return table(spark, d, "events").select("event_id", S.or_missing(F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))).alias("kind"))


@query(
    "p14_interval_bins",
    """SELECT p_partkey, CASE WHEN p_size <= 10 AND p_size >= 0 THEN '(0,10]' WHEN p_size <= 25 THEN '(10,25]' WHEN p_size <= 50 THEN '(25,50]' END AS bin FROM part""",
)
def interval_bins(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bin_label("p_size", (0, 10, 25, 50)).alias("bin"))


@query(
    "p15_event_time_parser",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN 1 WHEN o_orderstatus IN ('O', 'P') THEN 0 END AS event,
    CASE WHEN o_totalprice > 0 AND isfinite(o_totalprice) THEN o_totalprice END AS time FROM orders""",
)
def event_time(spark, d):
    s, t = F.col("o_orderstatus"), S.finite("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(s.isin("F"), 1).when(s.isin("O", "P"), 0).alias("event"), F.when(t > 0, t).alias("time"))


@query("p16_clip", "SELECT event_id, greatest(5.0, least(20.0, value)) AS clipped FROM events")
def clipped(spark, d):
    return table(spark, d, "events").select("event_id", S.clip("value", 5.0, 20.0).alias("clipped"))


@query(
    "p17_factorial_grid",
    """SELECT r_name AS regime, e.e AS events, 'CORE' AS family, CAST(NULL AS INTEGER) AS shift FROM region, (SELECT unnest([5, 10, 15, 20, 29, 40]) AS e) e
    UNION ALL SELECT r_name, e.e, 'STRESS', s.s FROM region, (SELECT unnest([5, 10, 20, 29]) AS e) e, (SELECT unnest([0, 1, 2]) AS s) s WHERE r_regionkey < 2""",
)
def factorial_grid(spark, d):
    """Designs are small tables of levels, so their product is exploded from arrays, not joined."""
    r = table(spark, d, "region")
    core = r.select(F.col("r_name").alias("regime"), F.explode(F.array(*map(F.lit, (5, 10, 15, 20, 29, 40)))).alias("events")).select("regime", "events", F.lit("CORE").alias("family"), F.lit(None).cast("int").alias("shift"))
    stress = r.filter("r_regionkey < 2").select(F.col("r_name").alias("regime"), F.explode(F.array(*map(F.lit, (5, 10, 20, 29)))).alias("events"), F.lit("STRESS").alias("family")).select("*", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("shift"))
    return core.unionByName(stress)


@query(
    "p18_threshold_sweep",
    f"""WITH {DELTAS} SELECT model, t.t AS threshold, round(avg(CASE WHEN delta IS NOT NULL THEN CASE WHEN delta <= t.t THEN 1.0 ELSE 0.0 END END), 6) AS rate
    FROM deltas, (SELECT unnest([-30.0::DOUBLE, -20.0, -10.0]) AS t) t WHERE model <> 'view' GROUP BY model, t.t""",
)
def threshold_sweep(spark, d):
    """All thresholds in one pass: a column each, unpivoted after the aggregation."""
    cuts = (-30.0, -20.0, -10.0)
    x = S.finite("delta")
    wide = deltas(spark, d).filter("model <> 'view'").groupBy("model").agg(*(F.avg(F.when(x.isNotNull(), (x <= c).cast("double"))).alias(f"c{i}") for i, c in enumerate(cuts)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("threshold"), F.round(f"c{i}", 6).alias("rate")) for i, c in enumerate(cuts)))).alias("r")
    return wide.select("model", rows).select("model", "r.threshold", "r.rate")
