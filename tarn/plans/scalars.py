"""Scalar functions: text, identifiers, numbers, arrays, JSON, digests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from .entities import DESIGN, SURVIVAL, design, survival, table
from .registry import query

_r = lambda c, n=6: F.round(c, n)


@query("f1_null_tokens", "SELECT c_custkey, CASE WHEN lower(trim(CASE c_custkey % 4 WHEN 0 THEN ' NaN ' WHEN 1 THEN 'n/a' ELSE c_name END)) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN '' ELSE trim(c_name) END AS name FROM customer")
def null_tokens(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, " NaN ").when(F.col("c_custkey") % 4 == 1, "n/a").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", S.clean_text(raw).alias("name"))


@query("f2_integer_id", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS id FROM customer")
def integer_id(spark, d):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("00"), k)).when(k % 3 == 1, F.concat(k, F.lit(".0"))).otherwise(F.concat(k, F.lit(".5")))
    return table(spark, d, "customer").select("c_custkey", S.integer_id(raw).alias("id"))


@query("f3_regex_id", "SELECT c_custkey, CASE WHEN ltrim(regexp_extract(c_name, '#([0-9]+)$', 1), '0') = '' THEN '0' ELSE ltrim(regexp_extract(c_name, '#([0-9]+)$', 1), '0') END AS id FROM customer")
def regex_id(spark, d):
    x = F.ltrim(F.regexp_extract("c_name", r"#([0-9]+)$", 1), F.lit("0"))
    return table(spark, d, "customer").select("c_custkey", F.when(x == "", "0").otherwise(x).alias("id"))


@query("f4_trial_id", "SELECT c_custkey, 'COTC' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS trial FROM customer")
def trial_id(spark, d):
    raw = F.concat(F.lit("cotc"), F.col("c_nationkey"), F.lit("_"), F.col("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", S.trial_id(raw).alias("trial"))


@query("f5_suffix_strip", "SELECT p_partkey, CASE WHEN p_partkey % 4 >= 2 THEN p_name ELSE p_name || '_' || CAST(p_partkey % 4 AS VARCHAR) END AS symbol FROM part")
def suffix_strip(spark, d):
    return table(spark, d, "part").select("p_partkey", S.strip_copy_suffix(F.concat(F.col("p_name"), F.lit("_"), F.col("p_partkey") % 4)).alias("symbol"))


@query(
    "f5b_multi_symbol",
    """WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['A1'] WHEN 1 THEN ['A1', upper(replace(p_name, ' ', ''))] WHEN 2 THEN []::VARCHAR[] ELSE [upper(p_name)] END AS s FROM part)
    SELECT p_partkey, array_to_string(list_sort(s), '|') AS symbols, CASE WHEN len(s) = 0 THEN 'EMPTY' WHEN len(s) > 1 THEN 'MULTI' WHEN regexp_full_match(s[1], '[A-Z0-9.-]+') THEN 'UNIQUE' ELSE 'NONSTANDARD' END AS status FROM x""",
)
def multi_symbol(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 0, " a1 /// A1").when(k == 1, F.concat(F.lit("a1;"), F.replace(n, F.lit(" "), F.lit("")))).when(k == 2, "--- , NA").otherwise(n)
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(S.symbols(raw)), "|").alias("symbols"), S.symbol_status(raw).alias("status"))


@query("f5c_prefix_key", "SELECT o_orderkey, array_to_string(string_split(o_orderpriority || '-' || CAST(o_custkey AS VARCHAR) || '-x', '-')[1:3], '-') AS key FROM orders")
def prefix_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring_index(F.concat_ws("-", "o_orderpriority", F.col("o_custkey").cast("string"), F.lit("x")), "-", 3).alias("key"))


@query("f6_lexical_class", "SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 'economy' WHEN regexp_matches(p_name, '^(red|blue)') THEN 'coloured' ELSE 'other' END AS class FROM part")
def lexical_class(spark, d):
    c = F.when(F.col("p_type").startswith("ECO"), "economy").when(F.col("p_name").rlike("^(red|blue)"), "coloured").otherwise("other")
    return table(spark, d, "part").select("p_partkey", c.alias("class"))


@query("f7_regime_prefix", f"WITH {DESIGN} SELECT scenario, split_part(regime, '_', 1) AS regime FROM design")
def regime_prefix(spark, d):
    return design(spark, d).select("scenario", F.split_part("regime", F.lit("_"), F.lit(1)).alias("regime"))


@query("f8_header_normal", "SELECT o_orderkey, regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM orders")
def header_normal(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.header("o_orderpriority").alias("name"))


@query("f9_keyword_hits", "SELECT p_partkey, array_to_string(list_filter(['red', 'ring', 'small'], lambda t: contains(lower(p_name), t)), ',') AS hits FROM part")
def keyword_hits(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(S.keyword_hits("p_name", ("red", "ring", "small")), ",").alias("hits"))


@query("f11_nested_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def nested_path(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f12_flatten_struct", "SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(o_orderstatus)), '') AS statuses, round(list_sum(list(o_totalprice)), 2) AS total FROM orders GROUP BY 1")
def flatten_struct(spark, d):
    """A customer as a document with an array of structs, then flattened to columns."""
    doc = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderstatus", "o_totalprice")).alias("orders"))
    total = F.aggregate(F.transform("orders", lambda o: o["o_totalprice"]), F.lit(0.0), lambda s, x: s + x)
    return doc.select("o_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.sort_array(F.col("orders.o_orderstatus")), "").alias("statuses"), _r(total, 2).alias("total"))


@query("f14_sha256", "SELECT c_custkey, sha256(c_name) AS digest FROM customer")
def sha256(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("digest"))


@query("f15_symbol_rank", "SELECT p_type, p_name, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_name) AS BIGINT) AS rank FROM (SELECT DISTINCT p_type, p_name FROM part)")
def symbol_rank(spark, d):
    w = Window.partitionBy("p_type").orderBy("p_name")
    return table(spark, d, "part").select("p_type", "p_name").distinct().withColumn("rank", F.row_number().over(w).cast("long"))


@query("f16_transcendental", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p, round(ln(greatest(1e-6, least(1 - 1e-6, value / 1000)) / (1 - greatest(1e-6, least(1 - 1e-6, value / 1000)))), 6) AS logit FROM events")
def transcendental(spark, d):
    return table(spark, d, "events").select("event_id", S.rounded(S.sigmoid(F.col("value") / 100)).alias("p"), S.rounded(S.logit(F.col("value") / 1000)).alias("logit"))


_GRID = f"WITH {SURVIVAL}, g AS (SELECT arm, min(time) AS lo, quantile_cont(time, 0.8) AS hi FROM survival GROUP BY 1), grid AS (SELECT arm, i, lo + (hi - lo) * i / 19.0 AS t FROM g, (SELECT unnest(range(0, 20)) AS i))"


def _grid(spark, d):
    g = survival(spark, d).groupBy("arm").agg(F.min("time").alias("lo"), F.percentile("time", 0.8).alias("hi"))
    return g.select("arm", F.posexplode(S.grid(F.col("lo"), F.col("hi"), 20)).alias("i", "t"))


@query("f17_even_grid", f"{_GRID} SELECT arm, i, round(t, 6) AS t FROM grid")
def even_grid(spark, d):
    return _grid(spark, d).select("arm", F.col("i").cast("long").alias("i"), _r("t").alias("t"))


@query("f18_trapezoid", f"{_GRID}, s AS (SELECT arm, t, exp(-t / 1000) AS y, lag(t) OVER (PARTITION BY arm ORDER BY i) AS t0, lag(exp(-t / 1000)) OVER (PARTITION BY arm ORDER BY i) AS y0 FROM grid) SELECT arm, round(sum((y + y0) / 2 * (t - t0)) / (max(t) - min(t)), 6) AS mean FROM s GROUP BY 1")
def trapezoid(spark, d):
    w = Window.partitionBy("arm").orderBy("i")
    s = _grid(spark, d).withColumn("y", F.exp(-F.col("t") / 1000)).withColumns({"t0": F.lag("t").over(w), "y0": F.lag("y").over(w)})
    return s.groupBy("arm").agg(_r(F.sum((F.col("y") + F.col("y0")) / 2 * (F.col("t") - F.col("t0"))) / (F.max("t") - F.min("t"))).alias("mean"))


_HALVES = "SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings"


@query(
    "f19_vector_algebra",
    f"""WITH h AS ({_HALVES}), c AS (SELECT vec_id, list_dot_product(a, b) AS dot, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS cos FROM h)
    SELECT vec_id, round(dot, 6) AS dot, round(cos, 6) AS cosine, round(1 - cos * cos, 6) AS orthogonal FROM c""",
)
def vector_algebra(spark, d):
    h = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return h.select("vec_id", S.rounded(S.dot("a", "b")).alias("dot"), S.rounded(S.cosine("a", "b")).alias("cosine"), S.rounded(S.orthogonal_fraction("a", "b")).alias("orthogonal"))


@query("f20_sign_agreement", "SELECT label, round(avg(CASE WHEN sign(embedding[1]) = sign(embedding[2]) THEN 1.0 ELSE 0.0 END) FILTER (embedding[1] <> 0 AND embedding[2] <> 0), 6) AS agreement FROM embeddings GROUP BY 1")
def sign_agreement(spark, d):
    a, b = F.col("embedding")[0], F.col("embedding")[1]
    return table(spark, d, "embeddings").groupBy("label").agg(_r(F.avg(F.when((a != 0) & (b != 0), (F.sign(a) == F.sign(b)).cast("double")))).alias("agreement"))


@query("f21_tolerance_compare", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice * (1 - l_discount) - l_extendedprice) <= 1000 AS near FROM lineitem")
def tolerance_compare(spark, d):
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.close(p * (1 - F.col("l_discount")), p, 1000).alias("near"))


@query("f23_one_hot_reference", "SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS building, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS furniture, CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS household, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS machinery FROM customer")
def one_hot(spark, d):
    """One column per level; the first level in order is the reference."""
    levels = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return table(spark, d, "customer").select("c_custkey", *((F.col("c_mktsegment") == v).cast("int").alias(v.lower()) for v in levels))


@query("f24_int_list", "SELECT o_custkey, CAST(list_sum(list_transform(string_split(s, ','), lambda x: CAST(x AS INTEGER))) AS BIGINT) AS total FROM (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',') AS s FROM orders GROUP BY 1)")
def int_list(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ",").alias("s"))
    return s.select("o_custkey", F.aggregate(S.int_list("s"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("r6_seed_from_digest", "SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 1, 8))::BIGINT % 2147483647 AS BIGINT) AS seed FROM customer")
def seed_from_digest(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.seed_from("c_name").alias("seed"))
