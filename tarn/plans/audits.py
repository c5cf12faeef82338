"""Integrity and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit as A
from .entities import DELTAS, METRICS, SURVIVAL, deltas, metrics, survival, table
from .registry import query
from .resampling import key_sql


@query(
    "i2_contract_checks",
    """SELECT 'unique_key' AS check_name, count(*) = count(DISTINCT c_custkey) AS passed FROM customer UNION ALL SELECT 'domain', bool_and(c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) FROM customer
    UNION ALL SELECT 'finite', bool_and(isfinite(c_acctbal)) FROM customer UNION ALL SELECT 'non_negative', bool_and(c_acctbal >= 0) FROM customer""",
)
def contract_checks(spark, d):
    c = table(spark, d, "customer")
    A.require_columns(c, ["c_custkey", "c_mktsegment", "c_acctbal"])
    return A.contract(
        c,
        {
            "unique_key": F.count("*") == F.count_distinct("c_custkey"),
            "domain": F.bool_and(F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
            "finite": F.bool_and(F.col("c_acctbal").isNotNull() & ~F.isnan("c_acctbal") & (F.abs("c_acctbal") != float("inf"))),
            "non_negative": F.bool_and(F.col("c_acctbal") >= 0),
        },
    )


@query("i3_cardinality_audit", "SELECT n, count(*) AS keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def cardinality_audit(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))


@query(
    "i4_replay_checks",
    f"""WITH {METRICS}, a AS (SELECT model, avg(metric) AS v FROM metrics GROUP BY 1), b AS (SELECT event_type AS model, sum(value) / count(*) AS v FROM events WHERE event_type <> 'error' GROUP BY 1)
    SELECT model, round(a.v, 6) AS observed, round(b.v, 6) AS expected, coalesce(abs(a.v - b.v) <= 1e-9, false) AS passed FROM a FULL JOIN b USING (model)""",
)
def replay_checks(spark, d):
    a = metrics(spark, d).groupBy("model").agg(F.avg("metric").alias("v"))
    b = table(spark, d, "events").filter("event_type <> 'error'").groupBy(F.col("event_type").alias("model")).agg((F.sum("value") / F.count("*")).alias("v"))
    return A.replay(a, b, ["model"], "v", 1e-9).select("model", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), "passed")


@query("i5_structural_zero", f"WITH {DELTAS} SELECT scenario, bool_and(delta = 0) AS baseline_is_zero FROM deltas WHERE model = 'view' GROUP BY 1")
def structural_zero(spark, d):
    return deltas(spark, d).filter("model = 'view'").groupBy("scenario").agg(F.bool_and(F.col("delta") == 0).alias("baseline_is_zero"))


@query(
    "i6_partition_cover",
    f"""WITH {SURVIVAL}, f AS (SELECT id, (row_number() OVER (PARTITION BY arm, event ORDER BY {key_sql("'cv'", 'id')}, id) - 1) % 5 AS fold FROM survival)
    SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT id) = (SELECT count(*) FROM survival) AS covers, count(*) = count(DISTINCT id) AS disjoint FROM f""",
)
def partition_cover(spark, d):
    """Test folds are disjoint and together hold everyone."""
    from ..operators.resample import stratified_folds

    x = survival(spark, d)
    f = stratified_folds(x, ["arm", "event"], "id", 5, "cv").select("id", "fold")
    both = x.select(F.col("id").alias("all_id")).join(f, F.col("all_id") == f.id, "left")
    return both.agg(F.count("id").alias("n"), F.count_distinct("id").alias("ids"), (F.count_distinct("id") == F.count_distinct("all_id")).alias("covers"), (F.count("id") == F.count_distinct("id")).alias("disjoint"))


@query(
    "i6b_reaggregated_replay",
    """WITH a AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, round(sum(p), 2) AS v FROM p GROUP BY 1)
    SELECT l_orderkey, a.v AS observed, coalesce(abs(a.v - b.v) <= 0.011, false) AS passed FROM a LEFT JOIN b USING (l_orderkey)""",
)
def reaggregated(spark, d):
    """Sums by line, summed again by order, are the sums by order."""
    li = table(spark, d, "lineitem")
    once = li.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    twice = li.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_extendedprice").alias("p")).groupBy("l_orderkey").agg(F.round(F.sum("p"), 2).alias("v"))
    return A.replay(once, twice, ["l_orderkey"], "v", 0.011).select("l_orderkey", "observed", "passed")


@query(
    "i6d_content_signature",
    "SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR) || ',' || c_mktsegment), 1, 15)) AS HUGEINT)) AS VARCHAR) AS signature FROM customer GROUP BY 1",
)
def content_signature(spark, d):
    return A.signature(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_mktsegment"), ["c_nationkey"])


@query(
    "i1_required_columns",
    "SELECT unnest(['o_orderkey', 'o_totalprice', 'o_comment']) AS column_name, unnest([true, true, false]) AS present, count(*) AS n_rows, unnest([count(o_orderkey), count(o_totalprice), NULL]) AS n_filled FROM orders",
)
def required_columns(spark, d):
    """Which of the columns that a step needs are there, and filled; the step itself refuses to run on a missing one."""
    return A.presence(table(spark, d, "orders"), ["o_orderkey", "o_totalprice", "o_comment"])


@query(
    "f10_forbidden_columns",
    """WITH n AS (SELECT 'orders' AS table_name, unnest(['o_orderstatus', 'o_totalprice']) AS column_name, unnest([count(o_orderstatus), count(o_totalprice)]) AS n_filled, unnest([count(DISTINCT o_orderstatus), count(DISTINCT o_totalprice)]) AS n_values FROM orders
    UNION ALL SELECT 'part', 'p_retailprice', count(p_retailprice), count(DISTINCT p_retailprice) FROM part) SELECT * FROM n""",
)
def forbidden_columns(spark, d):
    """Columns that a blinded step must not see, by words in their names, and how much they would have told it."""
    out = None
    for name in ("orders", "part"):
        x = table(spark, d, name)
        found = A.forbidden_columns(x, ["status", "price", "time"])
        seen = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_filled"), F.col(f"v{i}").alias("n_values")) for i, c in enumerate(found)]
        row = x.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(found)), *(F.count_distinct(c).alias(f"v{i}") for i, c in enumerate(found)))
        row = row.select(F.inline(F.array(*seen)))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "i6e_sanity_anchors",
    f"""WITH {DELTAS}, r AS (SELECT model, avg(CASE WHEN delta < 0 THEN 1.0 ELSE 0.0 END) AS rate FROM deltas WHERE delta IS NOT NULL AND model <> 'view' GROUP BY 1),
    a AS (SELECT unnest(['click', 'purchase', 'absent']) AS model, unnest([0.5::DOUBLE, 0.45, 0.5]) AS anchor, unnest([0.2::DOUBLE, 0.2, 0.2]) AS slack)
    SELECT model, round(rate, 6) AS observed, anchor, coalesce(abs(rate - anchor) <= slack, false) AS passed FROM a LEFT JOIN r USING (model)""",
)
def sanity_anchors(spark, d):
    """Rates against what was published for them; a rate that is not there fails."""
    anchors = spark.createDataFrame([("click", 0.5, 0.2), ("purchase", 0.45, 0.2), ("absent", 0.5, 0.2)], "model string, anchor double, slack double")
    x = deltas(spark, d).filter("delta IS NOT NULL AND model <> 'view'")
    rates = x.groupBy("model").agg(F.avg((F.col("delta") < 0).cast("double")).alias("rate"))
    passed = F.coalesce(F.abs(F.col("rate") - F.col("anchor")) <= F.col("slack"), F.lit(False))
    return anchors.join(rates, "model", "left").select("model", F.round("rate", 6).alias("observed"), "anchor", passed.alias("passed"))


@query(
    "i6c_model_order",
    f"""WITH {METRICS}, s AS (SELECT model, round(avg(metric), 6) AS m FROM metrics GROUP BY 1), o AS (SELECT model, row_number() OVER (ORDER BY model) AS by_name, row_number() OVER (ORDER BY model DESC) AS by_name_down, row_number() OVER (ORDER BY m, model) AS by_value FROM s),
    p AS (SELECT m, row_number() OVER (ORDER BY m) AS place FROM s), c AS (SELECT unnest(['by_name', 'by_name_down', 'by_value']) AS candidate)
    SELECT candidate, count(*) FILTER (abs(s.m - p.m) <= 1e-9) AS n_matched, bool_and(abs(s.m - p.m) <= 1e-9) AS resolved
    FROM c, o JOIN s USING (model) JOIN p ON p.place = CASE c.candidate WHEN 'by_name' THEN by_name WHEN 'by_name_down' THEN by_name_down ELSE by_value END GROUP BY 1""",
)
def model_order(spark, d):
    """An unnamed list of values is matched to the models: which candidate order gives the summary's own values?"""
    s = metrics(spark, d).groupBy("model").agg(F.round(F.avg("metric"), 6).alias("m")).withColumn("all", F.lit(1))
    w = Window.partitionBy("all")  # a row per model
    unnamed = s.select(F.col("m").alias("value"), F.row_number().over(w.orderBy("m")).alias("place"))
    orders = {"by_name": w.orderBy("model"), "by_name_down": w.orderBy(F.col("model").desc()), "by_value": w.orderBy("m", "model")}
    places = F.explode(F.create_map(*(x for k in orders for x in (F.lit(k), F.col(k))))).alias("candidate", "place")
    named = s.withColumns({k: F.row_number().over(o) for k, o in orders.items()}).select("m", places)
    match = F.abs(F.col("m") - F.col("value")) <= 1e-9
    return named.join(unnamed, "place").groupBy("candidate").agg(F.count_if(match).alias("n_matched"), F.bool_and(match).alias("resolved"))
