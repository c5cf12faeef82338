"""Joins and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import intervals
from ..operators import relational as R
from ..operators.audit import signature
from ..shared import stage
from .entities import DELTAS, EXPRESSION, METRICS, SURVIVAL, deltas, expression, metrics, survival, table
from .registry import query


@query(
    "j1_many_to_one",
    "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def many_to_one(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return R.checked_join(table(spark, d, "customer"), n, ["c_nationkey"], "left", "many_to_one").select("c_custkey", "n_name")


@query("j2_one_to_many", "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000")
def one_to_many(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    return R.checked_join(table(spark, d, "nation"), c, ["n_nationkey"], "left", "one_to_many").select("n_nationkey", "c_custkey")


@query("j3_one_to_one", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def one_to_one(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.checked_join(table(spark, d, "customer"), o, ["c_custkey"], "left", "one_to_one").select("c_custkey", "n")


@query("j4_inner_renamed", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_renamed(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")


@query(
    "j5_pair_comparison",
    f"""WITH {METRICS} SELECT scenario, replicate, a.metric AS metric_a, b.metric AS metric_b FROM metrics a JOIN metrics b USING (scenario, replicate)
    WHERE a.model = 'click' AND b.model = 'purchase'""",
)
def pair_comparison(spark, d):
    m = metrics(spark, d).filter(F.col("model").isin("click", "purchase"))
    one = lambda model, name: F.max(F.when(F.col("model") == model, F.col("metric"))).alias(name)
    return m.groupBy("scenario", "replicate").agg(one("click", "metric_a"), one("purchase", "metric_b")).dropna()


@query("j6_multi_key", "SELECT l_orderkey, l_linenumber, p.n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) p USING (l_partkey, l_suppkey)")
def multi_key(spark, d):
    li = table(spark, d, "lineitem")
    return li.join(li.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "n")


@query("j7_reference_delta", f"WITH {DELTAS} SELECT scenario, model, replicate, round(delta, 6) AS delta FROM deltas")
def reference_delta(spark, d):
    return deltas(spark, d).select("scenario", "model", "replicate", S.rounded("delta").alias("delta"))


@query("j8_aggregate_back", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 3) AS centred FROM events")
def aggregate_back(spark, d):
    mean = F.avg("value").over(Window.partitionBy("user_id"))
    return table(spark, d, "events").select("event_id", S.rounded(F.col("value") - mean, 3).alias("centred"))


@query("j10_map_lookup", "SELECT event_id, CASE event_type WHEN 'view' THEN 'B0' WHEN 'click' THEN 'A2' WHEN 'purchase' THEN 'A3' ELSE 'other' END AS role FROM events")
def map_lookup(spark, d):
    m = F.create_map(*map(F.lit, ("view", "B0", "click", "A2", "purchase", "A3")))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("other")).alias("role"))


@query("j11_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("j12_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(
    "j13_reconciliation",
    """WITH c AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 10 < 7), h AS (SELECT c_custkey AS k, c_nationkey - c_nationkey % 2 AS v FROM customer WHERE c_custkey % 10 > 3)
    SELECT k, c.v AS current, h.v AS historical, CASE WHEN h.k IS NULL THEN 'CURRENT_ONLY' WHEN c.k IS NULL THEN 'HISTORICAL_ONLY' WHEN c.v = h.v THEN 'SAME' ELSE 'DIFFERENT' END AS status
    FROM c FULL JOIN h USING (k)""",
)
def reconciliation(spark, d):
    """The two sides are two states of one table: shares of it that overlap in part."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return R.reconcile(c.filter("k % 10 < 7"), c.filter("k % 10 > 3").withColumn("v", F.col("v") - F.col("v") % 2), "k", "v")


@query(
    "j13b_first_complete_key",
    """WITH k AS (SELECT c_name AS x, CAST(CAST(nullif(regexp_extract(c_name, '#([0-9]+)$', 1), '') AS BIGINT) AS VARCHAR) AS digits FROM customer), y AS (SELECT CAST(c_custkey AS VARCHAR) AS y FROM customer)
    SELECT CASE WHEN (SELECT bool_and(x IN (SELECT y FROM y)) FROM k) THEN 'exact' WHEN (SELECT bool_and(digits IN (SELECT y FROM y)) FROM k) THEN 'digits' END AS chosen""",
)
def first_complete(spark, d):
    names = table(spark, d, "customer").select(F.col("c_name").alias("x"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("y"))
    chosen = R.first_complete_key(
        names, keys, {"exact": (F.col("x"), F.col("y").cast("string")), "digits": (S.integer_id(F.regexp_extract("x", r"#(\d+)$", 1)), S.integer_id("y"))}
    )
    return spark.createDataFrame([(chosen,)], "chosen string")


@query(
    "j13c_case_insensitive",
    "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON upper(trim('region_' || n_regionkey)) = upper(trim('Region_' || r_regionkey || ' '))",
)
def case_insensitive(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.upper(F.trim(F.concat(F.lit("region_"), F.col("n_regionkey")))).alias("k"))
    r = table(spark, d, "region").select("r_regionkey", F.upper(F.trim(F.concat(F.lit("Region_"), F.col("r_regionkey"), F.lit(" ")))).alias("k"))
    return R.checked_join(n, r, ["k"], "inner").select("n_nationkey", "r_regionkey")


@query(
    "j13d_best_id_column",
    """SELECT col AS id_column, count(DISTINCT id) AS n_overlap FROM (SELECT 'l_orderkey' AS col, l_orderkey AS id FROM lineitem UNION ALL SELECT 'l_partkey', l_partkey FROM lineitem
    UNION ALL SELECT 'l_suppkey', l_suppkey FROM lineitem) WHERE id IN (SELECT p_partkey FROM part) GROUP BY col ORDER BY n_overlap DESC, col LIMIT 1""",
)
def best_id_column(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").unpivot([], ["l_orderkey", "l_partkey", "l_suppkey"], "id_column", "id").distinct()
    hit = li.join(table(spark, d, "part").select(F.col("p_partkey").alias("id")), "id", "left_semi").groupBy("id_column").agg(F.count("*").alias("n_overlap"))
    return hit.orderBy(F.col("n_overlap").desc(), "id_column").limit(1)


@query(
    "j14_group_overlap",
    """WITH m AS (SELECT DISTINCT p_brand AS g, p_name AS i FROM part), s AS (SELECT g, count(*) AS n FROM m GROUP BY g)
    SELECT a.g AS a, b.g AS b, any_value(sa.n) AS n_a, any_value(sb.n) AS n_b, count(*) AS n_both, round(count(*) / (any_value(sa.n) + any_value(sb.n) - count(*)), 6) AS jaccard,
    round(count(*) / least(any_value(sa.n), any_value(sb.n)), 6) AS over_smaller
    FROM m a JOIN m b ON a.i = b.i AND a.g < b.g JOIN s sa ON sa.g = a.g JOIN s sb ON sb.g = b.g GROUP BY a.g, b.g""",
)
def group_overlap(spark, d):
    o = R.overlaps(table(spark, d, "part"), "p_brand", "p_name")
    return o.withColumns({"jaccard": F.round("jaccard", 6), "over_smaller": F.round("over_smaller", 6)})


@query(
    "j15_pareto_frontier",
    """WITH p AS (SELECT n_regionkey AS g, c_nationkey AS id, avg(c_acctbal) AS gain, stddev_samp(c_acctbal) AS harm FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
    SELECT g, id FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.g = b.g AND b.gain >= a.gain - 1e-12 AND b.harm <= a.harm + 1e-12 AND (b.gain > a.gain + 1e-12 OR b.harm < a.harm - 1e-12))""",
)
def pareto(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("g"))
    p = table(spark, d, "customer").join(n, "c_nationkey").groupBy("g", F.col("c_nationkey").alias("id")).agg(F.avg("c_acctbal").alias("gain"), F.stddev_samp("c_acctbal").alias("harm"))
    return R.not_dominated(p, ["g"], ["gain"], ["harm"]).select("g", "id")


@query(
    "j16_asof_step",
    f"""WITH {SURVIVAL}, steps AS (SELECT arm, time, CAST(count(*) AS DOUBLE) AS v FROM survival WHERE event = 1 GROUP BY 1, 2), q AS (SELECT DISTINCT arm, time + 0.0 AS t FROM survival WHERE event = 0)
    SELECT q.arm, q.t, coalesce(s.v, 1.0) AS v FROM q ASOF LEFT JOIN steps s ON q.arm = s.arm AND q.t >= s.time""",
)
def asof_step(spark, d):
    s = stage(survival(spark, d).groupBy("arm", "time", "event").agg(F.count("*").cast("double").alias("v")), "asof")
    return R.asof(s.filter("event = 0").select("arm", F.col("time").alias("t")), s.filter("event = 1"), ["arm"], "t", "time", "v", "v")


@query(
    "j16b_asof_left_limit",
    f"""WITH {SURVIVAL}, steps AS (SELECT arm, time, CAST(count(*) AS DOUBLE) AS v FROM survival WHERE event = 1 GROUP BY 1, 2), q AS (SELECT DISTINCT arm, time + 0.0 AS t FROM survival WHERE event = 0)
    SELECT q.arm, q.t, coalesce(s.v, 1.0) AS v FROM q ASOF LEFT JOIN steps s ON q.arm = s.arm AND q.t > s.time""",
)
def asof_left(spark, d):
    s = stage(survival(spark, d).groupBy("arm", "time", "event").agg(F.count("*").cast("double").alias("v")), "asof")
    return R.asof(s.filter("event = 0").select("arm", F.col("time").alias("t")), s.filter("event = 1"), ["arm"], "t", "time", "v", "v", left_limit=True)


@query(
    "j17_risk_set",
    f"WITH {SURVIVAL} SELECT cohort, id, count(*) OVER (PARTITION BY cohort ORDER BY time DESC RANGE UNBOUNDED PRECEDING) AS at_risk FROM survival",
)
def risk_set(spark, d):
    """How many are still followed at each subject's time: a window instead of a range join."""
    w = Window.partitionBy("cohort").orderBy(F.col("time").desc()).rangeBetween(Window.unboundedPreceding, 0)
    return survival(spark, d).select("cohort", "id", F.count("*").over(w).alias("at_risk"))


@query(
    "j18_crosswalk_projection",
    f"WITH {EXPRESSION} SELECT sample, CAST(gene // 4 AS INTEGER) AS module, round(sum(value), 4) AS value FROM expression WHERE gene % 4 <> 3 GROUP BY 1, 2",
)
def crosswalk_projection(spark, d):
    x = expression(spark, d)
    mapping = x.select("gene").distinct().filter("gene % 4 <> 3").select("gene", F.floor(F.col("gene") / 4).cast("int").alias("module"))
    return R.crosswalk(x, mapping, "gene", "module", "value", ["sample"]).withColumn("value", F.round("value", 4))


@query("u1_union_all", "SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("u2_union_missing", "SELECT c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def union_missing(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name")), allowMissingColumns=True)


_IDS = "a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("u3_set_algebra", f"WITH {_IDS} SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_algebra(spark, d):
    o = table(spark, d, "orders")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).distinct()
    b = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    sets = {"both": a.intersect(b), "only_a": a.exceptAll(b), "any": a.union(b).distinct()}
    return reduce(lambda x, y: x.unionAll(y), (s.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, s in sets.items()))


@query(
    "u4_coverage_fraction",
    """WITH sets AS (SELECT p_type AS module, list(DISTINCT p_name) AS genes FROM part GROUP BY 1), have AS (SELECT list(DISTINCT p_name) AS have FROM part WHERE p_size < 5)
    SELECT module, CAST(len(genes) AS INTEGER) AS n, CAST(len(list_intersect(genes, have)) AS INTEGER) AS covered, round(len(list_intersect(genes, have)) / len(genes), 6) AS fraction FROM sets, have""",
)
def coverage_fraction(spark, d):
    p = table(spark, d, "part")
    have = p.filter("p_size < 5").select("p_name").distinct().withColumn("hit", F.lit(1))
    genes = p.select(F.col("p_type").alias("module"), "p_name").distinct().join(have, "p_name", "left")
    return genes.groupBy("module").agg(F.count("*").cast("int").alias("n"), F.count("hit").cast("int").alias("covered")).withColumn("fraction", F.round(F.col("covered") / F.col("n"), 6))


@query(
    "u6_set_signature",
    "SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 15)) AS HUGEINT)) AS VARCHAR) AS signature FROM (SELECT DISTINCT c_nationkey, c_custkey FROM customer) GROUP BY 1",
)
def set_signature(spark, d):
    """Sets with the same ids have the same signature, in whatever order; digests are added up, no set is gathered."""
    return signature(table(spark, d, "customer").select("c_nationkey", "c_custkey").distinct(), ["c_nationkey"])


@query(
    "u7_cohort_overlap",
    """WITH m AS (SELECT DISTINCT o_orderpriority AS cohort, o_custkey AS id FROM orders) SELECT a.cohort AS cohort_a, b.cohort AS cohort_b, count(*) AS overlap_n
    FROM m a JOIN m b ON a.id = b.id AND a.cohort < b.cohort GROUP BY 1, 2""",
)
def cohort_overlap(spark, d):
    o = R.overlaps(table(spark, d, "orders"), "o_orderpriority", "o_custkey")
    return o.select(F.col("a").alias("cohort_a"), F.col("b").alias("cohort_b"), F.col("n_both").alias("overlap_n"))


@query(
    "j9_lookup_by_index",
    "SELECT c_custkey, n_name, (SELECT count(*) FROM customer a WHERE NOT EXISTS (SELECT 1 FROM nation b WHERE a.c_nationkey = b.n_nationkey)) AS n_missing FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def lookup_by_index(spark, d):
    """Rows looked up by key in a table whose key is unique, and how many have none there."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    missing = c.join(n, "c_nationkey", "left_anti").count()
    return R.checked_join(c, n, ["c_nationkey"], "inner").select("c_custkey", "n_name", F.lit(missing).cast("long").alias("n_missing"))


@query(
    "j21_interval_overlap",
    f"""WITH {SURVIVAL}, o AS (SELECT id, arm, epoch(o_orderdate) / 86400 AS a, epoch(o_orderdate) / 86400 + time AS b, x FROM survival JOIN orders ON o_orderkey = id),
    p AS (SELECT l_suppkey % 25 AS grp, date_trunc('month', l_shipdate) AS m, epoch(min(l_shipdate)) / 86400 AS c, epoch(max(l_shipdate)) / 86400 AS e FROM lineitem GROUP BY 1, 2),
    s AS (SELECT grp, c, e + CASE WHEN grp = 3 THEN 700 ELSE 1 END AS d FROM p)
    SELECT grp, arm, count(*) AS pairs, round(sum(x), 0) AS total, round(sum(least(b, d) - greatest(a, c)), 3) AS shared FROM o JOIN s ON a < d AND c < b GROUP BY 1, 2""",
)
def interval_overlap(spark, d):
    """Orders under way against the periods in which groups of suppliers shipped; one group's periods are very long."""
    day = lambda c: F.unix_timestamp(c) / 86400.0
    dates = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day("o_orderdate").alias("a"))
    o = survival(spark, d).join(dates, "id").select("id", "arm", "a", (F.col("a") + F.col("time")).alias("b"), "x")
    grp = (F.col("l_suppkey") % 25).alias("grp")
    li = table(spark, d, "lineitem").groupBy(grp, F.date_trunc("month", "l_shipdate").alias("m")).agg(day(F.min("l_shipdate")).alias("c"), day(F.max("l_shipdate")).alias("e"))
    s = li.select("grp", "c", (F.col("e") + F.when(F.col("grp") == 3, 700.0).otherwise(1.0)).alias("d"))
    pairs = intervals.overlap_join(o, s, ("a", "b"), ("c", "d"))
    shared = F.sum(F.least("b", "d") - F.greatest("a", "c"))
    return pairs.groupBy("grp", "arm").agg(F.count("*").alias("pairs"), F.round(F.sum("x"), 0).alias("total"), F.round(shared, 3).alias("shared"))
