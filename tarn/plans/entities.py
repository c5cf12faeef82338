"""The study's entities, derived from the tables at hand, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASELINE = "view"
NEGATIVE, CATASTROPHIC = -0.02, -0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario, model, replicate, metric``: a value per scenario, model and replicate."""
    place = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scenario"),
        F.col("event_type").alias("model"),
        F.row_number().over(place).cast("long").alias("replicate"),
        F.col("value").alias("metric"),
    )


METRICS = """metrics AS (
  SELECT user_id AS scenario, event_type AS model,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS replicate, value AS metric
  FROM events)"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with ``delta`` to the baseline of the same replicate; null where that has none.

    One window over (scenario, replicate) instead of a self join: one shuffle, not two.
    """
    same = Window.partitionBy("scenario", "replicate")
    base = F.max(F.when(F.col("model") == BASELINE, F.col("metric"))).over(same)
    return metrics(spark, sf_dir).withColumn("delta", F.col("metric") - base)


DELTAS = f"""{METRICS}, deltas AS (
  SELECT m.*, m.metric - b.metric AS delta FROM metrics m
  LEFT JOIN (SELECT scenario, replicate, metric FROM metrics WHERE model = '{BASELINE}') b USING (scenario, replicate))"""


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scenario, scenario_class, regime, events, severity``: the design row of each scenario."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("scenario")).distinct()
    level = F.array(*map(F.lit, (5, 10, 15, 20, 29, 40)))
    return s.select(
        "scenario",
        F.when(F.col("scenario") % 5 == 0, "CORE").otherwise("STRESS").alias("scenario_class"),
        F.concat(F.lit("R"), (F.col("scenario") % 6).cast("string"), F.lit("_"), F.when(F.col("scenario") % 2 == 0, "stable").otherwise("shifted")).alias("regime"),
        F.element_at(level, (F.col("scenario") % 6 + 1).cast("int")).alias("events"),
        (F.floor(F.col("scenario") / 6) % 3).cast("int").alias("severity"),
    )


DESIGN = """design AS (
  SELECT DISTINCT user_id AS scenario, CASE WHEN user_id % 5 = 0 THEN 'CORE' ELSE 'STRESS' END AS scenario_class,
         'R' || CAST(user_id % 6 AS VARCHAR) || '_' || CASE WHEN user_id % 2 = 0 THEN 'stable' ELSE 'shifted' END AS regime,
         ([5, 10, 15, 20, 29, 40])[CAST(user_id % 6 + 1 AS INTEGER)] AS events, CAST(user_id // 6 % 3 AS INTEGER) AS severity
  FROM events)"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, time, event, arm, cohort, x, risk``: subjects with a follow-up in days."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    o = table(spark, sf_dir, "orders")
    t = F.datediff("last", "o_orderdate")
    return (
        o.join(last, "o_orderkey")
        .filter(t > 0)
        .select(
            F.col("o_orderkey").alias("id"),
            t.cast("double").alias("time"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("event"),
            F.col("o_orderpriority").alias("arm"),
            F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), (F.col("o_custkey") % 20).cast("string")).alias("cohort"),
            F.col("o_totalprice").alias("x"),
            (F.col("o_totalprice") / 500000.0 - 0.5).alias("risk"),
        )
    )


SURVIVAL = """survival AS (
  SELECT o_orderkey AS id, CAST(datediff('day', CAST(o_orderdate AS DATE), CAST(last AS DATE)) AS DOUBLE) AS time,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event, o_orderpriority AS arm,
         substr(o_orderpriority, 1, 1) || '-' || CAST(o_custkey % 20 AS VARCHAR) AS cohort,
         o_totalprice AS x, o_totalprice / 500000.0 - 0.5 AS risk
  FROM orders JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) USING (o_orderkey)
  WHERE datediff('day', CAST(o_orderdate AS DATE), CAST(last AS DATE)) > 0)"""


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample, gene, value, cohort`` in long form: two cohorts of samples, one row per gene."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample"), F.when(F.col("label") < 5, "A").otherwise("B").alias("cohort"), F.posexplode("embedding").alias("gene", "v")
    ).select("sample", "gene", F.col("v").cast("double").alias("value"), "cohort")


EXPRESSION = """expression AS (
  SELECT vec_id AS sample, CASE WHEN label < 5 THEN 'A' ELSE 'B' END AS cohort,
         CAST(unnest(range(len(embedding))) AS INTEGER) AS gene, CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, selected, balance, segment, nation``: subjects, and whether they were selected."""
    chosen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return table(spark, sf_dir, "customer").join(chosen, "c_custkey", "left").select(
        F.col("c_custkey").alias("id"), F.coalesce("hit", F.lit(0)).alias("selected"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")
    )


SELECTION = """selection AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000) THEN 1 ELSE 0 END AS selected,
         c_acctbal AS balance, c_mktsegment AS segment, c_nationkey AS nation FROM customer)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, y, score, toxic, lang``: labelled rows with a score."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"), "lang")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "score", "toxic", "lang")


SCORES = """scores AS (
  SELECT doc_id, quality AS y, CAST(n_chars AS DOUBLE) AS score, toxic, lang FROM labels JOIN documents USING (doc_id))"""
