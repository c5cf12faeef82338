"""Diagnostic and decision queries, and gene-set structure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions import stats
from ..operators import relational as R
from ..shared import stage
from .aggregates import _SCENARIO, _WEIGHTS, scenario_summary, weights
from .entities import DELTAS, DESIGN, EXPRESSION, SURVIVAL, deltas, design, expression, survival, table
from .registry import query
from .survival import _UNO, _tau

_r = lambda c, n=6: F.round(c, n)


@query("q1_transfer_flags", f"WITH {DELTAS} SELECT scenario, model, replicate, delta <= -0.02 AS negative, delta <= -0.05 AS catastrophic FROM deltas")
def transfer_flags(spark, d):
    x = S.finite("delta")
    return deltas(spark, d).select("scenario", "model", "replicate", (x <= -0.02).alias("negative"), (x <= -0.05).alias("catastrophic"))


_OVERALL = f"{_SCENARIO}, o AS (SELECT model, avg(mean_delta) AS mean_delta, avg(nt) AS nt, avg(cat) AS cat FROM s GROUP BY 1)"


def _overall(spark, d):
    return scenario_summary(spark, d).groupBy("model").agg(*(F.avg(c).alias(c) for c in ("mean_delta", "nt", "cat")))


@query(
    "q2_architecture_decision",
    f"""WITH {_OVERALL}, w AS (SELECT max(mean_delta) FILTER (model = 'click') AS d2, max(nt) FILTER (model = 'click') AS n2, max(cat) FILTER (model = 'click') AS c2, max(mean_delta) FILTER (model = 'purchase') AS d3, max(nt) FILTER (model = 'purchase') AS n3 FROM o)
    SELECT round(d2, 6) AS delta_a2, round(d3, 6) AS delta_a3, round(n2, 6) AS nt_a2, round(n3, 6) AS nt_a3, CASE WHEN d2 > 0 AND n2 <= 0.45 AND c2 <= 0.45 THEN 'SELECT_A2' WHEN d3 > 0 AND n3 <= n2 THEN 'SELECT_A3' WHEN d2 > d3 THEN 'A2_WITH_GATE' ELSE 'TARGET_ONLY' END AS decision FROM w""",
)
def architecture_decision(spark, d):
    """Flags, equal-scenario rates, and a decision from the two candidates' row."""
    is_ = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    w = _overall(spark, d).agg(is_("click", "mean_delta").alias("d2"), is_("click", "nt").alias("n2"), is_("click", "cat").alias("c2"), is_("purchase", "mean_delta").alias("d3"), is_("purchase", "nt").alias("n3"))
    rule = F.when((F.col("d2") > 0) & (F.col("n2") <= 0.45) & (F.col("c2") <= 0.45), "SELECT_A2").when((F.col("d3") > 0) & (F.col("n3") <= F.col("n2")), "SELECT_A3").when(F.col("d2") > F.col("d3"), "A2_WITH_GATE").otherwise("TARGET_ONLY")
    return w.select(_r("d2").alias("delta_a2"), _r("d3").alias("delta_a3"), _r("n2").alias("nt_a2"), _r("n3").alias("nt_a3"), rule.alias("decision"))


@query("q3_shift_branch", f"WITH {_SCENARIO}, {DESIGN}, g AS (SELECT severity, avg(mean_delta) AS m FROM s JOIN design USING (scenario) WHERE model = 'click' GROUP BY 1) SELECT CAST(sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) AS BIGINT) AS triggers, CASE WHEN sum(CASE WHEN m < 0 THEN 1 ELSE 0 END) >= 2 THEN 'ADD_SHIFT_ARM' ELSE 'KEEP' END AS branch FROM g")
def shift_branch(spark, d):
    g = scenario_summary(spark, d).filter("model = 'click'").join(design(spark, d), "scenario").groupBy("severity").agg(F.avg("mean_delta").alias("m"))
    n = F.count_if(F.col("m") < 0)
    return g.agg(n.alias("triggers"), F.when(n >= 2, "ADD_SHIFT_ARM").otherwise("KEEP").alias("branch"))


_GATE = "m AS (SELECT vec_id, label, unnest(range(len(embedding))) AS module, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), g AS (SELECT *, 1 / (1 + exp(-20 * v)) AS gate, module % 4 = 0 AS causal, v > 0 AS useful FROM m)"


def _gates(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("module", "v"))
    v = F.col("v").cast("double")
    return m.select("vec_id", "label", "module", S.sigmoid(20 * v).alias("gate"), (F.col("module") % 4 == 0).alias("causal"), (v > 0).alias("useful"))


@query("q4_gate_truth", f"WITH {_GATE} SELECT label, round(avg(CASE WHEN gate >= 0.5 THEN 1.0 ELSE 0.0 END) FILTER (NOT causal), 6) AS false_borrow, round(avg(gate) FILTER (causal), 6) AS gate_causal, round(avg(gate) FILTER (NOT causal), 6) AS gate_other FROM g GROUP BY 1")
def gate_truth(spark, d):
    c = F.col("causal")
    return _gates(spark, d).groupBy("label").agg(_r(F.avg(F.when(~c, (F.col("gate") >= 0.5).cast("double")))).alias("false_borrow"), _r(F.avg(F.when(c, F.col("gate")))).alias("gate_causal"), _r(F.avg(F.when(~c, F.col("gate")))).alias("gate_other"))


@query("q5_gate_harm", f"WITH {_GATE}, c AS (SELECT vec_id, CASE WHEN NOT causal THEN 'non_causal' WHEN useful AND gate >= 0.5 THEN 'beneficial' WHEN useful THEN 'attenuated' ELSE 'harmful_flip' END AS class, gate FROM g), p AS (SELECT vec_id, class, sum(gate) AS mass FROM c GROUP BY 1, 2) SELECT class, round(avg(mass), 5) AS mass, count(*) AS n FROM p GROUP BY 1")
def gate_harm(spark, d):
    kind = F.when(~F.col("causal"), "non_causal").when(F.col("useful") & (F.col("gate") >= 0.5), "beneficial").when(F.col("useful"), "attenuated").otherwise("harmful_flip")
    p = _gates(spark, d).groupBy("vec_id", kind.alias("class")).agg(F.sum("gate").alias("mass"))
    return p.groupBy("class").agg(_r(F.avg("mass"), 5).alias("mass"), F.count("*").alias("n"))


_POLICY = f"{DELTAS}, {DESIGN}, p AS (SELECT n.n AS threshold, scenario, avg(CASE WHEN events >= n.n THEN delta ELSE 0 END) AS gain, avg(CASE WHEN (CASE WHEN events >= n.n THEN delta ELSE 0 END) <= -0.02 THEN 1.0 ELSE 0.0 END) AS nt, max(CASE WHEN events >= n.n THEN 1.0 ELSE 0.0 END) AS active FROM deltas JOIN design USING (scenario), (SELECT unnest([0, 10, 20, 40]) AS n) n WHERE model = 'click' AND delta IS NOT NULL GROUP BY 1, 2)"


def _policies(spark, d):
    """Transfer only where the design has enough events; a row per threshold and scenario."""
    x = deltas(spark, d).filter("model = 'click' AND delta IS NOT NULL").join(design(spark, d), "scenario").withColumn("threshold", F.explode(F.array(*map(F.lit, (0, 10, 20, 40)))))
    on = F.col("events") >= F.col("threshold")
    used = F.when(on, F.col("delta")).otherwise(0.0)
    return x.groupBy("threshold", "scenario").agg(F.avg(used).alias("gain"), F.avg((used <= -0.02).cast("double")).alias("nt"), F.max(on.cast("double")).alias("active"))


@query("q6_event_policies", f"WITH {_POLICY} SELECT threshold, round(avg(gain), 6) AS gain, round(avg(nt), 6) AS nt, round(avg(active), 6) AS active FROM p GROUP BY 1")
def event_policies(spark, d):
    return _policies(spark, d).groupBy("threshold").agg(*(_r(F.avg(c)).alias(c) for c in ("gain", "nt", "active")))


@query(
    "q6b_oracle_policies",
    f"""WITH {DELTAS}, w AS (SELECT scenario, replicate, max(delta) FILTER (model = 'click') AS a1, max(delta) FILTER (model = 'purchase') AS a2 FROM deltas GROUP BY 1, 2), v AS (SELECT * FROM w WHERE a1 IS NOT NULL AND a2 IS NOT NULL),
    s AS (SELECT scenario, avg(greatest(0, a1)) AS oracle, avg(CASE WHEN a1 >= 0.02 THEN a1 ELSE 0 END) AS cautious, avg(greatest(0, a1, a2)) AS envelope, avg(CASE WHEN a1 > 0 AND a1 >= a2 THEN 1.0 ELSE 0.0 END) AS took_a1 FROM v GROUP BY 1)
    SELECT round(avg(oracle), 5) AS oracle, round(avg(cautious), 5) AS cautious, round(avg(envelope), 5) AS envelope, round(avg(took_a1), 6) AS took_a1 FROM s""",
)
def oracle_policies(spark, d):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("delta")))
    v = deltas(spark, d).groupBy("scenario", "replicate").agg(one("click").alias("a1"), one("purchase").alias("a2")).dropna()
    zero = F.lit(0.0)
    s = v.groupBy("scenario").agg(
        F.avg(F.greatest(zero, "a1")).alias("oracle"), F.avg(F.when(F.col("a1") >= 0.02, F.col("a1")).otherwise(0.0)).alias("cautious"), F.avg(F.greatest(zero, "a1", "a2")).alias("envelope"), F.avg(((F.col("a1") > 0) & (F.col("a1") >= F.col("a2"))).cast("double")).alias("took_a1")
    )
    return s.agg(*(_r(F.avg(c), 5).alias(c) for c in ("oracle", "cautious", "envelope")), _r(F.avg("took_a1")).alias("took_a1"))


_GO = f"""{DELTAS}, {DESIGN}, y AS (SELECT events, CASE WHEN delta >= 0.02 THEN 1 ELSE 0 END AS y, metric FROM deltas JOIN design USING (scenario) WHERE model = 'click' AND abs(delta) >= 0.02),
  r AS (SELECT *, rank() OVER (PARTITION BY events ORDER BY metric) + (count(*) OVER (PARTITION BY events, metric) - 1) / 2.0 AS r FROM y),
  a AS (SELECT events, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc FROM r GROUP BY 1)"""


def _auc_by_events(spark, d):
    x = deltas(spark, d).filter("model = 'click' AND abs(delta) >= 0.02").join(design(spark, d), "scenario").withColumn("y", (F.col("delta") >= 0.02).cast("int"))
    return stats.average_rank(x, "metric", ["events"], "r").groupBy("events").agg(stats.auc_from_ranks("y", "r").alias("auc"))


@query("q6c_auroc_by_budget", f"WITH {_GO} SELECT events, round(auc, 6) AS auc, CASE WHEN auc IS NULL THEN 'NOT_ASSESSABLE' WHEN auc >= 0.8 THEN 'GO' WHEN auc >= 0.65 THEN 'LIMITED' ELSE 'STOP' END AS rule FROM a")
def auroc_by_budget(spark, d):
    a = F.col("auc")
    rule = F.when(a.isNull(), "NOT_ASSESSABLE").when(a >= 0.8, "GO").when(a >= 0.65, "LIMITED").otherwise("STOP")
    return _auc_by_events(spark, d).select("events", _r("auc").alias("auc"), rule.alias("rule"))


@query("q6e_rate_by_bin", f"WITH {DELTAS} SELECT CASE WHEN metric <= 5 THEN '(0,5]' WHEN metric <= 20 THEN '(5,20]' WHEN metric <= 1000 THEN '(20,1000]' END AS bin, count(*) AS n, round(avg(CASE WHEN delta <= -0.05 THEN 1.0 ELSE 0.0 END), 6) AS catastrophic FROM deltas WHERE model = 'click' AND delta IS NOT NULL GROUP BY 1")
def rate_by_bin(spark, d):
    x = deltas(spark, d).filter("model = 'click' AND delta IS NOT NULL")
    return x.groupBy(S.bin_label("metric", (0, 5, 20, 1000)).alias("bin")).agg(F.count("*").alias("n"), _r(F.avg((F.col("delta") <= -0.05).cast("double"))).alias("catastrophic"))


@query("q6f_matched_contrast", f"WITH {_SCENARIO}, {DESIGN}, x AS (SELECT regime, events, severity, avg(mean_delta) AS m FROM s JOIN design USING (scenario) WHERE model = 'click' GROUP BY 1, 2, 3) SELECT a.regime, a.events, b.severity AS level, round(b.m - a.m, 6) AS contrast FROM x a JOIN x b ON a.regime = b.regime AND a.events = b.events AND a.severity = 0 AND b.severity > 0")
def matched_contrast(spark, d):
    """The same design but for one axis, against that axis's lowest level."""
    x = scenario_summary(spark, d).filter("model = 'click'").join(design(spark, d), "scenario").groupBy("regime", "events", "severity").agg(F.avg("mean_delta").alias("m"))
    base = F.max(F.when(F.col("severity") == 0, F.col("m"))).over(Window.partitionBy("regime", "events"))
    y = x.withColumn("base", base).filter("severity > 0 AND base IS NOT NULL")
    return y.select("regime", "events", F.col("severity").alias("level"), _r(F.col("m") - F.col("base")).alias("contrast"))


@query(
    "q7_compatibility_utility",
    f"""WITH {DELTAS}, c AS (SELECT model, replicate, metric, delta, rank() OVER (PARTITION BY model ORDER BY metric) + (count(*) OVER (PARTITION BY model, metric) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY model ORDER BY delta) + (count(*) OVER (PARTITION BY model, delta) - 1) / 2.0 AS rd FROM deltas WHERE delta IS NOT NULL AND model <> 'view'),
    r AS (SELECT model, covar_pop(rm, rd) / (stddev_pop(rm) * stddev_pop(rd)) AS rho FROM c GROUP BY 1) SELECT model, round(rho, 6) AS rho, CASE WHEN rho >= 0.5 THEN 'aligned' WHEN rho <= -0.5 THEN 'opposed' ELSE 'weak' END AS label FROM r""",
)
def compatibility_utility(spark, d):
    x = deltas(spark, d).filter("delta IS NOT NULL AND model <> 'view'")
    x = stats.average_rank(stats.average_rank(x, "metric", ["model"], "rm"), "delta", ["model"], "rd")
    r = x.groupBy("model").agg(stats.pearson("rm", "rd", 5).alias("rho"))
    return r.select("model", _r("rho").alias("rho"), F.when(F.col("rho") >= 0.5, "aligned").when(F.col("rho") <= -0.5, "opposed").otherwise("weak").alias("label"))


@query(
    "q8_policy_frontier",
    f"""WITH {_POLICY}, t AS (SELECT threshold, avg(gain) AS gain, avg(nt) AS nt FROM p GROUP BY 1) SELECT threshold, round(gain, 6) AS gain, round(nt, 6) AS nt FROM t a
    WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.gain >= a.gain - 1e-12 AND b.nt <= a.nt + 1e-12 AND (b.gain > a.gain + 1e-12 OR b.nt < a.nt - 1e-12))""",
)
def policy_frontier(spark, d):
    t = stage(_policies(spark, d).groupBy("threshold").agg(F.avg("gain").alias("gain"), F.avg("nt").alias("nt")).withColumn("g", F.lit(0)), "policies")
    return R.not_dominated(t, ["g"], ["gain"], ["nt"]).select("threshold", _r("gain").alias("gain"), _r("nt").alias("nt"))


@query("q9_absolute_auc_sensitivity", f"WITH {DELTAS}, y AS (SELECT user_id % 4 AS g, CASE WHEN value >= 40 THEN 1 ELSE 0 END AS y, event_id AS score FROM events WHERE value >= 40 OR value <= 10), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) AS r FROM y) SELECT g, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r GROUP BY 1")
def absolute_auc(spark, d):
    """High against low values; the middle is left out."""
    y = table(spark, d, "events").filter("value >= 40 OR value <= 10").select((F.col("user_id") % 4).alias("g"), (F.col("value") >= 40).cast("int").alias("y"), F.col("event_id").alias("score"))
    return stats.average_rank(y, "score", ["g"], "r").groupBy("g").agg(_r(stats.auc_from_ranks("y", "r")).alias("auc"))


@query("q10_risk_scale_by_subset", f"WITH {SURVIVAL}, u AS (SELECT 'ALL' AS subset, risk FROM survival UNION ALL SELECT 'EVENTS', risk FROM survival WHERE event = 1) SELECT subset, count(*) AS n, round(stddev_pop(risk), 6) AS sd, round(quantile_cont(risk, 0.99) - quantile_cont(risk, 0.01), 6) AS spread FROM u GROUP BY 1")
def risk_scale(spark, d):
    x = survival(spark, d).withColumn("subset", F.explode(F.filter(F.array(F.lit("ALL"), F.when(F.col("event") == 1, "EVENTS")), lambda s: s.isNotNull())))
    return x.groupBy("subset").agg(F.count("*").alias("n"), _r(F.stddev_pop("risk")).alias("sd"), _r(F.percentile("risk", 0.99) - F.percentile("risk", 0.01)).alias("spread"))


@query("q11_paired_contrasts", f"WITH {_SCENARIO}, w AS (SELECT scenario, max(mean_delta) FILTER (model = 'click') AS a, max(mean_delta) FILTER (model = 'purchase') AS b, max(mean_delta) FILTER (model = 'signup') AS c FROM s GROUP BY 1), h AS (SELECT unnest(['H1', 'H2']) AS hypothesis, unnest([a - b, a - c]) AS diff FROM w), t AS (SELECT hypothesis, count(diff) AS n, avg(diff) AS m, stddev_samp(diff) / sqrt(count(diff)) AS se FROM h GROUP BY 1) SELECT hypothesis, n, round(m, 6) AS mean, CASE WHEN m - 1.96 * se > 0 THEN 'SUPPORTED' WHEN m + 1.96 * se < 0 THEN 'CONTRADICTED' ELSE 'UNCERTAIN' END AS status FROM t")
def paired_contrasts(spark, d):
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("mean_delta")))
    w = scenario_summary(spark, d).groupBy("scenario").agg(one("click").alias("a"), one("purchase").alias("b"), one("signup").alias("c"))
    h = w.select(F.inline(F.array(F.struct(F.lit("H1").alias("hypothesis"), (F.col("a") - F.col("b")).alias("diff")), F.struct(F.lit("H2").alias("hypothesis"), (F.col("a") - F.col("c")).alias("diff")))))
    t = h.groupBy("hypothesis").agg(F.count("diff").alias("n"), F.avg("diff").alias("m"), (F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("se"))
    status = F.when(F.col("m") - 1.96 * F.col("se") > 0, "SUPPORTED").when(F.col("m") + 1.96 * F.col("se") < 0, "CONTRADICTED").otherwise("UNCERTAIN")
    return t.select("hypothesis", "n", _r("m").alias("mean"), status.alias("status"))


@query("q12_cell_model_summary", f"WITH {DELTAS}, {DESIGN} SELECT events, severity, model, count(*) AS n, round(avg(delta), 5) AS mean_delta, round(avg(CASE WHEN coalesce(delta <= -0.02, false) THEN 1.0 ELSE 0.0 END), 6) AS flagged FROM deltas JOIN design USING (scenario) GROUP BY 1, 2, 3")
def cell_model_summary(spark, d):
    """Here a missing delta counts as not flagged, unlike in the rates over valid rows."""
    x = deltas(spark, d).join(design(spark, d), "scenario")
    return x.groupBy("events", "severity", "model").agg(F.count("*").alias("n"), _r(F.avg("delta"), 5).alias("mean_delta"), _r(F.avg(F.coalesce(F.col("delta") <= -0.02, F.lit(False)).cast("double"))).alias("flagged"))


@query("q13_sign_inversion", f"WITH {_UNO.format(op='<')} SELECT cohort, round(c, 4) AS c_inverted FROM c")
def sign_inversion(spark, d):
    from ..operators import survival as V

    x = stage(survival(spark, d).withColumn("risk", -F.col("risk")), "inverted")
    return V.uno_fast(x, "cohort", _tau(x)).filter("c IS NOT NULL").select("cohort", _r("c", 4).alias("c_inverted"))


@query("q15_threshold_reference", f"WITH {DELTAS}, r AS (SELECT model, t.t AS threshold, avg(CASE WHEN delta <= t.t THEN 1.0 ELSE 0.0 END) AS rate FROM deltas, (SELECT unnest([-30.0::DOUBLE, -20.0, -10.0]) AS t) t WHERE delta IS NOT NULL AND model <> 'view' GROUP BY 1, 2) SELECT model, threshold, round(rate, 6) AS rate, round(rate - max(rate) FILTER (threshold = -20.0) OVER (PARTITION BY model), 6) AS difference FROM r")
def threshold_reference(spark, d):
    """Each threshold's rate, and its difference to the primary threshold's."""
    cuts = (-30.0, -20.0, -10.0)
    wide = deltas(spark, d).filter("delta IS NOT NULL AND model <> 'view'").groupBy("model").agg(*(F.avg((F.col("delta") <= c).cast("double")).alias(f"c{i}") for i, c in enumerate(cuts)))
    rows = F.array(*(F.struct(F.lit(c).alias("threshold"), _r(f"c{i}").alias("rate"), _r(F.col(f"c{i}") - F.col("c1")).alias("difference")) for i, c in enumerate(cuts)))
    return wide.select("model", F.inline(rows))


@query("q16_aggregation_sensitivity", f"WITH {_SCENARIO}, {_WEIGHTS}, p AS (SELECT estimand, model, sum(w * mean_delta) AS v FROM weights JOIN s USING (scenario) GROUP BY 1, 2) SELECT estimand, model, round(v, 6) AS value, round(v - max(v) FILTER (estimand = 'original') OVER (PARTITION BY model), 6) AS difference FROM p")
def aggregation_sensitivity(spark, d):
    p = weights(spark, d).join(scenario_summary(spark, d), "scenario").groupBy("estimand", "model").agg(F.sum(F.col("w") * F.col("mean_delta")).alias("v"))
    ref = F.max(F.when(F.col("estimand") == "original", F.col("v"))).over(Window.partitionBy("model"))
    return p.select("estimand", "model", _r("v").alias("value"), _r(F.col("v") - ref).alias("difference"))


@query("q17_traffic_light", "WITH g AS (SELECT c_nationkey AS g, avg(c_acctbal) / 10000 AS r2, avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0 ELSE 0.0 END) AS auc FROM customer GROUP BY 1) SELECT g, CASE WHEN r2 < 0.3 OR auc < 0.1 THEN 'RED' WHEN r2 >= 0.42 AND auc >= 0.18 THEN 'GREEN' ELSE 'AMBER' END AS light FROM g")
def traffic_light(spark, d):
    """RED takes any failure, GREEN needs all passes."""
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg((F.avg("c_acctbal") / 10000).alias("r2"), F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("auc"))
    return g.select("g", F.when((F.col("r2") < 0.3) | (F.col("auc") < 0.1), "RED").when((F.col("r2") >= 0.42) & (F.col("auc") >= 0.18), "GREEN").otherwise("AMBER").alias("light"))


@query("q18_status_rules", f"WITH {SURVIVAL}, a AS (SELECT arm, count(*) AS n, sum(event) AS e FROM survival GROUP BY 1) SELECT arm, CASE WHEN e < 10 THEN 'INSUFFICIENT' WHEN e / n < 0.2 THEN 'LOW_RATE' WHEN n > 2000 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS status FROM a")
def status_rules(spark, d):
    a = survival(spark, d).groupBy("arm").agg(F.count("*").alias("n"), F.sum("event").alias("e"))
    return a.select("arm", F.when(F.col("e") < 10, "INSUFFICIENT").when(F.col("e") / F.col("n") < 0.2, "LOW_RATE").when(F.col("n") > 2000, "PRIMARY").otherwise("SUPPORTING").alias("status"))


@query("q19_target_branch", f"WITH {_OVERALL}, w AS (SELECT max(mean_delta) FILTER (model = 'click') AS a, max(mean_delta) FILTER (model = 'purchase') AS b, max(nt) FILTER (model = 'click') AS nt FROM o) SELECT CASE WHEN nt > 0.5 THEN 'T-D' WHEN a > 0 AND b > 0 THEN 'T-A' WHEN a > 0 THEN 'T-B' ELSE 'T-C' END AS candidate, CASE WHEN nt > 0.4 AND NOT nt > 0.5 THEN 'DOWNGRADED' ELSE 'FINAL' END AS certainty FROM w")
def target_branch(spark, d):
    one = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    w = _overall(spark, d).agg(one("click", "mean_delta").alias("a"), one("purchase", "mean_delta").alias("b"), one("click", "nt").alias("nt"))
    branch = F.when(F.col("nt") > 0.5, "T-D").when((F.col("a") > 0) & (F.col("b") > 0), "T-A").when(F.col("a") > 0, "T-B").otherwise("T-C")
    return w.select(branch.alias("candidate"), F.when((F.col("nt") > 0.4) & ~(F.col("nt") > 0.5), "DOWNGRADED").otherwise("FINAL").alias("certainty"))


@query("q20_fit_label", "SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.8 THEN 'strong' WHEN c_acctbal / 10000 >= 0.6 THEN 'moderate' WHEN c_acctbal / 10000 >= 0.5 THEN 'weak' ELSE 'none' END AS label FROM customer")
def fit_label(spark, d):
    c = F.col("c_acctbal") / 10000
    return table(spark, d, "customer").select("c_custkey", F.when(c >= 0.8, "strong").when(c >= 0.6, "moderate").when(c >= 0.5, "weak").otherwise("none").alias("label"))


@query("q21_boundary_audit", "WITH g AS (SELECT x AS alpha, count(p_partkey) AS n FROM (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS x) LEFT JOIN part ON p_size = x GROUP BY 1) SELECT alpha, n, round(n / sum(n) OVER (), 6) AS share, alpha IN (1, 50) AS at_boundary FROM g")
def boundary_audit(spark, d):
    """How often each value of a grid was chosen, and whether its ends were."""
    n = table(spark, d, "part").groupBy(F.col("p_size").alias("alpha")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    g = spark.range(1, 51).select(F.col("id").cast("int").alias("alpha")).join(n, "alpha", "left").select("alpha", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("one"))
    g = g.join(total.withColumn("one", F.lit(1)), "one")
    return g.select("alpha", "n", _r(F.try_divide("n", "total")).alias("share"), F.col("alpha").isin(1, 50).alias("at_boundary"))


@query(
    "q22_one_to_one_audit",
    """WITH m AS (SELECT DISTINCT p_name AS source, p_type AS target FROM part), u AS (SELECT *, count(*) OVER (PARTITION BY source) AS ns, count(*) OVER (PARTITION BY target) AS nt FROM m)
    SELECT count(*) AS pairs, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets, count(*) FILTER (ns = 1) AS unique_source, count(*) FILTER (ns = 1 AND nt = 1) AS one_to_one FROM u""",
)
def one_to_one_audit(spark, d):
    m = table(spark, d, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target")).distinct()
    u = m.withColumns({"ns": F.count("*").over(Window.partitionBy("source")), "nt": F.count("*").over(Window.partitionBy("target"))})
    return u.agg(F.count("*").alias("pairs"), F.count_distinct("source").alias("sources"), F.count_distinct("target").alias("targets"), F.count_if(F.col("ns") == 1).alias("unique_source"), F.count_if((F.col("ns") == 1) & (F.col("nt") == 1)).alias("one_to_one"))


@query("q23_module_eligibility", "WITH c AS (SELECT p_type AS library, p_brand AS module, count(DISTINCT p_name) AS n, count(DISTINCT CASE WHEN p_size < 20 THEN p_name END) AS covered FROM part GROUP BY 1, 2) SELECT library, count(*) AS modules, count(*) FILTER (covered >= 3 AND covered / n >= 0.5) AS eligible, round(median(covered / n), 6) AS median_coverage FROM c GROUP BY 1")
def module_eligibility(spark, d):
    c = table(spark, d, "part").groupBy(F.col("p_type").alias("library"), F.col("p_brand").alias("module")).agg(F.count_distinct("p_name").alias("n"), F.count_distinct(F.when(F.col("p_size") < 20, F.col("p_name"))).alias("covered"))
    share = F.col("covered") / F.col("n")
    return c.groupBy("library").agg(F.count("*").alias("modules"), F.count_if((F.col("covered") >= 3) & (share >= 0.5)).alias("eligible"), _r(F.median(share)).alias("median_coverage"))


_EDGES = f"""{EXPRESSION}, e AS (SELECT a.gene // 8 AS gs, a.cohort, a.gene AS g1, b.gene AS g2, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) AS r
  FROM expression a JOIN expression b ON a.sample = b.sample AND a.gene // 8 = b.gene // 8 AND a.gene < b.gene GROUP BY 1, 2, 3, 4),
  w AS (SELECT gs, g1, g2, max(r) FILTER (cohort = 'A') AS ra, max(r) FILTER (cohort = 'B') AS rb FROM e GROUP BY 1, 2, 3)"""


def _edges(spark, d):
    """Correlations of all gene pairs of a set, in both cohorts, from one pass of moments.

    A sample's genes of a set are one array, so its pairs come from the array; samples never meet.
    """
    x = expression(spark, d).withColumn("gs", F.floor(F.col("gene") / 8))
    rows = x.groupBy("sample", "cohort", "gs").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["gene"] > a["gene"]), lambda b: F.struct(a["gene"].alias("g1"), b["gene"].alias("g2"), a["value"].alias("x"), b["value"].alias("y")))))
    e = rows.select("cohort", "gs", F.inline(pairs)).groupBy("gs", "cohort", "g1", "g2").agg(stats.pearson("x", "y").alias("r"))
    one = lambda c: F.max(F.when(F.col("cohort") == c, F.col("r")))
    return e.groupBy("gs", "g1", "g2").agg(one("A").alias("ra"), one("B").alias("rb"))


@query("q24_edge_concordance", f"WITH {_EDGES}, k AS (SELECT *, rank() OVER (PARTITION BY gs ORDER BY ra) AS ka, rank() OVER (PARTITION BY gs ORDER BY rb) AS kb FROM w) SELECT gs AS gene_set, count(*) AS edges, round(corr(ra, rb), 4) AS pearson, round(corr(ka, kb), 4) AS spearman, round(avg(CASE WHEN sign(ra) = sign(rb) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement FROM k GROUP BY 1")
def edge_concordance(spark, d):
    k = stats.average_rank(stats.average_rank(_edges(spark, d), "ra", ["gs"], "ka"), "rb", ["gs"], "kb")
    return k.groupBy(F.col("gs").cast("int").alias("gene_set")).agg(F.count("*").alias("edges"), _r(stats.pearson("ra", "rb"), 4).alias("pearson"), _r(stats.pearson("ka", "kb"), 4).alias("spearman"), _r(F.avg((F.sign("ra") == F.sign("rb")).cast("double"))).alias("sign_agreement"))


@query("q25_ranked_landscape", f"WITH {_EDGES}, t AS (SELECT gs, avg(abs(ra - rb)) AS gap FROM w GROUP BY 1) SELECT gs AS gene_set, round(gap, 5) AS gap, gs IN (0, 3) AS anchor, rank() OVER (ORDER BY gap, gs) AS rank FROM t")
def ranked_landscape(spark, d):
    """All sets by how much their edges differ, anchors marked. A row per set is ranked."""
    t = _edges(spark, d).groupBy("gs").agg(F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("gap")).withColumn("all", F.lit(0))
    w = Window.partitionBy("all").orderBy("gap", "gs")
    return t.select(F.col("gs").cast("int").alias("gene_set"), _r("gap", 5).alias("gap"), F.col("gs").isin(0, 3).alias("anchor"), F.rank().over(w).cast("long").alias("rank"))
