"""Queries for remediation, drift injection and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded, small_table
from scorewatch.operators import findings, injection, monitoring, remediation
from scorewatch.plans.queries_monitor import (
    ALERTS_SQL,
    CAUSES_SQL,
    order_catalog,
    alert_rules,
    detected,
)
from scorewatch.plans.queries_core import quantile_sql
from scorewatch.plans.registry import query
from scorewatch.plans.views import FEATURE_NAMES, REF_CUR_SQL, RISK_SQL, ROLES, r6, reference, risk, stored
from scorewatch.roles import Condition

# --- K. actions and retests -----------------------------------------------------------------


def bridged(spark, sf):
    """Findings of the detected alerts, computed once and kept as a small table."""
    snap, now, known, alerts = detected(spark, sf)
    causes = small_table(monitoring.root_causes(alerts, snap, now, top_k=3, known=known))
    found = findings.identified(
        remediation.alert_findings(alerts, causes), [remediation.BRIDGE_LIMITATION]
    )
    return alerts, causes, small_table(found)


KIND_SQL = """CASE alert_type WHEN 'schema' THEN 'data_quality' WHEN 'missingness' THEN 'data_quality' WHEN 'distribution' THEN 'feature_drift'
 WHEN 'population' THEN 'population_shift' WHEN 'label' THEN 'target_shift' ELSE 'rule_evidence' END"""
CODE_SQL = """'monitor_' || alert_type || '_' || scope || '_' || substring(sha256('{"alert_id":"' || a.alert_id || '"}'), 1, 16)"""
FOUND_SQL = f"""tops AS (SELECT alert_id, least(3, count(*)) AS causes, max(contribution) AS top FROM causes GROUP BY 1),
 found AS (SELECT {KIND_SQL} AS kind, severity, {CODE_SQL} AS code, CASE WHEN scope = 'feature' THEN scope_value END AS feature,
   CASE WHEN scope = 'family' THEN 2 WHEN alert_type = 'distribution' THEN 1 ELSE 0 END AS alert_evidence_count,
   coalesce(causes, 0) AS root_cause_count, reference_value, current_value, delta, top FROM alerts a LEFT JOIN tops USING (alert_id))"""


@query(
    "k8_alert_findings",
    f"""WITH {REF_CUR_SQL}, {ALERTS_SQL}, {CAUSES_SQL}, {FOUND_SQL} SELECT kind, severity, code, feature, CAST(alert_evidence_count AS DOUBLE) AS alert_evidence_count,
    CAST(root_cause_count AS DOUBLE) AS root_cause_count, reference_value, current_value, delta, round({r6('top')}, 4) AS top FROM found""",
)
def _(spark, sf):
    _, _, found = bridged(spark, sf)
    m = F.col("metrics")
    names = ("alert_evidence_count", "root_cause_count", "reference_value", "current_value", "delta")
    top = F.round(F.round(m["top_root_cause_contribution"], 6), 4)
    return rounded(
        found.select("kind", "severity", "code", "feature", *[m[n].alias(n) for n in names], top.alias("top"))
    )


ACTION_SQL = " ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, _) in remediation.ACTIONS.items())


@query(
    "k9_recommendations",
    f"""WITH {REF_CUR_SQL}, {ALERTS_SQL}, {CAUSES_SQL}, {FOUND_SQL} SELECT CASE kind {ACTION_SQL} END AS action_code,
    CASE WHEN max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) = 1 THEN 'critical' ELSE 'high' END AS priority,
    count(*) AS findings, 'analysis_only' AS decision_eligibility, kind || '_finding_present' AS rationale_code FROM found GROUP BY kind""",
)
def _(spark, sf):
    rows = remediation.recommendations(bridged(spark, sf)[2], "B")
    return rows.select(
        "action_code", "priority", F.size("finding_ids").cast("long").alias("findings"),
        "decision_eligibility", "rationale_code",
    )


def retested(spark, sf):
    """Findings after a planted, partial remediation."""
    _, _, before = bridged(spark, sf)
    kind, severity = F.col("kind"), F.col("severity")
    factor = F.when(kind == "data_quality", 0.5).when(kind == "target_shift", 2.0).otherwise(1.0)
    metrics = F.transform_values(
        "metrics", lambda k, v: F.when(k == "delta", v * factor).otherwise(v)
    )
    without = F.map_filter("metrics", lambda k, v: k != "delta")
    after = findings.identified(
        before.drop("finding_id")
        .filter(kind != "population_shift")
        .withColumn("metrics", F.when(kind == "rule_evidence", without).otherwise(metrics))
        .withColumn(
            "severity",
            F.when((kind == "rule_evidence") & (severity == "critical"), "warning").otherwise(severity),
        ),
        [remediation.BRIDGE_LIMITATION],
    )
    opened = remediation.open_remediations(remediation.recommendations(before))
    return opened, before, remediation.retest(opened, before, after)


OUTCOME_SQL = f"""outcome AS (SELECT {CODE_SQL} AS code, {KIND_SQL} AS kind, CASE WHEN alert_type = 'population' THEN 'resolved'
   WHEN scope = 'family' THEN 'inconclusive' WHEN alert_type IN ('missingness', 'schema') THEN 'resolved'
   WHEN alert_type IN ('distribution', 'label') THEN 'remaining'
   WHEN severity = 'critical' THEN 'resolved' ELSE 'inconclusive' END AS outcome FROM alerts a)"""


@query(
    "k10_retest",
    f"WITH {REF_CUR_SQL}, {ALERTS_SQL}, {OUTCOME_SQL} SELECT code, outcome FROM outcome",
)
def _(spark, sf):
    _, before, outcomes = retested(spark, sf)
    return outcomes.join(before.select("finding_id", "code"), "finding_id").select("code", "outcome")


@query(
    "k11_remediation_states",
    f"""WITH {REF_CUR_SQL}, {ALERTS_SQL}, {OUTCOME_SQL} SELECT CASE kind {ACTION_SQL} END AS action_code,
    CASE WHEN bool_or(outcome = 'remaining') THEN 'failed' WHEN bool_or(outcome = 'inconclusive') THEN 'awaiting_verification' ELSE 'verified' END AS status,
    count(*) AS findings FROM outcome GROUP BY kind""",
)
def _(spark, sf):
    opened, _, outcomes = retested(spark, sf)
    verified = remediation.verifications(outcomes)
    states = remediation.apply_verifications(opened, verified)
    return states.select("action_code", "status", F.size("finding_ids").cast("long").alias("findings"))


# --- L. drift injection ------------------------------------------------------------------------


def count_sql(share: float, source: str = "risk") -> str:
    return f"CAST(round_even((SELECT count(*) FROM {source}) * {share}::DOUBLE, 0) AS BIGINT)"


@query(
    "l1_selected_rows",
    f"WITH {RISK_SQL}, b AS (SELECT * FROM risk WHERE segment = 'BUILDING') SELECT {count_sql(0.3, 'b')} AS selected, (SELECT count(*) FROM risk) AS row_count, "
    f"{count_sql(0.3, 'b')} AS in_segment",
)
def _(spark, sf):
    s = injection.Scenario("a", "missingness", "ord_qty", 0.3, segment="BUILDING")
    chosen = injection.select_rows(stored(spark, sf), s)
    return chosen.agg(
        F.count_if("_selected").alias("selected"),
        F.count("*").alias("row_count"),
        F.count_if(F.col("_selected") & (F.col("segment") == "BUILDING")).alias("in_segment"),
    )


def injected(spark, sf, *args, **kwargs):
    # A schema drift reads no rows; the others read them to count, to choose and to change.
    rows = risk(spark, sf) if args[0] == "schema" else stored(spark, sf)
    return injection.inject(rows, injection.Scenario("x", *args, **kwargs))


@query(
    "l2_missingness",
    f"WITH {RISK_SQL} SELECT {count_sql(0.6)} AS missing, count(*) AS row_count FROM risk",
)
def _(spark, sf):
    df = injected(spark, sf, "missingness", "ord_qty", 0.6)
    return df.agg(F.count_if(F.col("ord_qty").isNull()).alias("missing"), F.count("*").alias("row_count"))


@query(
    "l3_numeric_shift",
    f"WITH {RISK_SQL} SELECT round(sum(ord_qty) + {count_sql(0.4)} * 0.4::DOUBLE * stddev_samp(ord_qty), 2) AS total, count(*) AS row_count FROM risk",
)
def _(spark, sf):
    df = injected(spark, sf, "numeric_shift", "ord_qty", 0.4)
    return df.agg(F.round(F.sum("ord_qty"), 2).alias("total"), F.count("*").alias("row_count"))


@query(
    "l4_population_shift",
    f"WITH {RISK_SQL} SELECT segment, count(*) + CASE WHEN segment = 'BUILDING' THEN {count_sql(0.6)} ELSE 0 END AS row_count FROM risk GROUP BY segment",
)
def _(spark, sf):
    df = injected(spark, sf, "population_shift", "segment", 0.6, segment="BUILDING")
    return df.groupBy("segment").agg(F.count("*").alias("row_count"))


@query("l5_label_shift", f"WITH {RISK_SQL} SELECT count(*) AS positives FROM risk")
def _(spark, sf):
    df = injected(spark, sf, "label_shift", "target", 1.0)
    return df.agg(F.sum("target").alias("positives"))


@query("l6_schema_drift", f"WITH {RISK_SQL} SELECT * EXCLUDE (ord_disc) FROM risk")
def _(spark, sf):
    return injected(spark, sf, "schema", "ord_disc", 0.3)


@query(
    "l7_rule_decay",
    f"WITH {RISK_SQL} SELECT CAST(sum(CASE WHEN ord_disc > 0.07::DOUBLE THEN 0 ELSE target END) AS BIGINT) AS positives, count(*) AS row_count FROM risk",
)
def _(spark, sf):
    df = injected(
        spark, sf, "rule_decay", "ord_disc", 1.0, rule=(Condition("ord_disc", ">", 0.07),), rule_id="disc"
    )
    return df.agg(F.sum("target").alias("positives"), F.count("*").alias("row_count"))


TRUTH = [
    ("s1", "missingness", "ord_qty", "feature", "ord_qty"),
    ("s1", "label", "risk", "target", "target"),
    ("s1", "rule_decay", "rule-9", "rule", "rule-9"),
]


@query(
    "l8_alert_scores",
    f"""WITH {REF_CUR_SQL}, {ALERTS_SQL}, c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER ((alert_type = 'missingness' AND scope_value = 'ord_qty') OR (alert_type = 'label' AND scope_value = 'risk'))::DOUBLE AS m FROM alerts)
    SELECT 's1' AS scenario_id, {r6('m / n')} AS precision, {r6('2::DOUBLE / 3')} AS recall, NULL::DOUBLE AS false_positive_rate,
    {r6('(n - m) / n')} AS false_discovery_rate, {r6('2::DOUBLE / 3')} AS top_k_root_cause_hit FROM c""",
)
def _(spark, sf):
    snap, now, known, alerts = detected(spark, sf)
    tagged = alerts.withColumn("scenario_id", F.lit("s1"))
    causes = monitoring.root_causes(alerts, snap, now, top_k=6, known=known).withColumn("scenario_id", F.lit("s1"))
    truth = injection.truth_frame(spark, TRUTH)
    return rounded(injection.alert_scores(tagged, truth, causes, top_k=6))


# What the drifts of the six scenarios do to counts is fixed, whichever rows are chosen: all rows get a
# larger value or another target, 60 % lose theirs, one segment gains 60 % of the table.
L9_SQL = f"""{REF_CUR_SQL}, seg AS (SELECT segment, count(*) AS ref FROM reference GROUP BY 1 HAVING count(*) >= 100),
 tot AS (SELECT count(*) AS n, sum(target)::DOUBLE / count(*) AS rate, count(*) FILTER (ord_qty IS NULL OR NOT isfinite(ord_qty))::DOUBLE / count(*) AS gone,
   CAST(round_even(count(*) * 0.6, 0) AS BIGINT) AS taken, stddev_samp(ord_qty) AS sd FROM reference),
 drawn AS (SELECT segment, ref, ref + CASE WHEN segment = 'BUILDING' THEN taken ELSE 0 END AS now, n, n + taken AS now_n FROM seg, tot),
 {quantile_sql('reference', ['ord_qty'], (0.25, 0.5, 0.75, 0.0, 1.0))},
 qbin AS (SELECT count(*) FILTER (x < q0) AS a0, count(*) FILTER (x >= q0 AND x < q1) AS a1, count(*) FILTER (x >= q1 AND x < q2) AS a2, count(*) FILTER (x >= q2) AS a3,
   count(*) FILTER (x + 5 * sd < q0) AS b0, count(*) FILTER (x + 5 * sd >= q0 AND x + 5 * sd < q1) AS b1, count(*) FILTER (x + 5 * sd >= q1 AND x + 5 * sd < q2) AS b2,
   count(*) FILTER (x + 5 * sd >= q2) AS b3, count(*)::DOUBLE AS m FROM lng, qs, tot),
 psi AS (SELECT {' + '.join(f"(greatest(b{i} / m, 1e-6) - greatest(a{i} / m, 1e-6)) * ln(greatest(b{i} / m, 1e-6) / greatest(a{i} / m, 1e-6))" for i in range(4))} AS v FROM qbin),
 center AS (SELECT list_avg(list_distinct([q0, q1, q2, q3, q4])) AS c FROM qs),
 pulls AS (SELECT abs(avg(ord_qty) + 5 * any_value(sd) - any_value(c)) * count(*) / any_value(n) AS pull FROM reference, tot, center GROUP BY segment HAVING count(*) >= 100),
 -- The feature is explained by its index, segments and family by shifts of the mean: it may stay behind three of them.
 numeric_hit AS (SELECT CAST((SELECT count(*) FROM pulls, psi WHERE pull > v) + (SELECT CAST(sum(pull) > any_value(v) AS INT) FROM pulls, psi) < 3 AS INT) AS hit),
 ru AS (SELECT 'rule-' || CAST(line_no % 4 AS VARCHAR) AS rule_id, 10 * avg(target) AS lift FROM reference GROUP BY 1),
 raised AS (
  SELECT 'missingness' AS scenario_id, CAST(taken::DOUBLE / n - gone >= 0.10 AS INT) AS alerts, CAST(taken::DOUBLE / n - gone >= 0.10 AS INT) AS matched FROM tot
  UNION ALL SELECT 'numeric', CAST(v >= 0.20 AS INT), CAST(v >= 0.20 AS INT) FROM psi
  UNION ALL SELECT 'population', count(*) FILTER (abs(now::DOUBLE / now_n - ref::DOUBLE / n) >= 0.10),
    count(*) FILTER (segment = 'BUILDING' AND abs(now::DOUBLE / now_n - ref::DOUBLE / n) >= 0.10) FROM drawn
  UNION ALL SELECT 'label', CAST(1 - rate >= 0.03 AS INT), CAST(1 - rate >= 0.03 AS INT) FROM tot
  UNION ALL SELECT 'schema', 1, 1
  UNION ALL SELECT 'rule-decay', CAST(rate >= 0.03 AS INT) + (SELECT count(*) FILTER (rule_id = 'rule-1' AND lift > 0 AND (lift - 1) / lift >= 0.20) FROM ru),
    (SELECT count(*) FILTER (rule_id = 'rule-1' AND lift > 0 AND (lift - 1) / lift >= 0.20) FROM ru) FROM tot)"""


@query(
    "l9_backtest",
    f"""WITH {L9_SQL}
    SELECT scenario_id, {r6('CASE WHEN alerts > 0 THEN matched::DOUBLE / alerts ELSE 0 END')} AS precision, {r6('least(matched, 1)')} AS recall, NULL::DOUBLE AS false_positive_rate,
    {r6('CASE WHEN alerts > 0 THEN (alerts - matched)::DOUBLE / alerts ELSE 0 END')} AS false_discovery_rate, {r6("least(matched, CASE WHEN scenario_id = 'numeric' THEN (SELECT hit FROM numeric_hit) ELSE 1 END)")} AS top_k_root_cause_hit FROM raised""",
)
def _(spark, sf):
    ref = reference(spark, sf, stored(spark, sf))
    rules = alert_rules(ref, 10 * F.avg("target"))
    ref = ref.persist()
    snap = monitoring.build_snapshot(
        ref, ROLES, FEATURE_NAMES, dataset_id="risk", catalog=order_catalog(spark), evidence=small_table(rules)
    )
    scenarios = injection.standard_scenarios("ord_qty", "BUILDING", "rule-1")
    scores = small_table(
        injection.backtest(ref, snap, scenarios, small_table(rules.select("rule_id", "lift")))
    )
    ref.unpersist()
    return rounded(scores)
