"""From alerts to findings, recommendations, retests and remediation states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.tokens import short_hash
from scorewatch.operators.findings import severity_rank

# Finding kind per alert type.
ALERT_KINDS = {
    "schema": "data_quality",
    "missingness": "data_quality",
    "distribution": "feature_drift",
    "population": "population_shift",
    "label": "target_shift",
    "rule_decay": "rule_evidence",
}
# Action and rationale per finding kind.
ACTIONS = {
    "data_quality": ("remediate_data_quality", "data_quality_finding_present"),
    "feature_drift": ("investigate_feature_drift", "feature_drift_finding_present"),
    "population_shift": ("investigate_population_shift", "population_shift_finding_present"),
    "target_shift": ("investigate_target_shift", "target_shift_finding_present"),
    "segment_risk": ("review_segment_risk", "segment_risk_finding_present"),
    "time_instability": ("monitor_time_stability", "time_instability_finding_present"),
    "rule_evidence": ("review_rule_evidence", "rule_evidence_finding_present"),
}
# The direction in which a metric improves.
DIRECTIONS = {
    "affected_count": "decrease",
    "affected_rate": "decrease",
    "delta": "decrease",
    "drop_rate": "decrease",
    "missing_rate": "decrease",
    "psi": "decrease",
    "rate_shift": "decrease",
    "lift": "toward",
}
BRIDGE_LIMITATION = "monitor_alert_bridge"
PRIORITIES = ("critical", "high", "medium", "low")
KEY = ("kind", "code", "feature", "period", "segment_token")


def _lookup(mapping: Mapping[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])[key]


def diagnosis_violations(alerts: DataFrame, causes: DataFrame) -> DataFrame:
    """Alerts that are not unique and causes of unknown alerts; empty when sound."""
    twice = alerts.groupBy("alert_id").agg(F.count("*").alias("n")).filter("n > 1")
    unknown = causes.select("alert_id").distinct().join(alerts, "alert_id", "left_anti")
    return twice.select("alert_id", F.lit("alert is not unique").alias("problem")).unionByName(
        unknown.select("alert_id", F.lit("diagnosis references an unavailable alert").alias("problem"))
    )


def alert_findings(alerts: DataFrame, causes: DataFrame) -> DataFrame:
    """One finding per alert, with its measurements and strongest cause."""
    tops = causes.groupBy("alert_id").agg(
        F.count("*").alias("causes"), F.max("contribution").alias("top")
    )
    digest = short_hash(F.concat(F.lit('{"alert_id":"'), F.col("alert_id"), F.lit('"}')), 16)
    code = F.concat_ws("_", F.lit("monitor"), "alert_type", "scope", digest)
    metrics = {
        "alert_evidence_count": F.size("evidence"),
        "root_cause_count": F.coalesce("causes", F.lit(0)),
        "reference_value": F.col("reference_value"),
        "current_value": F.col("current_value"),
        "delta": F.col("delta"),
        "top_root_cause_contribution": F.col("top"),
    }
    entries = [v for k, c in sorted(metrics.items()) for v in (F.lit(k), c.cast("double"))]
    none = F.lit(None).cast("string")
    return alerts.join(tops, "alert_id", "left").select(
        _lookup(ALERT_KINDS, F.col("alert_type")).alias("kind"),
        F.when(F.col("severity") == "critical", "critical").otherwise("warning").alias("severity"),
        code.alias("code"),
        F.when(F.col("scope") == "feature", F.col("scope_value")).alias("feature"),
        none.alias("period"),
        none.alias("segment_token"),
        F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull()).alias("metrics"),
    )


def recommendations(findings: DataFrame, grade: str = "A") -> DataFrame:
    """One action per finding kind, in priority order; grade B allows analysis only."""
    if grade not in ("A", "B"):
        raise ValueError("metadata grade must be A or B")
    worst = F.min(severity_rank(F.col("severity")))
    grouped = findings.groupBy("kind").agg(
        worst.alias("worst"), F.sort_array(F.collect_set("finding_id")).alias("finding_ids")
    )
    priority = F.when(F.col("worst") == 1, "critical").when(F.col("worst") == 2, "high").otherwise("medium")
    rows = grouped.select(
        _lookup({k: a for k, (a, _) in ACTIONS.items()}, F.col("kind")).alias("action_code"),
        F.lit("analysis_only" if grade == "B" else "human_review_required").alias(
            "decision_eligibility"
        ),
        "finding_ids",
        F.lit(True).alias("human_approval_required"),
        priority.alias("priority"),
        _lookup({k: r for k, (_, r) in ACTIONS.items()}, F.col("kind")).alias("rationale_code"),
    )
    # Fields are in alphabetical order, so the JSON text is canonical.
    identity = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return rows.withColumn("recommendation_id", identity).orderBy(
        order, "action_code", "recommendation_id"
    )


def open_remediations(recommended: DataFrame) -> DataFrame:
    """An open remediation per recommendation; nothing is executed."""
    return _with_state(
        recommended.select(
            "action_code",
            "finding_ids",
            "recommendation_id",
            F.lit("open").alias("status"),
            F.lit(None).cast("string").alias("verification_id"),
        )
    )


def _with_state(rows: DataFrame) -> DataFrame:
    fields = ("action_code", "finding_ids", "recommendation_id", "status", "verification_id")
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return rows.withColumn("remediation_id", F.sha2(text, 256))


def retest(
    remediations: DataFrame,
    before: DataFrame,
    after: DataFrame,
    *,
    directions: Mapping[str, str] | None = None,
    tolerance: float = 0.0,
    reference_severity_rule: bool = False,
) -> DataFrame:
    """Outcome per remediated finding: resolved, remaining or inconclusive.

    Findings are matched on kind, code, feature, period and token.  A finding
    that is gone is resolved.  Otherwise its metrics must all improve in their
    direction; without such a metric the severity must have dropped.  The
    literal rule of the original tool resolves when severity *rose*, which
    looks inverted; ``reference_severity_rule=True`` applies it as it is.
    """
    if not tolerance >= 0 or tolerance == float("inf"):
        raise ValueError("tolerance must be a non-negative finite number")
    ways = {**DIRECTIONS, **(directions or {})}
    if set(ways.values()) - {"decrease", "increase", "toward"}:
        raise ValueError("metric directions are invalid")
    wanted = remediations.select("remediation_id", F.explode("finding_ids").alias("finding_id"))
    selected = wanted.join(before, "finding_id").select(
        "remediation_id",
        "finding_id",
        *[F.coalesce(k, F.lit("")).alias(k) for k in KEY],
        "severity",
        "metrics",
    )
    now = after.select(
        *[F.coalesce(k, F.lit("")).alias(k) for k in KEY],
        F.col("finding_id").alias("after_id"),
        F.col("severity").alias("after_severity"),
        F.col("metrics").alias("after_metrics"),
    )
    pairs = selected.join(now, list(KEY), "left")
    shared = F.map_zip_with("metrics", "after_metrics", lambda k, a, b: b - a)
    deltas = F.map_filter(F.coalesce(shared, F.create_map().cast("map<string,double>")), lambda k, v: v.isNotNull())

    def improved(k: Column) -> Column:
        a, b, way = F.col("metrics")[k], F.col("after_metrics")[k], _lookup(ways, k)
        return (
            F.when(way == "decrease", b < a - tolerance)
            .when(way == "increase", b > a + tolerance)
            .otherwise(F.abs(b - 1.0) < F.abs(a - 1.0) - tolerance)
        )

    known = F.array(*[F.lit(k) for k in ways])
    applicable = F.filter(F.map_keys(F.col("deltas")), lambda k: F.array_contains(known, k))
    rank, after_rank = severity_rank(F.col("severity")), severity_rank(F.col("after_severity"))
    milder = after_rank < rank if reference_severity_rule else after_rank > rank
    gone = F.col("after_id").isNull()
    outcome = (
        F.when(gone, "resolved")
        .when(
            F.size(applicable) > 0,
            F.when(F.forall(applicable, improved), "resolved").otherwise("remaining"),
        )
        .otherwise(F.when(milder, "resolved").otherwise("inconclusive"))
    )
    judged = pairs.withColumn("deltas", deltas).withColumn("outcome", outcome)
    shown = F.when(F.col("outcome") == "resolved", F.col("finding_id")).otherwise(F.col("after_id"))
    return judged.select("remediation_id", "finding_id", "outcome", shown.alias("shown_id"), "deltas")


def verifications(outcomes: DataFrame) -> DataFrame:
    """One verification per remediation: status, the three id sets and metric deltas."""

    def ids(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("outcome") == name, F.col("shown_id"))))

    def some(name: str) -> Column:
        return F.max((F.col("outcome") == name).cast("int")) == 1

    status = F.when(some("remaining"), "remaining").when(some("inconclusive"), "inconclusive")
    changes = F.transform(
        F.map_entries("deltas"),
        lambda e: F.struct(F.concat_ws(":", F.col("finding_id"), e["key"]).alias("key"), e["value"].alias("value")),
    )
    rows = outcomes.withColumn("changes", changes).groupBy("remediation_id").agg(
        status.alias("_s"),
        ids("resolved").alias("resolved_finding_ids"),
        ids("remaining").alias("remaining_finding_ids"),
        ids("inconclusive").alias("inconclusive_finding_ids"),
        F.array_sort(F.flatten(F.collect_list("changes"))).alias("_c"),
    )
    shaped = rows.select(
        "inconclusive_finding_ids",
        F.map_from_entries("_c").alias("metric_deltas"),
        "remaining_finding_ids",
        "remediation_id",
        "resolved_finding_ids",
        F.coalesce("_s", F.lit("verified")).alias("status"),
    )
    return shaped.withColumn("verification_id", F.sha2(F.to_json(F.struct(*shaped.columns)), 256))


def apply_verifications(remediations: DataFrame, verified: DataFrame) -> DataFrame:
    """Next state: verified, failed or awaiting verification; a new record each time."""
    states = {"verified": "verified", "remaining": "failed", "inconclusive": "awaiting_verification"}
    results = verified.select(
        "remediation_id",
        _lookup(states, F.col("status")).alias("new_status"),
        F.col("verification_id").alias("new_verification"),
    )
    return _with_state(
        remediations.join(results, "remediation_id").select(
            "action_code",
            "finding_ids",
            "recommendation_id",
            F.col("new_status").alias("status"),
            F.col("new_verification").alias("verification_id"),
        )
    )
