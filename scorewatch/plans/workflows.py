"""Whole workflows: analyse a labelled table, monitor it against a reference."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.expr import small_table
from scorewatch.operators import contract, findings, monitoring, remediation, split, validation
from scorewatch.operators.discovery import Discovery, discover
from scorewatch.roles import (
    ContractError,
    DiscoveryConfig,
    Features,
    Roles,
    ValidationConfig,
    metadata_grade,
)
from scorewatch.sources.scratch import staged


@dataclass(frozen=True)
class Analysis:
    profile: DataFrame
    issues: DataFrame
    gates: DataFrame
    discovery: Discovery
    cards: DataFrame
    slices: DataFrame
    limitations: tuple[str, ...]
    excluded_rows: int = 0
    local_reports: DataFrame | None = None
    local_cards: DataFrame | None = None


#: Fixed value: segments with local rules, at most.
LOCAL_SEGMENTS = 5


def analyse(
    df: DataFrame,
    roles: Roles,
    features: Features,
    *,
    dataset_id: str,
    performance_window_days: int | None = None,
    time_enabled: bool = True,
    segment_name: str = "institution",
    discovery: DiscoveryConfig = DiscoveryConfig(),
    config: ValidationConfig = ValidationConfig(),
) -> Analysis:
    """Profile, split, discover, validate and grade; then rules inside segments with Local evidence."""
    grade = metadata_grade(performance_window_days)
    names = features.select(df.columns, roles)
    if not names:
        raise ContractError("no configured feature columns")
    profile = contract.profile(
        df, roles, features, dataset_id=dataset_id, grade=grade, time_enabled=time_enabled
    )
    issues = contract.profile_issues(
        df, roles, features,
        performance_window_days=performance_window_days, time_enabled=time_enabled,
    )
    limitations: list[str] = []
    excluded = 0
    if time_enabled:
        parts = split.time_split(df, roles.snapshot)
        excluded = split.undated_rows(df, roles.snapshot).first()["excluded_rows"]
    else:
        parts, limitations = split.stratified_split(df, roles.target, roles.segment)
    gates = small_table(split.partition_gates(parts, roles.target))
    blocked = {
        r["partition"]: r["limitation"]
        for r in gates.collect()
        if r["limitation"] and (time_enabled or r["partition"] != split.HOLDOUT)
    }
    limitations += list(blocked.values())
    found = discover(
        parts.filter(F.col("partition") == split.TRAIN), names, roles.target, discovery
    )
    rules = () if blocked.keys() & {split.TRAIN, split.TEST} else found.rules
    if rules:
        # Rules x slices rows, read by about ten later steps.
        counts = staged(validation.validation_counts(parts, rules, roles), "counts")
        cards, slices = validation.validate(
            counts,
            config=config,
            grade=grade,
            time_enabled=time_enabled,
            holdout_limitation=blocked.get(split.HOLDOUT),
            segment_name=segment_name,
        )
        cards = small_table(cards)
        reports, local = validation.local_rules(
            parts, cards, slices, names, roles, discovery=discovery, config=config, grade=grade,
            time_enabled=time_enabled, limit=LOCAL_SEGMENTS,
        )
    else:
        reports = local = None
        cards = found.frame.limit(0).withColumn("grade", F.lit(""))
        slices = found.frame.limit(0)
    return Analysis(
        profile, issues, gates, found, cards, slices, tuple(limitations), excluded, reports, local
    )


def monitor(
    snapshot: monitoring.Snapshot,
    current: DataFrame,
    *,
    current_rules: DataFrame | None = None,
    grade: str = "B",
    top_k: int = 3,
) -> Mapping[str, DataFrame]:
    """Alerts, root causes, findings and recommendations for a current table.

    Alerts are a few rows per feature and segment; they are computed once.  The current rows are
    read once for the facts behind alerts and causes.
    """
    known = monitoring.facts(snapshot, current)
    alerts = small_table(monitoring.detect(snapshot, current, current_rules, known))
    causes = small_table(monitoring.root_causes(alerts, snapshot, current, top_k=top_k, known=known))
    found = small_table(
        findings.identified(
            remediation.alert_findings(alerts, causes), [remediation.BRIDGE_LIMITATION]
        )
    )
    return {
        "alerts": monitoring.alert_order(alerts),
        "root_causes": causes,
        "findings": findings.report_order(found),
        "recommendations": remediation.recommendations(found, grade),
    }
