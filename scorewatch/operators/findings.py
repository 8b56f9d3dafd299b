"""Aggregate diagnostics: quality, drift, segment and time findings.

Every diagnostic returns rows ``kind, severity, code, feature, period,
segment_token, metrics``; only aggregates, never rows or segment labels.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import (
    batches,
    day_of,
    explode_structs,
    is_finite,
    kept,
    long_bins,
    month_of,
    ratio,
    union_all,
)
from scorewatch.functions.ranks import quantile_lists, quantiles
from scorewatch.functions.tokens import segment_token
from scorewatch.operators.contract import require_columns
from scorewatch.operators.metrics import column_rates
from scorewatch.operators.split import period_split
from scorewatch.roles import Roles, numeric_columns
from scorewatch.sources.scratch import staged

# Finding kinds and severities.
DATA_QUALITY = "data_quality"
FEATURE_DRIFT = "feature_drift"
POPULATION_SHIFT = "population_shift"
TARGET_SHIFT = "target_shift"
SEGMENT_RISK = "segment_risk"
TIME_INSTABILITY = "time_instability"
RULE_EVIDENCE = "rule_evidence"
SEVERITIES = ("critical", "warning", "info")

FINDING_FIELDS = ("kind", "severity", "code", "feature", "period", "segment_token", "metrics")

# Metrics that are counts; everything else is a rate or a difference.
COUNT_METRICS = frozenset(
    {
        "affected_count",
        "month_count",
        "sample_count",
        "reference_count",
        "current_count",
        "previous_count",
        "alert_evidence_count",
        "root_cause_count",
    }
)
SHIFT_WARNING, SHIFT_CRITICAL = 0.10, 0.25
PSI_EPSILON = 1e-6


def severity_at(value: Column, warning: float, critical: float, low: str | None = None) -> Column:
    return (
        F.when(value >= critical, "critical")
        .when(value >= warning, "warning")
        .otherwise(F.lit(low).cast("string"))
    )


def finding(
    df: DataFrame,
    kind: str,
    severity: Column,
    code: Column | str,
    metrics: Mapping[str, Column],
    *,
    feature: Column | None = None,
    period: Column | None = None,
    token: Column | None = None,
) -> DataFrame:
    """Shape rows into findings."""
    none = F.lit(None).cast("string")
    entries = [v for k, m in sorted(metrics.items()) for v in (F.lit(k), m.cast("double"))]
    return df.select(
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (none if feature is None else feature).alias("feature"),
        (none if period is None else period).alias("period"),
        (none if token is None else token).alias("segment_token"),
        F.create_map(*entries).alias("metrics"),
    )


# --- quality ---------------------------------------------------------------------


def column_quality(
    df: DataFrame,
    columns: Sequence[str],
    features: Sequence[str],
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Null, constant, non-finite and out-of-range counts of all columns, in long form."""
    ranges = dict(ranges or {})
    for lo, hi in ranges.values():
        if any(b is not None and not math.isfinite(b) for b in (lo, hi)):
            raise ValueError("numeric range bounds must be finite")
        if lo is not None and hi is not None and lo > hi:
            raise ValueError("numeric range lower bound exceeds upper bound")
    numeric = set(numeric_columns(df.schema, columns))
    zero = F.lit(0).cast("long")
    frames = []
    for group in batches(columns, 12):
        aggs = []
        for i, c in enumerate(group):
            x = F.col(c)
            aggs.append(F.count_if(x.isNull()).alias(f"null{i}"))
            if c in features:
                aggs.append((F.min(x) == F.max(x)).alias(f"flat{i}"))
                if c in numeric:
                    aggs.append(F.count_if(x.isNotNull() & ~is_finite(c)).alias(f"bad{i}"))
                    lo, hi = ranges.get(c, (None, None))
                    outside = F.lit(False)
                    if lo is not None:
                        outside = outside | (x < lo)
                    if hi is not None:
                        outside = outside | (x > hi)
                    aggs.append(F.count_if(is_finite(c) & outside).alias(f"out{i}"))
        wide = df.agg(F.count("*").alias("total"), *aggs)
        has = set(wide.columns)
        frames.append(
            explode_structs(
                wide,
                [
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"null{i}").alias("missing"),
                        (F.col(f"flat{i}") if f"flat{i}" in has else F.lit(False)).alias("constant"),
                        (F.col(f"bad{i}") if f"bad{i}" in has else zero).alias("non_finite"),
                        (F.col(f"out{i}") if f"out{i}" in has else zero).alias("out_of_range"),
                    )
                    for i, c in enumerate(group)
                ],
                "total",
            )
        )
    return union_all(frames)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of every key (null is a key value); one row."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("affected_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        )
    )


def quality_findings(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str],
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Missing, constant, non-finite, out-of-range and duplicate-key findings."""
    columns = list(dict.fromkeys([roles.entity, roles.snapshot, roles.target, *features]))
    require_columns(df, columns, "quality")
    quality = column_quality(df, columns, features, ranges)
    checks = [
        ("missing_values", F.col("missing")),
        ("non_finite_values", F.col("non_finite")),
        ("numeric_out_of_range", F.col("out_of_range")),
        ("constant_feature", F.when(F.col("constant"), F.col("total")).otherwise(F.lit(0))),
    ]
    affected = explode_structs(
        quality,
        [F.struct(F.lit(code).alias("code"), n.alias("affected_count")) for code, n in checks],
        "feature",
        "total",
    ).unionByName(
        duplicate_keys(df, [roles.entity, roles.snapshot]).select(
            F.lit(None).cast("string").alias("feature"),
            "total",
            F.lit("duplicate_entity_snapshot").alias("code"),
            "affected_count",
        )
    )
    rate = F.col("affected_count") / F.col("total")
    critical = (rate >= 0.25) & (F.col("code") != "constant_feature")
    return finding(
        affected.filter(F.col("affected_count") > 0),
        DATA_QUALITY,
        F.when(critical, "critical").otherwise("warning"),
        F.col("code"),
        {"affected_count": F.col("affected_count"), "affected_rate": rate},
        feature=F.col("feature"),
    )


# --- distribution drift --------------------------------------------------------------


def inner_edges(stats: Mapping, features: Sequence[str]) -> dict[str, list[float]]:
    """Distinct quantile cuts strictly inside the value range."""
    return {
        f: sorted({v for v in stats[f]["q"] if stats[f]["min"] < v < stats[f]["max"]})
        if f in stats
        else []
        for f in features
    }


def period_bins(
    df: DataFrame, edges: Mapping[str, Sequence[float]], period: str = "period"
) -> DataFrame:
    """Finite rows per feature, bin and period on frozen edges, on the full bin grid."""
    counted = (
        long_bins(df, edges, period)
        .groupBy("feature", "bin")
        .agg(
            F.count_if(F.col(period) == "reference").alias("reference_count"),
            F.count_if(F.col(period) == "current").alias("current_count"),
        )
    )
    grid = df.sparkSession.createDataFrame(
        [(f, b, len(cuts) + 1) for f, cuts in edges.items() for b in range(len(cuts) + 1)],
        "feature string, bin int, bins int",
    )
    return grid.join(counted, ["feature", "bin"], "left").fillna(
        0, ["reference_count", "current_count"]
    )


def psi_additive(bins: DataFrame, epsilon: float = PSI_EPSILON) -> DataFrame:
    """Stability index per feature with ``epsilon`` added to every bin; empty side gives 0."""
    by_feature = W.partitionBy("feature")
    r_all = F.sum("reference_count").over(by_feature)
    c_all = F.sum("current_count").over(by_feature)
    r = (F.col("reference_count") + epsilon) / (F.col("r_all") + epsilon * F.col("bins"))
    c = (F.col("current_count") + epsilon) / (F.col("c_all") + epsilon * F.col("bins"))
    return (
        bins.withColumns({"r_all": r_all, "c_all": c_all})
        .groupBy("feature")
        .agg(
            F.max("r_all").alias("reference_count"),
            F.max("c_all").alias("current_count"),
            F.sum((c - r) * F.log(c / r)).alias("psi"),
        )
        .withColumn(
            "psi",
            F.when(
                (F.col("reference_count") > 0) & (F.col("current_count") > 0), F.col("psi")
            ).otherwise(F.lit(0.0)),
        )
    )


def label_periods(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Two tables as one, with a ``period`` column."""
    shared = [c for c in reference.columns if c in current.columns]
    return reference.select(*shared, F.lit("reference").alias("period")).unionByName(
        current.select(*shared, F.lit("current").alias("period"))
    )


def feature_psi(
    df: DataFrame, features: Sequence[str], *, bin_count: int = 10, epsilon: float = PSI_EPSILON
) -> DataFrame:
    """PSI of every numeric feature between the two periods, on reference deciles."""
    if bin_count < 1:
        raise ValueError("bin_count must be positive")
    names = sorted(set(numeric_columns(df.schema, features)))
    probs = [i / bin_count for i in range(1, bin_count)] or [0.5]
    with kept(df.filter(F.col("period") == "reference"), *names) as rows:
        stats = quantile_lists(quantiles(rows, names, probs))
    edges = inner_edges(stats, names) if bin_count > 1 else {f: [] for f in names}
    return psi_additive(period_bins(df, edges), epsilon)


def drift_findings(
    df: DataFrame,
    features: Sequence[str],
    target: str | None = None,
    *,
    bin_count: int = 10,
    epsilon: float = PSI_EPSILON,
) -> DataFrame:
    """Missing-rate, distribution and target-rate shifts between the two periods."""
    names = sorted(set(features))
    rates = _missing_by_period(df, names)
    shift = F.abs(F.col("current_rate") - F.col("reference_rate"))
    found = [
        finding(
            rates.withColumn("shift", shift).filter(F.col("shift") >= SHIFT_WARNING),
            POPULATION_SHIFT,
            severity_at(F.col("shift"), SHIFT_WARNING, SHIFT_CRITICAL),
            "missing_rate_shift",
            {
                "reference_rate": F.col("reference_rate"),
                "current_rate": F.col("current_rate"),
                "rate_shift": F.col("shift"),
            },
            feature=F.col("feature"),
        )
    ]
    if numeric_columns(df.schema, names):
        psi = feature_psi(df, names, bin_count=bin_count, epsilon=epsilon)
        found.append(
            finding(
                psi.filter(F.col("psi") >= SHIFT_WARNING),
                FEATURE_DRIFT,
                severity_at(F.col("psi"), SHIFT_WARNING, SHIFT_CRITICAL),
                "feature_psi",
                {k: F.col(k) for k in ("psi", "reference_count", "current_count")},
                feature=F.col("feature"),
            )
        )
    if target is not None:
        t = target_rates(df, target)
        t = t.withColumn("shift", F.abs(F.col("current_rate") - F.col("reference_rate")))
        found.append(
            finding(
                t.filter(F.col("shift") >= SHIFT_WARNING),
                TARGET_SHIFT,
                severity_at(F.col("shift"), SHIFT_WARNING, SHIFT_CRITICAL),
                "target_rate_shift",
                {
                    "reference_rate": F.col("reference_rate"),
                    "current_rate": F.col("current_rate"),
                    "rate_shift": F.col("shift"),
                },
            )
        )
    return union_all(found)


def target_rates(df: DataFrame, target: str) -> DataFrame:
    """Positive rate over non-null targets in both periods; one row."""
    hit = F.when(F.col(target).isNotNull(), (F.col(target) == 1).cast("double"))
    return df.agg(
        *[F.avg(F.when(F.col("period") == p, hit)).alias(f"{p}_rate") for p in ("reference", "current")]
    )


def _missing_by_period(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing rates in both periods; text columns count nulls only."""
    numeric = numeric_columns(df.schema, features)
    other = [f for f in features if f not in numeric]
    frames = []
    if numeric:
        frames.append(column_rates(df, numeric, "period").select("period", "feature", "missing_rate"))
    if other:
        wide = df.groupBy("period").agg(
            F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in other]
        )
        frames.append(
            explode_structs(
                wide,
                [
                    F.struct(F.lit(c).alias("feature"), ratio(F.col(c), F.col("n")).alias("missing_rate"))
                    for c in other
                ],
                "period",
            )
        )
    both = [
        F.coalesce(F.max(F.when(F.col("period") == p, F.col("missing_rate"))), F.lit(0.0)).alias(
            f"{p}_rate"
        )
        for p in ("reference", "current")
    ]
    return union_all(frames).groupBy("feature").agg(*both)


# --- segments and time ----------------------------------------------------------------


def segment_findings(
    df: DataFrame,
    segment: str,
    target: str,
    *,
    min_group_size: int,
    namespace: str = "",
) -> DataFrame:
    """Target rate, lift and share of every segment that is large enough, tokenised."""
    if min_group_size < 1:
        raise ValueError("min_group_size must be positive")
    counted = staged(
        df.groupBy(segment).agg(F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("pos")),
        "segments",
    )
    whole = counted.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    groups = (
        counted.withColumns(
            {"total": F.lit(whole["n"]).cast("long"), "bad": F.lit(whole["pos"]).cast("long")}
        )
        .filter(F.col("n") >= min_group_size)
        .withColumn("rate", F.col("pos") / F.col("n"))
        .withColumn("lift", ratio(F.col("rate"), F.col("bad") / F.col("total")))
    )
    return finding(
        groups,
        SEGMENT_RISK,
        severity_at(F.col("lift"), 1.25, 2.0, low="info"),
        "segment_target_rate",
        {
            "sample_count": F.col("n"),
            "target_rate": F.col("rate"),
            "lift": F.col("lift"),
            "population_share": F.col("n") / F.col("total"),
        },
        token=segment_token(F.col(segment), namespace),
    )


def month_counts(df: DataFrame, snapshot: str, target: str) -> DataFrame:
    """Rows and positives per month; rows without a date are the null month."""
    day = day_of(snapshot, df.schema[snapshot].dataType)
    return df.groupBy(month_of(day).alias("period")).agg(
        F.count("*").alias("n"), F.count_if(F.col(target) == 1).alias("pos")
    )


def monthly_rates(df: DataFrame, snapshot: str, target: str) -> DataFrame:
    """Rows and target rate per month (unparsable dates left out), with the previous month."""
    order = W.orderBy("period")
    return (
        month_counts(df, snapshot, target)
        .filter(F.col("period").isNotNull())
        .withColumn("rate", F.col("pos") / F.col("n"))
        .withColumns(
            {"prev_n": F.lag("n").over(order), "prev_rate": F.lag("rate").over(order)}
        )
    )


def time_findings(
    df: DataFrame,
    snapshot: str,
    target: str,
    *,
    min_months: int = 3,
    min_month_size: int = 1,
    rate_limits: tuple[float, float] = (0.10, 0.25),
    drop_limits: tuple[float, float] = (0.25, 0.50),
) -> DataFrame:
    """Month-to-month changes of target rate and volume, and sparse history."""
    if min_months < 1 or min_month_size < 1:
        raise ValueError("time diagnostic minimums must be positive")
    for warning, critical in (rate_limits, drop_limits):
        if not 0 <= warning <= critical:
            raise ValueError("time diagnostic thresholds are invalid")
    months = monthly_rates(df, snapshot, target)
    dated = F.col("period").isNotNull()
    summary = month_counts(df, snapshot, target).agg(
        F.count_if(dated).alias("months"),
        F.count_if(dated & (F.col("n") < min_month_size)).alias("sparse"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )
    enough = F.col("months") >= min_months
    month_count = {"month_count": F.col("months"), "sample_count": F.col("rows")}
    warning = F.lit("warning")
    shift = F.abs(F.col("rate") - F.col("prev_rate"))
    drop = F.when(F.col("n") < F.col("prev_n"), (F.col("prev_n") - F.col("n")) / F.col("prev_n"))
    # The month count is carried by a window over the monthly table itself.
    changes = months.withColumns({"shift": shift, "drop": drop}).withColumn(
        "months", F.count("*").over(W.partitionBy())
    ).filter(enough)
    return union_all(
        [
            finding(
                summary.filter(~enough), TIME_INSTABILITY, warning, "insufficient_time_data", month_count
            ),
            finding(
                summary.filter(enough & (F.col("sparse") > 0)),
                TIME_INSTABILITY,
                warning,
                "insufficient_month_sample",
                {**month_count, "affected_count": F.col("sparse")},
            ),
            finding(
                changes.filter(F.col("shift") >= rate_limits[0]),
                TIME_INSTABILITY,
                severity_at(F.col("shift"), *rate_limits),
                "monthly_target_rate_change",
                {
                    "previous_rate": F.col("prev_rate"),
                    "current_rate": F.col("rate"),
                    "rate_shift": F.col("shift"),
                },
                period=F.col("period"),
            ),
            finding(
                changes.filter(F.col("drop") >= drop_limits[0]),
                TIME_INSTABILITY,
                severity_at(F.col("drop"), *drop_limits),
                "monthly_sample_drop",
                {
                    "previous_count": F.col("prev_n"),
                    "current_count": F.col("n"),
                    "drop_rate": F.col("drop"),
                },
                period=F.col("period"),
            ),
        ]
    )


# --- identity and order ---------------------------------------------------------------


def canonical_finding(row: Mapping, limitations: Sequence[str] = ()) -> str:
    """Canonical JSON of one finding; counts are written as integers."""
    metrics = {
        k: int(v) if k in COUNT_METRICS else float(v) + 0.0 for k, v in dict(row["metrics"]).items()
    }
    token = row["segment_token"]
    payload = {
        "kind": row["kind"],
        "severity": row["severity"],
        "code": row["code"],
        "feature": row["feature"],
        "period": row["period"],
        "segment_token": None
        if token is None
        else {"kind": "segment", "redacted": True, "token": token},
        "metrics": metrics,
        "limitations": sorted(set(limitations)),
    }
    return json.dumps(payload, allow_nan=False, separators=(",", ":"), sort_keys=True)


def identified(findings: DataFrame, limitations: Sequence[str] = ()) -> DataFrame:
    """Add ``finding_id``: SHA-256 of the canonical payload (findings, not data rows)."""

    @F.pandas_udf(T.StringType())
    def finding_id(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [
                hashlib.sha256(canonical_finding(r, limitations).encode()).hexdigest()
                for r in rows.to_dict("records")
            ],
            dtype=object,
        )

    return findings.withColumn("finding_id", finding_id(F.struct(*FINDING_FIELDS)))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def report_order(findings: DataFrame) -> DataFrame:
    """Report order: severity, kind, code, feature, period, token, id; ids are unique."""
    blank = [F.coalesce(c, F.lit("")) for c in ("feature", "period", "segment_token")]
    return findings.dropDuplicates(["finding_id"]).orderBy(
        severity_rank(F.col("severity")), "kind", "code", *blank, "finding_id"
    )


def diagnose(
    df: DataFrame,
    roles: Roles,
    features: Sequence[str],
    *,
    dataset_id: str = "",
    ranges: Mapping | None = None,
    min_group_size: int = 100,
    bin_count: int = 10,
    time_enabled: bool = True,
    order_by: str | None = None,
) -> DataFrame:
    """All diagnostics of one table as one findings table."""
    found = [quality_findings(df, roles, features, ranges)]
    if time_enabled or order_by is not None:
        periods = period_split(df, roles.snapshot, time_enabled=time_enabled, order_by=order_by)
        found.append(drift_findings(periods, features, roles.target, bin_count=bin_count))
    found.append(
        segment_findings(
            df, roles.segment, roles.target, min_group_size=min_group_size, namespace=dataset_id
        )
    )
    if time_enabled:
        found.append(time_findings(df, roles.snapshot, roles.target))
    return identified(union_all(found))


@dataclass(frozen=True)
class DiagnosticReport:
    """The findings about a table, in report order, and what they cannot show."""

    findings: DataFrame
    limitations: tuple[str, ...]


def diagnostic_report(
    df: DataFrame, roles: Roles, features: Sequence[str], *, grade: str = "B", **settings
) -> DiagnosticReport:
    """:func:`diagnose` with the limitations of the report; ``settings`` go to both."""
    asked = {k: v for k, v in settings.items() if k in ("time_enabled", "order_by")}
    limits = report_limitations(df, roles, grade=grade, **asked)
    return DiagnosticReport(report_order(diagnose(df, roles, features, **settings)), tuple(limits))


# What a report says about its own limits.
TIME_DISABLED = "time_monitoring_disabled"
TOO_LITTLE_REFERENCE = "insufficient_drift_reference"
WINDOW_UNKNOWN = "label_performance_window_unknown"


def report_limitations(
    df: DataFrame,
    roles: Roles,
    *,
    time_enabled: bool = True,
    order_by: str | None = None,
    grade: str = "B",
) -> list[str]:
    """What the diagnostics of this table cannot show."""
    out = [] if time_enabled else [TIME_DISABLED]
    sides = set()
    if time_enabled or order_by is not None:
        periods = period_split(df, roles.snapshot, time_enabled=time_enabled, order_by=order_by)
        sides = {r["period"] for r in periods.select("period").distinct().collect()}
    if len(sides) < 2:
        out.append(TOO_LITTLE_REFERENCE)
    if grade == "B":
        out.append(WINDOW_UNKNOWN)
    return out
