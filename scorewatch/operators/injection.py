"""Drift injection into tables and scoring of the alerts it should raise."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import small_table, union_all
from scorewatch.operators.contract import require_columns
from scorewatch.operators.monitoring import (
    Facts,
    Snapshot,
    comparable_features,
    counted_facts,
    label_alerts,
    long_facts,
    population_alerts,
    root_causes,
    rule_decay_alerts,
    schema_alerts,
    value_alerts,
)
from scorewatch.operators.split import repeat_rows, take_exact
from scorewatch.roles import SEED, Condition
from scorewatch.sources.scratch import staged

# Per drift type the alert it must raise and the dimension of its cause.
EXPECTED = {
    "missingness": ("missingness", "feature"),
    "numeric_shift": ("distribution", "feature"),
    "population_shift": ("population", "segment"),
    "label_shift": ("label", "target"),
    "schema": ("schema", "schema"),
    "rule_decay": ("rule_decay", "rule"),
}
ROWS_PER_DRAW, DRAW_GROUPS = 50_000, 1024


@dataclass(frozen=True)
class Scenario:
    scenario_id: str
    drift_type: str
    target: str
    magnitude: float
    segment: str | None = None
    target_column: str = "target"
    segment_column: str = "segment"
    rule_id: str | None = None
    rule: tuple[Condition, ...] = ()
    hit_column: str | None = None

    def __post_init__(self) -> None:
        if self.drift_type not in EXPECTED:
            raise ValueError(f"unknown drift type: {self.drift_type}")
        if self.magnitude < 0:
            raise ValueError("drift magnitude must be non-negative")


def truth_rows(scenarios: Sequence[Scenario]) -> list[tuple[str, str, str, str, str]]:
    """Scenario id, expected alert type and scope value, cause dimension and value."""
    rows = []
    for s in scenarios:
        alert, dimension = EXPECTED[s.drift_type]
        named = s.rule_id or s.target
        scope = named if s.drift_type == "rule_decay" else s.target
        value = {
            "population_shift": s.segment or s.target,
            "label_shift": s.target_column,
            "rule_decay": named,
        }.get(s.drift_type, s.target)
        rows.append((s.scenario_id, alert, scope, dimension, value))
    return rows


def truth_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(
        list(rows), "scenario_id string, alert_type string, scope_value string, dimension string, value string"
    )


# --- choosing rows ------------------------------------------------------------------------


def _candidate(df: DataFrame, s: Scenario) -> Column:
    if s.segment is None or s.segment_column not in df.columns:
        return F.lit(True)
    label = F.coalesce(F.col(s.segment_column).cast("string"), F.lit("None"))
    return label == s.segment


def select_rows(df: DataFrame, s: Scenario, seed: int = SEED) -> DataFrame:
    """Add ``_selected``: exactly max(1, round(n * magnitude)) candidate rows, by row hash."""
    marked = df.withColumn("_candidate", _candidate(df, s))
    n = marked.filter("_candidate").count()
    if not n or not s.magnitude:
        return df.withColumn("_selected", F.lit(False))
    take = min(n, max(1, round(n * s.magnitude)))
    quotas = df.sparkSession.createDataFrame([(True, take), (False, 0)], "_candidate boolean, quota long")
    chosen = take_exact(
        marked, ["_candidate"], quotas, seed=seed, name="_selected", inside="yes", outside="no"
    )
    return chosen.withColumn("_selected", F.col("_selected") == "yes").drop("_candidate")


def oversample(df: DataFrame, s: Scenario, seed: int = SEED) -> DataFrame:
    """Append max(1, round(N * magnitude)) candidate rows drawn with replacement.

    Equal rows are one weighted row.  Draws are dealt out in three steps: to at most
    ``DRAW_GROUPS`` groups of hash buckets on the driver, inside each group to its buckets of about
    50,000 rows, and inside each bucket to its rows.
    """
    counted = df.agg(
        F.count("*").alias("n"), F.count_if(_candidate(df, s)).alias("candidates")
    ).first()
    if not counted["candidates"] or not s.magnitude:
        return df
    draws = max(1, round(counted["n"] * s.magnitude))
    buckets = max(1, -(-counted["candidates"] // ROWS_PER_DRAW))
    columns = df.columns
    weighted = (
        df.filter(_candidate(df, s))
        .groupBy(*columns)
        .agg(F.count("*").alias("_m"))
        .withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets)))
    )
    group = F.pmod(F.col("_b"), F.lit(min(buckets, DRAW_GROUPS))).alias("_g")
    sizes = staged(weighted.groupBy("_b").agg(F.sum("_m").alias("m")).select("_b", "m", group), "draws")
    tops = sizes.groupBy("_g").agg(F.sum("m").alias("m")).orderBy("_g").collect()
    rng = np.random.default_rng(seed)
    weight = np.array([r["m"] for r in tops], dtype=np.float64)
    share = rng.multinomial(draws, weight / weight.sum())
    groups = df.sparkSession.createDataFrame(
        [(int(r["_g"]), int(k)) for r, k in zip(tops, share)], "_g long, _k long"
    )

    def share_out(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("_b")
        m = order["m"].to_numpy(dtype=np.float64)
        local = np.random.default_rng([seed, 1, int(key[0])])
        return order[["_b"]].assign(_k=local.multinomial(int(order["_k"].iloc[0]), m / m.sum()))

    plan = sizes.join(groups, "_g").groupBy("_g").applyInPandas(share_out, "_b long, _k long")

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("_h", kind="stable")
        m = order["_m"].to_numpy(dtype=np.float64)
        local = np.random.default_rng([seed, int(key[0])])
        return order[["_h"]].assign(_copies=local.multinomial(int(order["_k"].iloc[0]), m / m.sum()))

    # Only hashes travel to Python; the rows themselves stay in Spark.
    hashed = weighted.withColumn("_h", F.sha2(F.to_json(F.struct(*columns)), 256))
    copies = (
        hashed.join(plan, "_b")
        .select("_b", "_h", "_m", "_k")
        .groupBy("_b")
        .applyInPandas(deal, "_h string, _copies long")
    )
    extra = repeat_rows(hashed.join(copies, "_h").select(*columns, "_copies"), "_copies")
    return df.unionByName(extra)


# --- injection -------------------------------------------------------------------------------


def inject(df: DataFrame, s: Scenario, seed: int = SEED) -> DataFrame:
    """The table with one planted drift; the input is not changed."""
    if s.drift_type == "rule_decay":
        require_columns(df, [s.target_column], "label")
    else:
        require_columns(df, [s.target], "drift target")
    if s.drift_type == "schema":
        return df.drop(s.target)
    if s.drift_type == "population_shift":
        return oversample(df, s, seed)
    chosen = select_rows(df, s, seed)
    on = F.col("_selected")
    if s.drift_type == "missingness":
        changed = chosen.withColumn(
            s.target, F.when(~on, F.col(s.target)).cast(df.schema[s.target].dataType)
        )
    elif s.drift_type == "numeric_shift":
        dtype = df.schema[s.target].dataType
        if not isinstance(dtype, T.NumericType):
            raise ValueError("numeric_shift requires a numeric target")
        std = df.agg(F.stddev_samp(s.target)).first()[0] or 0.0
        shifted = (F.col(s.target) + F.lit(s.magnitude * std)).cast(dtype)
        changed = chosen.withColumn(s.target, F.when(on, shifted).otherwise(F.col(s.target)))
    else:
        old, new = (0, 1) if s.drift_type == "label_shift" else (1, 0)
        t = F.col(s.target_column)
        hit = on & (t == old)
        if s.drift_type == "rule_decay":
            hit = hit & _decay_hits(s)
        flipped = F.lit(new).cast(df.schema[s.target_column].dataType)
        changed = chosen.withColumn(s.target_column, F.when(hit, flipped).otherwise(t))
    return changed.drop("_selected")


def _decay_hits(s: Scenario) -> Column:
    """Rows of the decaying rule: a given flag column, its conditions, or all positives.

    Conditions compare plainly here: unlike rule evaluation, NaN counts as large.
    """
    if s.hit_column is not None:
        return F.col(s.hit_column)
    if not s.rule:
        return F.lit(True)
    parts = []
    for c in s.rule:
        x = F.col(c.feature)
        parts.append(x.isNull() if c.operator == "is_null" else _plain(x, c))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def _plain(x: Column, c: Condition) -> Column:
    v = F.lit(c.value)
    return {
        "==": x == v, "!=": x != v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v
    }[c.operator]


# --- scoring -----------------------------------------------------------------------------------


def alert_scores(
    alerts: DataFrame, truth: DataFrame, causes: DataFrame, *, top_k: int = 3
) -> DataFrame:
    """Precision, recall, false discovery rate and top-k cause hit per scenario.

    All three tables carry ``scenario_id``.  The false positive rate stays null:
    alerts alone say nothing about true negatives.
    """
    keys = ["scenario_id", "alert_type", "scope_value"]
    expected = truth.select(*keys).distinct().withColumn("_expected", F.lit(True))
    raised = alerts.select(*keys).distinct().withColumn("_raised", F.lit(True))
    by_alert = (
        alerts.join(expected, keys, "left")
        .groupBy("scenario_id")
        .agg(F.count("*").alias("alerts"), F.count("_expected").alias("matched"))
    )
    ranked = (
        causes.filter(F.col("rank") <= top_k)
        .select("scenario_id", "dimension", "value")
        .distinct()
        .withColumn("_cause", F.lit(True))
    )
    by_truth = (
        truth.join(raised, keys, "left")
        .join(ranked, ["scenario_id", "dimension", "value"], "left")
        .groupBy("scenario_id")
        .agg(
            F.count("*").alias("truths"),
            F.count("_raised").alias("found"),
            F.count("_cause").alias("explained"),
        )
    )
    n, m = F.coalesce("alerts", F.lit(0)), F.coalesce("matched", F.lit(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return by_truth.join(by_alert, "scenario_id", "full_outer").select(
        "scenario_id",
        share(m, n).alias("precision"),
        share(F.col("found"), F.coalesce("truths", F.lit(0))).alias("recall"),
        F.lit(None).cast("double").alias("false_positive_rate"),
        share(n - m, n).alias("false_discovery_rate"),
        share(F.col("explained"), F.coalesce("truths", F.lit(0))).alias("top_k_root_cause_hit"),
    )


def mean_scores(scores: DataFrame) -> DataFrame:
    """Unweighted mean over scenarios; one row."""
    names = ("precision", "recall", "false_discovery_rate", "top_k_root_cause_hit")
    return scores.agg(
        F.count("*").alias("scenarios"),
        *[F.avg(n).alias(n) for n in names],
        F.lit(None).cast("double").alias("false_positive_rate"),
    )


def standard_scenarios(feature: str, segment: str, rule_id: str, **columns: str) -> list[Scenario]:
    """The six standard drifts on one feature, segment and rule."""
    target = columns.get("target_column", "target")
    group = columns.get("segment_column", "segment")
    return [
        Scenario("missingness", "missingness", feature, 0.60, **columns),
        Scenario("numeric", "numeric_shift", feature, 5.00, **columns),
        Scenario("population", "population_shift", group, 0.60, segment=segment, **columns),
        Scenario("label", "label_shift", target, 1.00, **columns),
        Scenario("schema", "schema", feature, 0.30, **columns),
        Scenario("rule-decay", "rule_decay", feature, 1.00, rule_id=rule_id, **columns),
    ]


def inject_all(df: DataFrame, scenarios: Sequence[Scenario], seed: int = SEED) -> DataFrame:
    """The tables of all scenarios in one, told apart by ``scenario_id``.

    Rows are written once per scenario and chosen for all scenarios together; a schema drift leaves
    its column in place, as one table has one schema (:func:`dropped` names it).  Drawn copies of a
    population shift are added scenario by scenario.
    """
    for s in scenarios:
        label = s.drift_type == "rule_decay"
        require_columns(df, [s.target_column if label else s.target], "label" if label else "drift target")
    names = [s.scenario_id for s in scenarios]
    if len(set(names)) < len(names):
        raise ValueError("scenario ids must be unique")
    spark = df.sparkSession
    drawn = [s for s in scenarios if s.drift_type == "population_shift"]
    marked = [s for s in scenarios if s.drift_type not in ("population_shift", "schema")]
    tag = F.col("scenario_id")
    each = df.select("*", F.explode(F.array(*[F.lit(s.scenario_id) for s in scenarios if s not in drawn])).alias("scenario_id")) if len(drawn) < len(names) else None
    frames = [oversample(df, s, seed + names.index(s.scenario_id)).withColumn("scenario_id", F.lit(s.scenario_id)) for s in drawn]
    if each is not None:
        open_rows = F.lit(False)
        for s in marked:
            open_rows = F.when(tag == s.scenario_id, _candidate(df, s)).otherwise(open_rows)
        each = each.withColumn("_candidate", F.coalesce(open_rows, F.lit(False)))
        counted = each.groupBy("scenario_id", "_candidate").agg(F.count("*").alias("n")).collect()
        sizes = {(r["scenario_id"], r["_candidate"]): r["n"] for r in counted}
        share = {s.scenario_id: s.magnitude for s in marked}
        quotas = [
            (name, on, min(n, max(1, round(n * share[name]))) if on and share.get(name) else 0)
            for (name, on), n in sizes.items()
        ]
        chosen = take_exact(
            each, ["scenario_id", "_candidate"],
            spark.createDataFrame(quotas, "scenario_id string, _candidate boolean, quota long"),
            seed=seed, name="_selected", inside="yes", outside="no",
        )
        frames.append(_changed(chosen.withColumn("_selected", F.col("_selected") == "yes"), df, marked).drop("_candidate", "_selected"))
    return union_all(frames)


def _changed(chosen: DataFrame, df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """The chosen rows with the drift of their own scenario."""
    shifts = [s.target for s in scenarios if s.drift_type == "numeric_shift"]
    for c in shifts:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise ValueError("numeric_shift requires a numeric target")
    spread = df.agg(*[F.stddev_samp(c).alias(c) for c in dict.fromkeys(shifts)]).first().asDict() if shifts else {}
    values = {c: F.col(c) for c in df.columns}
    for s in scenarios:
        on = (F.col("scenario_id") == s.scenario_id) & F.col("_selected")
        column = s.target_column if s.drift_type in ("label_shift", "rule_decay") else s.target
        dtype = df.schema[column].dataType
        if s.drift_type == "missingness":
            new = F.lit(None).cast(dtype)
        elif s.drift_type == "numeric_shift":
            new = (F.col(column) + F.lit(s.magnitude * (spread[column] or 0.0))).cast(dtype)
        else:
            old, flipped = (0, 1) if s.drift_type == "label_shift" else (1, 0)
            on = on & (F.col(column) == old)
            on = on & _decay_hits(s) if s.drift_type == "rule_decay" else on
            new = F.lit(flipped).cast(dtype)
        values[column] = F.when(on, new).otherwise(values[column])
    return chosen.select(*[v.alias(c) for c, v in values.items()], "scenario_id", "_candidate", "_selected")


def dropped(df: DataFrame, s: Scenario) -> DataFrame:
    """The table as a scenario sees it: without the column that a schema drift takes away."""
    return df.drop(s.target) if s.drift_type == "schema" else df


def backtest(
    df: DataFrame,
    snapshot: Snapshot,
    scenarios: Sequence[Scenario],
    rules: DataFrame,
    *,
    seed: int = SEED,
    top_k: int = 3,
) -> DataFrame:
    """Inject, detect, explain and score every scenario (a handful); one row each.

    All scenarios go through injection, one grouped count, detection and attribution together, with
    ``scenario_id`` as one more key.  ``rules`` are the current rule lifts; for a decaying rule its
    lift is set to 1.
    """
    tags = ("scenario_id",)
    tag = F.col("scenario_id")
    tables = {s.scenario_id: dropped(df, s) for s in scenarios}
    present = tuple(((k,), tuple(comparable_features(snapshot, t))) for k, t in tables.items())
    every = list({f.feature: f for _, found in present for f in found}.values())
    stacked = inject_all(df, scenarios, seed)
    known = Facts(counted_facts(long_facts(snapshot, stacked, every, tags), tags), present, tags)
    frames = [
        schema_alerts(snapshot, t).select(F.lit(k).alias("scenario_id"), "*") for k, t in tables.items()
    ] + value_alerts(snapshot, known)
    roles = snapshot.roles
    for column, found in ((roles.target, label_alerts), (roles.segment, population_alerts)):
        having = [k for k, t in tables.items() if column in t.columns]
        if having:
            frames.append(found(snapshot, known).filter(tag.isin(having)))
    if snapshot.rules is not None:
        now = rules.select(F.explode(F.array(*[F.lit(k) for k in tables])).alias("scenario_id"), "rule_id", "lift")
        for s in scenarios:
            if s.drift_type == "rule_decay":
                gone = (tag == s.scenario_id) & (F.col("rule_id") == s.rule_id)
                now = now.withColumn("lift", F.when(gone, 1.0).otherwise(F.col("lift")))
        frames.append(rule_decay_alerts(snapshot.rules, now, tags))
    alerts = small_table(union_all(frames))
    causes = root_causes(alerts, snapshot, stacked, top_k=top_k, known=known)
    truth = []
    for s, (name, alert, scope, dimension, value) in zip(scenarios, truth_rows(scenarios)):
        fixed = {"population_shift": s.segment, "label_shift": snapshot.dataset_id}.get(s.drift_type)
        truth.append((name, alert, fixed or scope, dimension, value))
    return alert_scores(alerts, truth_frame(df.sparkSession, truth), small_table(causes), top_k=top_k)
