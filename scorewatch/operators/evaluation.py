"""Evaluation tables: set scores, confusion counts, ranked hits, gates and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.expr import explode_structs, ratio
from scorewatch.roles import ContractError

GATES = (
    "task_succeeded",
    "tool_sequence_matched",
    "evidence_complete",
    "policy_compliant",
    "privacy_compliant",
    "replay_deterministic",
)
REGRESSION = -1e-12


def _rates(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 from true/false positives and false negatives."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(F.lit(0.0))
    return df.withColumns({"precision": p, "recall": r, "f1": f1})


def _marked(df: DataFrame, name: str, id_column: str = "id") -> DataFrame:
    return df.select("case_id", F.col(id_column).alias("id")).distinct().withColumn(name, F.lit(True))


def set_scores(cases: DataFrame, expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Compare expected and observed id sets of every case; empty sets score 0."""
    both = _marked(expected, "e").join(_marked(observed, "o"), ["case_id", "id"], "full_outer")
    e, o = F.col("e").isNotNull(), F.col("o").isNotNull()
    counts = both.groupBy("case_id").agg(
        F.count_if(e & o).alias("true_positives"),
        F.count_if(~e & o).alias("false_positives"),
        F.count_if(e & ~o).alias("false_negatives"),
    )
    every = cases.select("case_id").join(counts, "case_id", "left").fillna(0)
    scored = _rates(every)
    return scored.withColumn(
        "exact", (F.col("false_positives") == 0) & (F.col("false_negatives") == 0)
    )


def outside_universe(universe: DataFrame, detected: DataFrame) -> DataFrame:
    """Detections that are not in their case's universe; must be empty."""
    return detected.join(universe, ["case_id", "id"], "left_anti")


def drift_confusion(universe: DataFrame, truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Confusion counts per case over an explicit universe of ids."""
    rows = (
        universe.select("case_id", "id")
        .distinct()
        .join(_marked(truth, "t"), ["case_id", "id"], "left")
        .join(_marked(detected, "d"), ["case_id", "id"], "left")
    )
    t, d = F.col("t").isNotNull(), F.col("d").isNotNull()
    counts = rows.groupBy("case_id").agg(
        F.count_if(t & d).alias("true_positives"),
        F.count_if(~t & d).alias("false_positives"),
        F.count_if(t & ~d).alias("false_negatives"),
        F.count_if(~t & ~d).alias("true_negatives"),
    )
    fp, tn = F.col("false_positives"), F.col("true_negatives")
    return _rates(counts).drop("f1").withColumn("false_positive_rate", ratio(fp, fp + tn))


def ranked_hits(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Hit@k and recall@k per case; ``ranked`` has ``case_id, id, rank`` from 1."""
    top = ranked.filter(F.col("rank") <= k).select("case_id", "id").distinct().withColumn("hit", F.lit(True))
    wanted = relevant.select("case_id", "id").distinct()
    counts = wanted.join(top, ["case_id", "id"], "left").groupBy("case_id").agg(
        F.count("*").alias("relevant_count"), F.count("hit").alias("retrieved_relevant_count")
    )
    every = ranked.select("case_id").union(relevant.select("case_id")).distinct()
    found = F.col("retrieved_relevant_count")
    return (
        every.join(counts, "case_id", "left")
        .fillna(0)
        .withColumns(
            {
                "k": F.lit(k).cast("long"),
                "hit_at_k": (found > 0).cast("double"),
                "recall_at_k": ratio(found, F.col("relevant_count")),
            }
        )
    )


def micro_set_scores(scores: DataFrame) -> DataFrame:
    """Totals over all cases, with rates from the totals; one row."""
    names = ("true_positives", "false_positives", "false_negatives")
    totals = scores.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.count("*").alias("case_count"),
        F.count_if("exact").alias("exact_count"),
    )
    return _rates(totals).withColumn("exact_rate", ratio(F.col("exact_count"), F.col("case_count")))


def micro_confusion(confusion: DataFrame) -> DataFrame:
    names = ("true_positives", "false_positives", "false_negatives", "true_negatives")
    totals = confusion.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    fp, tn = F.col("false_positives"), F.col("true_negatives")
    return _rates(totals).drop("f1").withColumn("false_positive_rate", ratio(fp, fp + tn))


def micro_hits(hits: DataFrame) -> DataFrame:
    totals = hits.agg(
        F.count("*").alias("case_count"),
        F.count_if(F.col("retrieved_relevant_count") > 0).alias("hit_count"),
        F.coalesce(F.sum("relevant_count"), F.lit(0)).alias("relevant_count"),
        F.coalesce(F.sum("retrieved_relevant_count"), F.lit(0)).alias("retrieved_relevant_count"),
    )
    return totals.withColumns(
        {
            "hit_at_k": ratio(F.col("hit_count"), F.col("case_count")),
            "recall_at_k": ratio(F.col("retrieved_relevant_count"), F.col("relevant_count")),
        }
    )


def case_gates(cases: DataFrame, observations: DataFrame, replays: DataFrame) -> DataFrame:
    """The six gates of every case.

    ``cases``: case_id, expected_tools (array), required_evidence (array),
    require_diagnosis.  Observations and replays: case_id, task_succeeded,
    tools, evidence, diagnosis_evidence (arrays), policy_violations,
    privacy_violations.
    """
    fields = [c for c in observations.columns if c != "case_id"]
    first = observations.select("case_id", F.struct(*fields).alias("first"))
    second = replays.select("case_id", F.struct(*fields).alias("second"))
    rows = cases.join(first, "case_id").join(second, "case_id", "left")
    o = lambda name: F.col(f"first.{name}")
    complete = F.size(F.array_except("required_evidence", o("evidence"))) == 0
    diagnosed = ~F.col("require_diagnosis") | (F.size(o("diagnosis_evidence")) > 0)
    gates = {
        "task_succeeded": o("task_succeeded"),
        "tool_sequence_matched": o("tools") == F.col("expected_tools"),
        "evidence_complete": complete & diagnosed,
        "policy_compliant": o("policy_violations") == 0,
        "privacy_compliant": o("privacy_violations") == 0,
        "replay_deterministic": F.col("first").eqNullSafe(F.col("second")),
    }
    passed = F.lit(True)
    for g in GATES:
        passed = passed & F.col(g)
    return rows.select("case_id", *[c.alias(g) for g, c in gates.items()]).withColumn("passed", passed)


def gate_means(gates: DataFrame) -> DataFrame:
    """Share of passed cases per gate and their mean; one row."""
    means = gates.agg(
        F.count("*").alias("case_count"),
        *[F.avg(F.col(g).cast("double")).alias(g) for g in GATES],
    )
    overall = sum((F.col(g) for g in GATES[1:]), F.col(GATES[0])) / len(GATES)
    return means.withColumn("overall", overall)


def metric_rows(report: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row report as ``metric, value`` rows."""
    return explode_structs(
        report,
        [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names],
    )


def compare_reports(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Change per metric; a drop beyond 1e-12 is a regression."""
    delta = F.col("candidate") - F.col("baseline")
    return (
        baseline.select("metric", F.col("value").alias("baseline"))
        .join(candidate.select("metric", F.col("value").alias("candidate")), "metric")
        .withColumn("delta", delta)
        .withColumn("regressed", F.col("delta") < REGRESSION)
    )


def measurement_rollup(records: DataFrame, *, minimum_tasks: int = 3) -> DataFrame:
    """Efficiency, acceptance, precision, recall and top-3 hit rate from raw counts.

    Every guard is part of the same aggregate; a broken one raises.
    """
    same = ("dataset_id", "config_hash", "data_fingerprint")
    n = F.count("*")
    row = records.agg(
        n.alias("records"),
        F.count_distinct("task_id").alias("task_count"),
        F.count_distinct("run_id").alias("runs"),
        F.count_if(F.col("manual_minutes").isNull()).alias("unmeasured"),
        F.count_if(F.col("baseline_fingerprint").isNull()).alias("unsourced"),
        F.count_if(F.abs(F.col("agent_minutes") - F.col("stage_seconds") / 60) > 1e-9).alias("mistimed"),
        F.count_if(F.col("baseline_task_id") != F.col("task_id")).alias("mismatched"),
        *[F.count_distinct(c).alias(f"d_{c}") for c in same],
        F.sum("manual_minutes").alias("manual"),
        F.sum("agent_minutes").alias("agent"),
        *[
            F.sum(c).alias(c)
            for c in (
                "reviewed_rules",
                "accepted_rules",
                "true_positives",
                "false_positives",
                "false_negatives",
                "top3_hits",
                "root_cause_cases",
            )
        ],
    )

    def stop(condition: Column, message: str) -> Column:
        return F.when(condition, F.raise_error(F.lit(message)).cast("long"))

    checks = [
        (F.col("task_count") < minimum_tasks, f"at least {minimum_tasks} distinct tasks are required"),
        (F.col("task_count") != F.col("records"), "task IDs must be unique"),
        (F.col("runs") != F.col("records"), "run IDs must be unique"),
        (F.col("unmeasured") > 0, "every task requires a measured manual baseline"),
        (F.col("unsourced") > 0, "every record requires baseline provenance"),
        (F.col("mistimed") > 0, "agent minutes must equal the recorded stage timings"),
        (F.col("mismatched") > 0, "baseline task does not match its task"),
        *[(F.col(f"d_{c}") != 1, f"records must share {c}") for c in same],
        (F.col("manual") <= 0, "manual baselines must total more than zero"),
    ]
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b))
    return row.select(
        F.coalesce(*[stop(c, m) for c, m in checks], F.col("task_count")).alias("task_count"),
        ((F.col("manual") - F.col("agent")) / F.col("manual")).alias("efficiency_rate"),
        F.col("reviewed_rules").alias("total_reviewed_rules"),
        F.col("accepted_rules").alias("total_accepted_rules"),
        share(F.col("accepted_rules"), F.col("reviewed_rules")).alias("rule_review_acceptance"),
        share(tp, tp + fp).alias("anomaly_precision"),
        share(tp, tp + fn).alias("anomaly_recall"),
        share(F.col("top3_hits"), F.col("root_cause_cases")).alias("root_cause_top3_hit_rate"),
    )


def require_evaluable(universe: DataFrame, detected: DataFrame) -> None:
    if outside_universe(universe, detected).limit(1).count():
        raise ContractError("detected ids are outside the case universe")
