"""Rule metrics, score separation, class weights and feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.expr import (
    batches,
    explode_structs,
    finite,
    is_finite,
    literal_sql,
    rule_sql,
    union_all,
)
from scorewatch.functions.ranks import running_totals
from scorewatch.functions.stats import ks_p_value, rule_metrics
from scorewatch.roles import ContractError, Rule
from scorewatch.sources.scratch import staged

HIGHER_IS_BAD, LOWER_IS_BAD = "higher_is_bad", "lower_is_bad"
NO_SEPARATION = "single_class_or_no_finite_scores"


def rule_counts(
    df: DataFrame, rules: Sequence[Rule], target: str, slices: Sequence[str] = ()
) -> DataFrame:
    """2x2 counts of every rule in every slice: ``n, pos, hit, hit_pos``."""
    texts = [(r.rule_id, rule_sql(r, df.schema)) for r in rules]
    return expression_counts(df, texts, target, slices)


def expression_counts(
    df: DataFrame, texts: Sequence[tuple[str, str]], target: str, slices: Sequence[str] = ()
) -> DataFrame:
    """Counts of conditions given as (id, SQL text that is true or false).

    All conditions of a batch are conditional sums of one aggregate over one scan;
    the target is a grouping key, so each condition needs a single sum.
    """
    frames = []
    for group in batches(texts):
        wide = (
            df.withColumn("_pos", F.coalesce(F.col(target) == 1, F.lit(False)))
            .groupBy(*slices, "_pos")
            .agg(
                F.count("*").alias("_n"),
                *[
                    F.expr(f"sum(CAST({text} AS BIGINT)) AS _h{i}")
                    for i, (_, text) in enumerate(group)
                ],
            )
        )
        frames.append(
            explode_structs(
                wide,
                [
                    F.expr(f"named_struct('rule_id', {literal_sql(name)}, '_h', _h{i})")
                    for i, (name, _) in enumerate(group)
                ],
                *slices,
                "_pos",
                "_n",
            )
        )
    bad = F.col("_pos")
    return (
        union_all(frames)
        .groupBy(*slices, "rule_id")
        .agg(
            F.sum("_n").alias("n"),
            F.sum(F.when(bad, F.col("_n")).otherwise(0)).alias("pos"),
            F.sum("_h").alias("hit"),
            F.sum(F.when(bad, F.col("_h")).otherwise(0)).alias("hit_pos"),
        )
    )


def rule_performance(
    df: DataFrame, rules: Sequence[Rule], target: str, slices: Sequence[str] = ()
) -> DataFrame:
    """Counts and derived metrics of every rule (and slice)."""
    return rule_metrics(rule_counts(df, rules, target, slices))


def score_separation(
    df: DataFrame,
    score: str,
    target: str,
    *,
    direction: str = HIGHER_IS_BAD,
) -> DataFrame:
    """Two-sample KS of a score between bads and goods; one row.

    Rows are first counted per distinct score, then running class totals are
    taken over ranges of scores, so neither a hot score nor many distinct scores
    end up in one task.  The sign is taken at the lowest score that reaches the
    largest distance.
    """
    if direction not in (HIGHER_IS_BAD, LOWER_IS_BAD):
        raise ValueError("direction must be higher_is_bad or lower_is_bad")
    rows = df.select(finite(score).alias("_s"), (F.col(target) == 1).alias("_bad"))
    totals = rows.agg(
        F.count_if(F.col("_s").isNotNull() & F.col("_bad")).alias("bad"),
        F.count_if(F.col("_s").isNotNull() & ~F.col("_bad")).alias("good"),
        F.count_if(F.col("_s").isNull()).alias("excluded"),
    ).first()
    n_bad, n_good = totals["bad"], totals["good"]
    counts = {"bad_count": n_bad, "good_count": n_good, "excluded_count": totals["excluded"]}
    literals = [F.lit(v).cast("long").alias(k) for k, v in counts.items()]
    if not n_bad or not n_good:
        none = [F.lit(None).cast("double").alias(c) for c in ("statistic", "signed_statistic")]
        one_row = df.sparkSession.range(1)
        return one_row.select(
            *none, *literals, F.lit(NO_SEPARATION).alias("limitation"),
            F.lit(None).cast("double").alias("p_value"),
        )
    per_score = (
        rows.filter(F.col("_s").isNotNull())
        .groupBy("_s")
        .agg(F.count_if("_bad").alias("bad"), F.count_if(~F.col("_bad")).alias("good"))
    )
    # The table is small beside the rows, but sampling its ranges would compute it twice.
    cumulative = running_totals(staged(per_score, "scores"), order=["_s"], sums=["bad", "good"])
    gap = F.col("cum_good") / F.lit(n_good) - F.col("cum_bad") / F.lit(n_bad)
    best = cumulative.select(
        F.struct(F.abs(gap).alias("d"), (-F.col("_s")).alias("s"), gap.alias("g")).alias("x")
    ).agg(F.max("x").alias("x"))
    sign = 1.0 if direction == HIGHER_IS_BAD else -1.0
    return best.select(
        F.col("x.d").alias("statistic"),
        (F.col("x.g") * sign).alias("signed_statistic"),
        *literals,
        F.lit(None).cast("string").alias("limitation"),
        ks_p_value(F.col("x.d"), F.lit(n_bad), F.lit(n_good)).alias("p_value"),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (2 * n_class) per class; one row."""
    n = F.count("*").cast("double")
    bad = F.count_if(F.col(target) == 1)
    good = F.count_if(F.col(target) == 0)
    valid = F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)) == 0
    return df.agg(
        F.when(valid & (good > 0) & (bad > 0), n / (2 * good)).alias("weight_0"),
        F.when(valid & (good > 0) & (bad > 0), n / (2 * bad)).alias("weight_1"),
    )


def row_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class; both classes must be present."""
    w = class_weights(df, target).first()
    if w["weight_0"] is None:
        raise ContractError("target must be 0/1 without nulls and contain both classes")
    return df.withColumn(
        name, F.when(F.col(target) == 1, w["weight_1"]).otherwise(w["weight_0"])
    )


def column_rates(df: DataFrame, columns: Sequence[str], *by: str) -> DataFrame:
    """Row, missing, zero and finite counts of many columns, in long form.

    Missing means null, NaN or infinite.  One aggregate per batch of columns.
    """
    frames = []
    for group in batches(columns, 16):
        aggs = []
        for i, c in enumerate(group):
            x = F.col(c).cast("double")
            aggs += [
                F.count_if(is_finite(c)).alias(f"f{i}"),
                F.count_if(is_finite(c) & (x == 0)).alias(f"z{i}"),
                F.stddev_samp(finite(c)).alias(f"s{i}"),
                F.avg(finite(c)).alias(f"m{i}"),
            ]
        wide = df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
        frames.append(
            explode_structs(
                wide,
                [
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(f"f{i}").alias("n_finite"),
                        F.col(f"z{i}").alias("n_zero"),
                        F.col(f"m{i}").alias("mean"),
                        F.col(f"s{i}").alias("std"),
                    )
                    for i, c in enumerate(group)
                ],
                *by,
                "n",
            )
        )
    n, ok = F.col("n"), F.col("n_finite")
    return union_all(frames).withColumns(
        {
            "missing_rate": _share(n - ok, n),
            "zero_rate": _share(F.col("n_zero"), ok),
        }
    )


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
