"""Rule validation: slices, grades, holdout, local rules and summaries.

One grouped aggregate over partition x segment x month yields the counts of
every rule in every slice; everything after it works on that small table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.functions.expr import day_of, literal_sql, month_of, rule_sql, small_table, union_all
from scorewatch.functions.stats import (
    METRICS,
    fisher_p,
    lift_interval,
    rule_metrics,
    with_adjusted_p,
)
from scorewatch.functions.tokens import stable_token
from scorewatch.operators.discovery import Discovery, discover_groups, group_key
from scorewatch.operators.metrics import expression_counts, rule_counts
from scorewatch.operators.split import HOLDOUT, TEST, TRAIN
from scorewatch.roles import (
    GRADES,
    Condition,
    ContractError,
    DiscoveryConfig,
    Roles,
    Rule,
    ValidationConfig,
)
from scorewatch.sources.scratch import staged
from scorewatch.sources.tables import grade_rank

COUNTS = ("n", "pos", "hit", "hit_pos")
PERFORMANCE_WINDOW_UNKNOWN = "label performance window unknown"
HOLDOUT_MISSING = "Holdout evidence is missing for this rule"
HOLDOUT_EMPTY = "Holdout partition is empty; validation unavailable"
HOLDOUT_ONE_CLASS = "Holdout partition has a single target class; validation unavailable"


def validation_counts(
    df: DataFrame, rules: Sequence[Rule], roles: Roles, *, partition: str = "partition"
) -> DataFrame:
    """Counts per rule, partition, segment and month: the only pass over the rows."""
    month = month_of(day_of(roles.snapshot, df.schema[roles.snapshot].dataType))
    sliced = df.withColumns(
        {
            "_part": F.col(partition),
            "_segment": F.coalesce(F.col(roles.segment).cast("string"), F.lit("None")),
            "_month": month,
        }
    )
    return rule_counts(sliced, rules, roles.target, ["_part", "_segment", "_month"]).select(
        "rule_id",
        F.col("_part").alias("partition"),
        F.col("_segment").alias("segment"),
        F.col("_month").alias("month"),
        *COUNTS,
    )


def dataset_metrics(counts: DataFrame, partition: str) -> DataFrame:
    """Metrics of every rule on one whole partition."""
    rows = counts.filter(F.col("partition") == partition).groupBy("rule_id")
    return rule_metrics(rows.agg(*[F.sum(c).alias(c) for c in COUNTS]))


def slice_metrics(
    counts: DataFrame, partition: str, slice_type: str, min_group_size: int
) -> DataFrame:
    """Metrics per rule and segment or month; ``single_class`` marks slices without both classes.

    Groups below the minimum size are left out first, then one-class groups are
    kept only as limitations.
    """
    key = "segment" if slice_type == "segment" else "month"
    grouped = (
        counts.filter((F.col("partition") == partition) & F.col(key).isNotNull())
        .groupBy("rule_id", F.col(key).alias("slice_value"))
        .agg(*[F.sum(c).alias(c) for c in COUNTS])
        .filter(F.col("n") >= min_group_size)
    )
    return rule_metrics(grouped).select(
        "rule_id",
        F.lit(slice_type).alias("slice_type"),
        "slice_value",
        ((F.col("pos") == 0) | (F.col("pos") == F.col("n"))).alias("single_class"),
        *COUNTS,
        *METRICS,
    )


def segment_consistency(slices: DataFrame) -> DataFrame:
    """Share of usable segments with lift above 1, per rule."""
    return (
        slices.filter((F.col("slice_type") == "segment") & ~F.col("single_class"))
        .groupBy("rule_id")
        .agg(
            F.avg((F.col("lift") > 1).cast("double")).alias("segment_consistency"),
            F.max((F.col("lift") > 1).cast("int")).alias("any_lift"),
            F.count("*").alias("segments"),
        )
    )


def time_decay(slices: DataFrame, train: DataFrame) -> DataFrame:
    """Largest relative loss of lift in any usable month against train, at least 0."""
    months = (
        slices.filter((F.col("slice_type") == "time") & ~F.col("single_class"))
        .groupBy("rule_id")
        .agg(F.min("lift").alias("lowest"), F.count("*").alias("months"))
    )
    lift = F.col("train_lift")
    return (
        train.select("rule_id", F.col("lift").alias("train_lift"))
        .join(months, "rule_id", "left")
        .select(
            "rule_id",
            F.coalesce("months", F.lit(0)).alias("months"),
            F.when(
                (lift > 0) & F.col("lowest").isNotNull(),
                F.greatest(F.lit(0.0), (lift - F.col("lowest")) / lift),
            )
            .otherwise(F.lit(0.0))
            .alias("max_time_decay"),
        )
    )


def slice_limitations(slices: DataFrame, segment_name: str = "institution") -> DataFrame:
    """One limitation text per one-class slice, as a list per rule."""
    name = F.when(F.col("slice_type") == "segment", segment_name).otherwise("time")
    text = F.concat(F.lit("single-class "), name, F.lit(": "), F.col("slice_value"))
    one = slices.filter("single_class")
    return one.groupBy("rule_id").agg(
        F.array_sort(F.collect_list(text)).alias("slice_limitations"),
        F.max((F.col("slice_type") == "segment").cast("int")).alias("one_class_segment"),
        F.max((F.col("slice_type") == "time").cast("int")).alias("one_class_month"),
    )


def grade_column(config: ValidationConfig) -> Column:
    """First match: Suspicious, Unstable, Local, else Stable."""
    suspicious = (
        (F.col("adjusted_p_value") > config.alpha)
        | (F.col("lift_lower") <= 1)
        | F.col("insufficient_samples")
    )
    local = (F.col("segment_consistency") < config.min_segment_consistency) & (F.col("any_lift") == 1)
    return (
        F.when(suspicious, GRADES[3])
        .when(F.col("max_time_decay") > config.max_lift_decay, GRADES[2])
        .when(local, GRADES[1])
        .otherwise(GRADES[0])
    )


def evidence(
    counts: DataFrame,
    *,
    config: ValidationConfig = ValidationConfig(),
    partition: str = TEST,
    grade: str = "B",
    time_enabled: bool = True,
    segment_name: str = "institution",
    by_prefix: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Evidence per rule and its slices, from validation counts.

    Returns ``(cards, slices)``.  The p-values that are adjusted come from
    train, the interval and the slices from ``partition``.  ``by_prefix`` adjusts
    them among rules whose ids agree up to the first ``|``.
    """
    size = config.min_group_size
    family = F.substring_index("rule_id", "|", 1) if by_prefix else F.lit("")
    train = with_adjusted_p(
        dataset_metrics(counts, TRAIN).withColumn("p_value", fisher_p(*COUNTS)).withColumn("_family", family),
        by=["_family"],
    )
    test = dataset_metrics(counts, partition)
    slices = slice_metrics(counts, partition, "segment", size)
    if time_enabled:
        slices = slices.unionByName(slice_metrics(counts, partition, "time", size))
    consistency = segment_consistency(slices)
    limits = slice_limitations(slices, segment_name)
    decay = time_decay(slices, train)
    undated = (
        counts.filter((F.col("partition") == partition) & F.col("month").isNull())
        .groupBy("rule_id")
        .agg(F.sum("n").alias("undated"))
    )
    joined = (
        train.select(
            "rule_id",
            F.col("n").alias("train_n"),
            *[F.col(m).alias(f"train_{m}") for m in METRICS],
            "p_value",
            "adjusted_p_value",
        )
        .join(
            test.select(
                "rule_id",
                F.col("n").alias("test_n"),
                *METRICS,
                lift_interval(*COUNTS, rounds=config.bootstrap_rounds).alias("lift_ci"),
                fisher_p(*COUNTS).alias("test_p_value"),
            ),
            "rule_id",
        )
        .join(consistency, "rule_id", "left")
        .join(decay, "rule_id", "left")
        .join(limits, "rule_id", "left")
        .join(undated, "rule_id", "left")
        .withColumn("lift_lower", F.col("lift_ci.lower"))
        .withColumn("lift_upper", F.col("lift_ci.upper"))
        .fillna(0, ["segments", "any_lift", "months", "undated", "one_class_segment", "one_class_month"])
        .fillna(0.0, ["segment_consistency", "max_time_decay"])
    )
    insufficient = (
        (F.col("train_n") < size)
        | (F.col("test_n") < size)
        | (F.col("segments") == 0)
        | (F.col("one_class_segment") == 1)
    )
    if time_enabled:
        insufficient = insufficient | (F.col("months") == 0) | (F.col("one_class_month") == 1)
    undated_text = F.when(
        F.lit(time_enabled) & (F.col("undated") > 0),
        F.array(F.format_string("missing time values: %d rows excluded", "undated")),
    ).otherwise(F.array().cast("array<string>"))
    fixed = [PERFORMANCE_WINDOW_UNKNOWN] if grade == "B" else []
    limitations = F.concat(
        F.array(*[F.lit(t) for t in fixed]).cast("array<string>"),
        F.coalesce("slice_limitations", F.array().cast("array<string>")),
        undated_text,
    )
    cards = (
        joined.withColumn("insufficient_samples", insufficient)
        .withColumn("grade", grade_column(config))
        .withColumn("limitations", limitations)
        .drop("lift_ci", "slice_limitations", "one_class_segment", "one_class_month", "undated")
    )
    return cards, slices.filter(~F.col("single_class")).drop("single_class")


# --- holdout -------------------------------------------------------------------------


def with_limitation(cards: DataFrame, text: str | Column, *, downgrade: bool) -> DataFrame:
    """Add a limitation to every card, and make it Suspicious when asked to."""
    added = cards.withColumn(
        "limitations", F.array_sort(F.array_union("limitations", F.array(F.lit(text))))
    )
    return added.withColumn("grade", F.lit(GRADES[3])) if downgrade else added


def attach_holdout(
    cards: DataFrame, slices: DataFrame, holdout: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Merge holdout evidence: worst grade, largest decay, smallest consistency.

    Rules without holdout evidence become Suspicious.  The holdout metrics
    become one more slice.
    """
    other = holdout.select(
        "rule_id",
        F.col("grade").alias("_grade"),
        F.col("max_time_decay").alias("_decay"),
        F.col("segment_consistency").alias("_consistency"),
        F.transform("limitations", lambda t: F.concat(F.lit("holdout: "), t)).alias("_limits"),
    )
    found = F.col("_grade").isNotNull()
    worst = F.when(grade_rank(F.col("_grade")) > grade_rank(F.col("grade")), F.col("_grade")).otherwise(
        F.col("grade")
    )
    more = F.when(found, F.col("_limits")).otherwise(F.array(F.lit(HOLDOUT_MISSING)))
    merged = (
        cards.join(other, "rule_id", "left")
        .withColumns(
            {
                "grade": F.when(found, worst).otherwise(F.lit(GRADES[3])),
                "max_time_decay": F.greatest("max_time_decay", "_decay"),
                "segment_consistency": F.least("segment_consistency", "_consistency"),
                "limitations": F.array_sort(F.array_union("limitations", more)),
            }
        )
        .drop("_grade", "_decay", "_consistency", "_limits")
    )
    extra = holdout.select(
        "rule_id", F.lit("dataset").alias("slice_type"), F.lit("Holdout").alias("slice_value"), *METRICS
    )
    columns = ["rule_id", "slice_type", "slice_value", *METRICS]
    return merged, slices.select(*columns).unionByName(extra.select(*columns))


def validate(
    counts: DataFrame,
    *,
    config: ValidationConfig = ValidationConfig(),
    grade: str = "B",
    time_enabled: bool = True,
    holdout_limitation: str | None = None,
    segment_name: str = "institution",
) -> tuple[DataFrame, DataFrame]:
    """Evidence on test, combined with holdout when time validation is on."""
    settings = dict(config=config, grade=grade, time_enabled=time_enabled, segment_name=segment_name)
    cards, slices = evidence(counts, **settings)
    if not time_enabled:
        return cards, slices
    if holdout_limitation is not None:
        return with_limitation(cards, holdout_limitation, downgrade=True), slices
    held, _ = evidence(counts, partition=HOLDOUT, **settings)
    return attach_holdout(cards, slices, held)


# --- local rules ------------------------------------------------------------------------


def local_candidates(
    cards: DataFrame, slices: DataFrame, limit: int | None = None
) -> DataFrame:
    """Segments where a Local rule works, best first; beyond ``limit``, if given, they are blocked."""
    token = stable_token(F.col("segment"), "institution")
    order = W.orderBy(F.desc("global_lift"), F.desc("global_support"), "institution_token")
    best = (
        slices.filter((F.col("slice_type") == "segment") & (F.col("lift") > 1))
        .join(cards.filter(F.col("grade") == "Local").select("rule_id"), "rule_id", "left_semi")
        .groupBy(F.col("slice_value").alias("segment"))
        .agg(F.max(F.struct("lift", "support_count")).alias("s"))
        .select(
            "segment",
            token.alias("institution_token"),
            F.col("s.lift").alias("global_lift"),
            F.col("s.support_count").alias("global_support"),
        )
    )
    return best.withColumn("place", F.row_number().over(order).cast("long")).withColumn(
        "status",
        F.when(F.col("place") > limit, "local institution discovery limit reached"),
    )


def local_gates(
    candidates: DataFrame, parts: DataFrame, roles: Roles, min_group_size: int
) -> DataFrame:
    """Train / test size and class gates of the candidate segments, in one grouped pass."""
    label = F.coalesce(F.col(roles.segment).cast("string"), F.lit("None"))
    target = F.col(roles.target)
    sides = {"train": TRAIN, "test": TEST, "holdout": HOLDOUT}
    counts = (
        parts.filter(F.col(roles.segment).isNotNull())
        .groupBy(label.alias("segment"))
        .agg(
            *[F.count_if(F.col("partition") == v).alias(f"{k}_rows") for k, v in sides.items()],
            *[
                F.count_if((F.col("partition") == v) & (target == c)).alias(f"{k}_{c}")
                for k, v in sides.items()
                for c in (0, 1)
            ],
        )
    )
    n = {k: F.coalesce(f"{k}_rows", F.lit(0)) for k in sides}

    def one_class(side: str) -> Column:
        return (F.col(f"{side}_0") == 0) | (F.col(f"{side}_1") == 0)

    small = (n["train"] < min_group_size) | (n["test"] < min_group_size)
    reason = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(small, "institution Train/Test sample is below the minimum discovery size")
        .when(
            one_class("train") | one_class("test"),
            "institution Train/Test contains a single target class",
        )
    )
    hold = F.when(
        n["holdout"] == 0, "Holdout partition is empty; local validation unavailable"
    ).when(
        one_class("holdout"),
        "Holdout partition has a single target class; local validation unavailable",
    )
    return candidates.join(counts, "segment", "left").select(
        "segment",
        "institution_token",
        "place",
        "global_lift",
        "global_support",
        n["train"].alias("train_rows"),
        n["test"].alias("test_rows"),
        F.when(reason.isNull(), "completed").otherwise("blocked").alias("status"),
        reason.alias("reason"),
        hold.alias("holdout_limitation"),
    )


def local_counts(
    parts: DataFrame, found: DataFrame, roles: Roles, *, partition: str = "partition"
) -> DataFrame:
    """:func:`validation_counts` of rules that each belong to one segment (``g``).

    Rule ``k`` of every segment shares one conditional sum, whose condition depends on the row's
    segment; so the passes follow the longest list of rules, not the number of segments.  Rule ids
    become ``segment number|rule id``.
    """
    lists: dict[str, list[Rule]] = {}
    for r in found.collect():
        conditions = tuple(Condition(c["feature"], c["operator"], c["value"]) for c in r["conditions"])
        lists.setdefault(r["g"], []).append(Rule(r["rule_id"], conditions, r["origin"]))
    month = month_of(day_of(roles.snapshot, parts.schema[roles.snapshot].dataType))
    sliced = parts.withColumns(
        {"_part": F.col(partition), "_segment": group_key(roles.segment), "_month": month}
    ).filter(F.col("_segment").isin(list(lists)))
    texts, names = [], []
    for k in range(max(map(len, lists.values()))):
        cases = " ".join(
            f"WHEN {literal_sql(g)} THEN {rule_sql(rules[k], parts.schema)}" for g, rules in lists.items() if k < len(rules)
        )
        texts.append((str(k), f"CASE _segment {cases} ELSE false END"))
    for number, (g, rules) in enumerate(sorted(lists.items())):
        names += [(g, str(k), f"{number}|{r.rule_id}") for k, r in enumerate(rules)]
    owners = parts.sparkSession.createDataFrame(names, "_segment string, rule_id string, key string")
    counts = expression_counts(sliced, texts, roles.target, ["_part", "_segment", "_month"])
    return counts.join(F.broadcast(owners), ["_segment", "rule_id"]).select(
        F.col("key").alias("rule_id"),
        F.col("_part").alias("partition"),
        F.col("_segment").alias("segment"),
        F.col("_month").alias("month"),
        *COUNTS,
    )


def local_rules(
    parts: DataFrame,
    cards: DataFrame,
    slices: DataFrame,
    features: Sequence[str],
    roles: Roles,
    *,
    discovery: DiscoveryConfig = DiscoveryConfig(),
    config: ValidationConfig = ValidationConfig(),
    grade: str = "B",
    time_enabled: bool = True,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Discovery and validation inside segments that passed the gates, all of them in the same jobs.

    Returns ``(reports, local cards)``; p-values are adjusted within a segment.  ``limit`` bounds the
    number of segments.
    """
    # A row per segment at most; without candidates the gates read no rows.
    candidates = small_table(local_candidates(cards, slices, limit))
    if not candidates.take(1):
        parts = parts.limit(0)
    gates = small_table(local_gates(candidates, parts, roles, config.min_group_size))
    done = [r["segment"] for r in gates.filter(F.col("status") == "completed").collect()]
    none = cards.withColumn("segment", F.lit("")).limit(0)
    if not done:
        return gates.withColumn("rule_count", F.lit(None).cast("long")), none
    mine = parts.filter(F.col(roles.segment).cast("string").isin(done))
    train = mine.filter(F.col("partition") == TRAIN)
    found = small_table(discover_groups(train, roles.segment, features, roles.target, discovery))
    sizes = found.groupBy(F.col("g").alias("segment")).agg(F.count("*").alias("rule_count"))
    reports = gates.join(F.broadcast(sizes), "segment", "left").withColumn(
        "rule_count", F.when(F.col("status") == "completed", F.coalesce("rule_count", F.lit(0).cast("long")))
    )
    if not found.take(1):
        return reports, none
    counts = staged(local_counts(mine, found, roles), "local-counts")
    settings = dict(config=config, grade=grade, time_enabled=time_enabled, by_prefix=True)
    local, own = evidence(counts, **settings)
    owners = small_table(counts.select("rule_id", "segment").distinct())
    local = local.join(F.broadcast(owners), "rule_id")
    if time_enabled:
        limits = gates.select("segment", "holdout_limitation")
        local = local.join(F.broadcast(limits), "segment", "left")
        blocked = with_limitation(
            local.filter(F.col("holdout_limitation").isNotNull()), F.col("holdout_limitation"), downgrade=True
        )
        held, _ = evidence(counts, partition=HOLDOUT, **settings)
        merged, _ = attach_holdout(local.filter(F.col("holdout_limitation").isNull()), own, held)
        local = merged.unionByName(blocked).drop("holdout_limitation")
    local = local.withColumn("rule_id", F.substring_index("rule_id", "|", -1))
    return reports, small_table(local.select(*cards.columns, "segment") if set(cards.columns) <= set(local.columns) else local)


# --- summaries ---------------------------------------------------------------------------


def require_confirmed(rules: Iterable[Rule], confirmed: Iterable[str]) -> None:
    """Rules may only use confirmed features with numeric values."""
    known = set(confirmed)
    for c in (c for r in rules for c in r.conditions):
        if c.feature not in known:
            raise ContractError("rule condition must use a confirmed feature")
        if isinstance(c.value, bool) or not isinstance(c.value, (int, float)):
            raise ContractError("rule condition value must be numeric")


def rule_type(conditions: Column) -> Column:
    n = F.size(conditions)
    return F.when(n == 1, "single").when(n == 2, "two_condition").otherwise("multi_condition")


def candidate_summary(result: Discovery, limit: int = 5) -> DataFrame:
    """Top rules and top two-condition rules by train lift, support and id."""
    if limit < 1:
        raise ValueError("summary limit must be positive")
    rows = result.frame.withColumn("rule_type", rule_type(F.col("conditions")))
    lists = {"top_rules": rows, "top_two_condition_rules": rows.filter("rule_type = 'two_condition'")}
    return _top(lists, limit, ["lift", "support_count"], ["rule_type", "origin"])


def _top(lists, limit: int, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    place = W.orderBy(*[F.desc(o) for o in order], "rule_id")
    return union_all(
        [
            df.select("rule_id", *order, *keep, F.row_number().over(place).cast("long").alias("rank"))
            .filter(F.col("rank") <= limit)
            .withColumn("list", F.lit(name))
            for name, df in lists.items()
        ]
    )


def evidence_summary(cards: DataFrame, rules: DataFrame, limit: int = 5) -> DataFrame:
    """Top rules, top pairs and top Stable rules by test lift, support and id."""
    if limit < 1:
        raise ValueError("summary limit must be positive")
    rows = cards.join(
        rules.select("rule_id", rule_type(F.col("conditions")).alias("rule_type")), "rule_id"
    )
    lists = {
        "top_rules": rows,
        "top_two_condition_rules": rows.filter("rule_type = 'two_condition'"),
        "stable_top_rules": rows.filter("grade = 'Stable'"),
    }
    return _top(lists, limit, ["lift", "support_count"], ["rule_type", "grade"])


def grade_counts(cards: DataFrame) -> DataFrame:
    """Rules per grade, zeros included; one row."""
    return cards.agg(*[F.count_if(F.col("grade") == g).alias(g) for g in GRADES])


def segment_directions(slices: DataFrame) -> DataFrame:
    """Per rule and segment: tokenised label and whether the rule points up."""
    return slices.filter(F.col("slice_type") == "segment").select(
        "rule_id",
        stable_token(F.col("slice_value"), "institution").alias("institution_token"),
        F.when(F.col("lift") > 1, "positive").otherwise("non_positive").alias("direction"),
        "support_count",
        "lift",
    )


def reason_codes(
    cards: DataFrame,
    slices: DataFrame,
    config: ValidationConfig = ValidationConfig(),
    *,
    time_enabled: bool = False,
) -> DataFrame:
    """Reason and limitation codes per rule.

    Sample sufficiency here looks at the rule's test support, unlike the grade.
    """
    has = slices.groupBy("rule_id").agg(
        F.max((F.col("slice_type") == "segment").cast("int")).alias("has_segment"),
        F.max((F.col("slice_type") == "time").cast("int")).alias("has_time"),
        F.max(((F.col("slice_type") == "segment") & (F.col("lift") > 1)).cast("int")).alias("up"),
    )
    rows = cards.join(has, "rule_id", "left").fillna(0, ["has_segment", "has_time", "up"])
    one_class = F.exists("limitations", lambda t: t.startswith("single-class"))
    thin = (
        (F.col("support_count") < config.min_group_size) | (F.col("has_segment") == 0) | one_class
    )
    if time_enabled:
        thin = thin | (F.col("has_time") == 0)
    weak = (F.col("segment_consistency") < config.min_segment_consistency) & (F.col("up") == 1)
    reasons = [
        (F.col("adjusted_p_value") > config.alpha, "adjusted_p_value_above_alpha"),
        (F.col("lift_lower") <= 1, "lift_ci_lower_not_above_one"),
        (thin, "insufficient_samples"),
        (F.col("max_time_decay") > config.max_lift_decay, "time_decay_above_limit"),
        (weak, "low_segment_consistency"),
    ]

    def mentions(*words: str) -> Column:
        return F.exists(
            "limitations",
            lambda t: F.lower(t).rlike("|".join(words)),
        )

    limits = [
        (mentions("label performance window unknown"), "label_performance_window_unknown"),
        (mentions("holdout"), "holdout_evidence_unavailable"),
        (mentions("single-class"), "single_class_slice"),
        (mentions("missing time", "snapshot"), "time_values_unavailable"),
    ]

    def codes(pairs) -> Column:
        return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))

    return rows.select(
        "rule_id",
        "grade",
        codes(reasons).alias("reason_codes"),
        F.array_sort(codes(limits)).alias("limitation_codes"),
    )
