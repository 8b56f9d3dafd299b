"""Queries for sources, contract, splits, predicates and statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scorewatch.functions.expr import (
    bucket_of,
    condition_column,
    day_of,
    finite,
    month_of,
    rounded,
    rule_column,
)
from scorewatch.functions.ranks import quantiles
from scorewatch.functions.stats import with_adjusted_p
from scorewatch.operators import contract, metrics, split
from scorewatch.plans.registry import query
from scorewatch.plans.views import (
    DIRTY_SQL,
    FEATURE_NAMES,
    FEATURES,
    RISK_SQL,
    ROLES,
    dirty,
    r6,
    risk,
    stored,
    table,
)
from scorewatch.roles import Condition, Features, Rule
from scorewatch.sources.tables import (
    portable_fingerprint,
    read_table,
    rules_from_json,
    rules_to_json,
    table_fingerprint,
)

# Literal rules over the risk view; the first two are the planted ones.
RULES = [
    Rule("disc", (Condition("ord_disc", ">", 0.07),)),
    Rule("qtybal", (Condition("ord_qty", ">", 30), Condition("cust_bal", "<", 2000))),
    Rule("price", (Condition("ord_price", "<=", 30000),)),
    Rule("taxnull", (Condition("ord_tax", "is_null"),)),
    Rule("seg", (Condition("segment", "==", "BUILDING"), Condition("ord_total", ">=", 200000))),
    Rule("notax", (Condition("ord_tax", "!=", 0.04),)),
    Rule("all", ()),
]
RULES_SQL = {
    "disc": "ord_disc > 0.07::DOUBLE",
    "qtybal": "ord_qty > 30 AND cust_bal < 2000",
    "price": "ord_price <= 30000",
    "taxnull": "ord_tax IS NULL",
    "seg": "segment = 'BUILDING' AND ord_total >= 200000",
    "notax": "ord_tax <> 0.04::DOUBLE",
    "all": "TRUE",
}


def counts_sql(source: str, keys: str = "", rules=None) -> str:
    """SQL text: 2x2 counts per rule (and slice keys), one SELECT per rule."""
    keyed = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return " UNION ALL ".join(
        f"SELECT {keyed}'{name}' AS rule_id, count(*) AS n, "
        f"CAST(sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos, "
        f"CAST(sum(CASE WHEN coalesce({hit}, FALSE) THEN 1 ELSE 0 END) AS BIGINT) AS hit, "
        f"CAST(sum(CASE WHEN coalesce({hit}, FALSE) AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hit_pos "
        f"FROM {source}{group}"
        for name, hit in (rules or RULES_SQL).items()
    )


RATIO_SQL = {
    "coverage": "hit::DOUBLE / n",
    "base_bad_rate": "pos::DOUBLE / n",
    "hit_bad_rate": "CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END",
    "non_hit_bad_rate": "CASE WHEN n > hit THEN (pos - hit_pos)::DOUBLE / (n - hit) ELSE 0 END",
    "lift": "(CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END) / (pos::DOUBLE / n)",
    "precision": "CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END",
    "recall": "hit_pos::DOUBLE / pos",
    "hit_good_rate": "CASE WHEN n > pos THEN (hit - hit_pos)::DOUBLE / (n - pos) ELSE 0 END",
    "ks_signed": "CASE WHEN n > pos THEN (CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END)"
    " - (hit - hit_pos)::DOUBLE / (n - pos) END",
    "ks_stat": "abs(CASE WHEN n > pos THEN (CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END)"
    " - (hit - hit_pos)::DOUBLE / (n - pos) END)",
}
METRICS_SQL = "hit AS support_count, " + ", ".join(
    f"{r6(text)} AS {name}" for name, text in RATIO_SQL.items()
)
METRIC_NAMES = ["support_count", *RATIO_SQL]


# --- A. sources and sinks -----------------------------------------------------


@query(
    "a1_projected_scan",
    """SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders""",
)
def _(spark, sf):
    wanted = ["o_orderpriority", "o_totalprice", "o_orderkey"]
    return read_table(spark, f"{sf}/orders.parquet", wanted)


NUMERIC_RULES = [r for r in RULES if r.rule_id in ("disc", "qtybal", "price")]


def observed_rules(spark, sf):
    """Rules cut at the largest observed values, so the rule table depends on the data."""
    top = risk(spark, sf).groupBy("segment").agg(
        F.max("ord_price").alias("price"), F.max("cust_bal").alias("bal")
    )
    condition = "named_struct('feature', '{0}', 'operator', '>', 'value', {1})"
    return top.select(
        F.concat(F.lit("top-"), "segment").alias("rule_id"),
        F.lit("observed").alias("origin"),
        F.array(
            F.expr(condition.format("ord_price", "price")), F.expr(condition.format("cust_bal", "bal"))
        ).alias("conditions"),
    )


@query(
    "a4_rule_sink",
    f"""WITH {RISK_SQL} SELECT 'top-' || segment AS rule_id, 'observed' AS origin,
    '[{{"feature":"ord_price","operator":">","value":' || CAST(max(ord_price) AS VARCHAR) ||
    '}},{{"feature":"cust_bal","operator":">","value":' || CAST(max(cust_bal) AS VARCHAR) || '}}]' AS conditions_json
    FROM risk GROUP BY segment""",
)
def _(spark, sf):
    return rules_to_json(observed_rules(spark, sf))


@query(
    "a5_rule_source",
    f"""WITH {RISK_SQL} SELECT 'top-' || segment AS rule_id, 'observed' AS origin,
    CAST(2 AS BIGINT) AS conditions, 'ord_price' AS feature, '>' AS operator, max(ord_price) AS value
    FROM risk GROUP BY segment""",
)
def _(spark, sf):
    stored = rules_to_json(observed_rules(spark, sf))
    first = F.col("conditions")[0]
    return rules_from_json(stored).select(
        "rule_id",
        "origin",
        F.size("conditions").cast("long").alias("conditions"),
        first["feature"].alias("feature"),
        first["operator"].alias("operator"),
        first["value"].alias("value"),
    )


@query("a7_table_fingerprint")
def _(spark, sf):
    return table_fingerprint(risk(spark, sf))


@query(
    "a7_portable_fingerprint",
    """SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substring(sha256(concat_ws('|', CAST(event_id AS VARCHAR),
    CAST(user_id AS VARCHAR), event_type)), 1, 12) AS BIGINT)) AS VARCHAR) AS digest_sum FROM events""",
)
def _(spark, sf):
    return portable_fingerprint(table(spark, sf, "events").select("event_id", "user_id", "event_type"))


# --- B. contract and profile ---------------------------------------------------


@query(
    "b1_target_contract",
    f"""WITH {DIRTY_SQL} SELECT count(*) FILTER (target IS NULL) AS null_targets,
    count(*) FILTER (target NOT IN (0, 1)) AS non_binary_targets FROM dirty""",
)
def _(spark, sf):
    return contract.target_violations(dirty(spark, sf), "target")


@query(
    "b2_preflight",
    f"""WITH {RISK_SQL} SELECT count(*) AS row_count, {r6("avg(target)")} AS label_rate,
    CAST(min(snapshot_date) AS VARCHAR) AS snapshot_min, CAST(max(snapshot_date) AS VARCHAR) AS snapshot_max,
    count(DISTINCT segment) + max(CASE WHEN segment IS NULL THEN 1 ELSE 0 END) AS segment_count,
    CAST(6 AS BIGINT) AS feature_count, CAST(1 AS BIGINT) AS batch_count, 'B' AS metadata_grade,
    'label performance window unknown; customer feature cutoff is not a strict production OOT claim' AS limitations
    FROM risk""",
)
def _(spark, sf):
    return rounded(contract.preflight(risk(spark, sf), ROLES, FEATURES, "B"))


@query(
    "b3_profile",
    f"""WITH {RISK_SQL} SELECT 'risk' AS dataset_id, count(*) AS row_count, CAST(6 AS BIGINT) AS feature_count,
    {r6("avg(target)")} AS positive_rate, min(snapshot_date) AS snapshot_min, max(snapshot_date) AS snapshot_max,
    'B' AS metadata_grade FROM risk""",
)
def _(spark, sf):
    return rounded(contract.profile(risk(spark, sf), ROLES, FEATURES, dataset_id="risk"))


@query(
    "b4_segment_counts",
    f"""WITH {RISK_SQL} SELECT coalesce(nullif(segment, 'MACHINERY'), 'None') AS segment, count(*) AS row_count
    FROM risk GROUP BY 1""",
)
def _(spark, sf):
    df = risk(spark, sf).withColumn("segment", F.nullif("segment", F.lit("MACHINERY")))
    return contract.segment_counts(df, "segment")


def sliced(spark, sf):
    """Order-level slices that are often one-class: fine segments by day and clerk digit."""
    return risk(spark, sf).withColumn(
        "segment", F.concat_ws("-", "segment", F.date_format("snapshot_date", "yyMM"), F.col("supplier_id") % 7)
    )


SLICED_SQL = (
    RISK_SQL
    + """, sliced AS (SELECT * REPLACE (segment || '-' || strftime(snapshot_date, '%y%m') || '-' ||
    CAST(supplier_id % 7 AS VARCHAR) AS segment) FROM risk)"""
)


@query(
    "b5_single_class_slices",
    f"""WITH {SLICED_SQL} SELECT 'segment' AS family, segment AS slice, count(*) AS affected_rows FROM sliced
    GROUP BY segment HAVING min(target) = max(target)""",
)
def _(spark, sf):
    return contract.single_class_slices(sliced(spark, sf), "segment", "target")


@query(
    "b6_strict_dates",
    """WITH t AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 50 = 1 THEN 'n/a'
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
       SELECT count(*) FILTER (d IS NULL) AS null_dates,
       count(*) FILTER (d IS NOT NULL AND try_cast(d AS DATE) IS NULL) AS invalid_dates,
       min(try_cast(d AS DATE)) AS date_min, max(try_cast(d AS DATE)) AS date_max FROM t""",
)
def _(spark, sf):
    digit = F.col("o_custkey") % 50
    text = F.when(digit == 1, "n/a").when(digit != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return contract.date_violations(table(spark, sf, "orders").select(text.alias("d")), "d")


EVENT_FEATURES = Features({"event": ("evt_",)})


def event_counts(spark, sf):
    """Window counts per user; users with key % 10 = 0 get planted inversions."""
    e = table(spark, sf, "events").withColumn(
        "age", F.datediff(F.lit(date(2024, 1, 31)), F.col("ts").cast("date"))
    )
    click, view = F.col("event_type") == "click", F.col("event_type") == "view"
    counts = e.groupBy("user_id").agg(
        F.count_if(click & (F.col("age") <= 7)).alias("evt_click_cnt_7d"),
        F.count_if(click & (F.col("age") <= 30)).alias("evt_click_cnt_30d"),
        F.count_if(view & (F.col("age") <= 7)).alias("evt_view_cnt_7d"),
        F.count_if(view & (F.col("age") <= 30)).alias("evt_view_cnt_30d"),
        F.count_if(view).alias("evt_view_cnt_90d"),
        F.avg("value").alias("evt_value_avg_7d"),
    )
    bump = F.when(F.col("user_id") % 10 == 0, 1000).otherwise(0)
    return counts.withColumn("evt_click_cnt_7d", F.col("evt_click_cnt_7d") + bump)


EVENT_COUNTS_SQL = """e AS (SELECT *, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS age FROM events),
 ec AS (SELECT user_id,
   count(*) FILTER (event_type = 'click' AND age <= 7) + (CASE WHEN user_id % 10 = 0 THEN 1000 ELSE 0 END) AS evt_click_cnt_7d,
   count(*) FILTER (event_type = 'click' AND age <= 30) AS evt_click_cnt_30d,
   count(*) FILTER (event_type = 'view' AND age <= 7) AS evt_view_cnt_7d,
   count(*) FILTER (event_type = 'view' AND age <= 30) AS evt_view_cnt_30d,
   count(*) FILTER (event_type = 'view') AS evt_view_cnt_90d FROM e GROUP BY user_id)"""


@query(
    "b7_window_inversions",
    f"""WITH {EVENT_COUNTS_SQL} SELECT 'event' AS family, 'click_cnt' AS aggregation,
    'evt_click_cnt_7d,evt_click_cnt_30d' AS features, count(*) AS affected_rows
    FROM ec WHERE evt_click_cnt_7d > evt_click_cnt_30d HAVING count(*) > 0""",
)
def _(spark, sf):
    df = event_counts(spark, sf)
    names = EVENT_FEATURES.select(df.columns)
    return contract.window_inversions(df, contract.feature_catalog(spark, names, EVENT_FEATURES.families))


@query(
    "b8_safe_profile",
    f"""WITH {SLICED_SQL}, sizes AS (SELECT segment, count(*) AS c, min(target) = max(target) AS one FROM sliced GROUP BY 1),
    months AS (SELECT snapshot_date, min(target) = max(target) AS one FROM sliced GROUP BY 1)
    SELECT 'risk' AS dataset_id, (SELECT count(*) FROM risk) AS row_count, CAST(6 AS BIGINT) AS feature_count,
    (SELECT {r6("avg(target)")} FROM risk) AS positive_rate, (SELECT min(snapshot_date) FROM risk) AS snapshot_min,
    (SELECT max(snapshot_date) FROM risk) AS snapshot_max, 'B' AS metadata_grade,
    (SELECT count(*) FROM sizes) AS segment_count, (SELECT min(c) FROM sizes) AS min_segment_size,
    (SELECT max(c) FROM sizes) AS max_segment_size,
    'LABEL_PERFORMANCE_WINDOW_UNKNOWN,SINGLE_CLASS_SLICE' AS issue_codes,
    1 + (SELECT count(*) FROM sizes WHERE one) + (SELECT count(*) FROM months WHERE one) AS issue_count""",
)
def _(spark, sf):
    df = sliced(spark, sf)
    return rounded(
        contract.safe_profile(
            contract.profile(df, ROLES, FEATURES, dataset_id="risk"),
            contract.segment_counts(df, "segment"),
            contract.profile_issues(df, ROLES, FEATURES),
        )
    )


# --- C. splits -------------------------------------------------------------------

TIME_SPLIT_SQL = (
    RISK_SQL
    + """, dc AS (SELECT snapshot_date AS day, count(*) AS n FROM risk GROUP BY 1),
 dd AS (SELECT day, n, row_number() OVER (ORDER BY day) AS i, sum(n) OVER (ORDER BY day) AS cum,
        sum(n) OVER () AS total, count(*) OVER () AS g FROM dc),
 ta AS (SELECT i, day FROM dd WHERE i <= g - 2 ORDER BY abs(10*cum - 6*total), i LIMIT 1),
 tb AS (SELECT i, day FROM dd WHERE i > (SELECT i FROM ta) AND i <= g - 1 ORDER BY abs(10*cum - 8*total), i LIMIT 1),
 parts AS (SELECT risk.*, CASE WHEN snapshot_date <= (SELECT day FROM ta) THEN 'train'
        WHEN snapshot_date <= (SELECT day FROM tb) THEN 'test' ELSE 'holdout' END AS "partition" FROM risk)"""
)


@query(
    "c1_time_split",
    f"""WITH {TIME_SPLIT_SQL} SELECT "partition", count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positives,
    min(snapshot_date) AS first_day, max(snapshot_date) AS last_day FROM parts GROUP BY 1""",
)
def _(spark, sf):
    return (
        split.time_split(risk(spark, sf), "snapshot_date")
        .groupBy("partition")
        .agg(
            F.count("*").alias("row_count"),
            F.sum("target").alias("positives"),
            F.min("snapshot_date").alias("first_day"),
            F.max("snapshot_date").alias("last_day"),
        )
    )


@query(
    "c1_undated_rows",
    f"""WITH {DIRTY_SQL} SELECT count(*) AS row_count, count(*) FILTER (snapshot_date IS NULL) AS excluded_rows FROM dirty""",
)
def _(spark, sf):
    return split.undated_rows(dirty(spark, sf), "snapshot_date")


# Train rows per class: floor(0.7 n) by largest remainder, then dealt out in turns.
QUOTA_SQL = (
    SLICED_SQL.replace(
        "segment || '-' || strftime(snapshot_date, '%y%m') || '-' ||\n    CAST(supplier_id % 7 AS VARCHAR)",
        "CASE WHEN supplier_id % 11 < 8 THEN segment ELSE segment || '-' || CAST(supplier_id % 11 AS VARCHAR) END",
    )
    + """, cls AS (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total FROM sliced GROUP BY 1),
 ex AS (SELECT target, n, floor(0.7::DOUBLE * total) AS want, n::DOUBLE / total * floor(0.7::DOUBLE * total) AS exact FROM cls),
 cq AS (SELECT target, n, CAST(floor(exact) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, target)
        <= want - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM ex),
 st AS (SELECT segment, target, count(*) AS size FROM sliced GROUP BY 1, 2),
 turns AS (SELECT st.segment, st.target, size, turn, quota,
        row_number() OVER (PARTITION BY st.target ORDER BY turn, '"' || st.segment || '"') AS place
        FROM st JOIN cq USING (target), range(1, (SELECT max(size) FROM st)) AS r(turn) WHERE turn <= size - 1),
 alloc AS (SELECT segment, target, max(size) AS size, count(*) FILTER (place <= quota) AS train FROM turns GROUP BY 1, 2)"""
)


def uneven(spark, sf):
    """The risk view with some small segments split off, for uneven strata."""
    digit = F.col("supplier_id") % 11
    return stored(spark, sf).withColumn(
        "segment",
        F.when(digit < 8, F.col("segment")).otherwise(F.concat_ws("-", "segment", digit)),
    )


def _split_counts(df, *keys):
    return df.groupBy(*keys).agg(
        F.count_if(F.col("partition") == "train").alias("train"),
        F.count_if(F.col("partition") == "test").alias("test"),
    )


@query(
    "c2_stratified_split",
    f"""WITH {QUOTA_SQL} SELECT segment, target, train, size - train AS test FROM alloc""",
)
def _(spark, sf):
    parts, _ = split.stratified_split(uneven(spark, sf), "target", "segment")
    return _split_counts(parts, "segment", "target")


@query(
    "c3_target_split",
    f"""WITH {QUOTA_SQL} SELECT target, quota AS train, n - quota AS test FROM cq""",
)
def _(spark, sf):
    df = stored(spark, sf)
    # The entity is a segment of one row per stratum somewhere, so classes are used.
    parts, _ = split.stratified_split(df, "target", "entity_id")
    return _split_counts(parts, "target")


@query("c4_discovery_sample")
def _(spark, sf):
    return split.discovery_sample(stored(spark, sf), 5_000)


@query(
    "c4_sample_membership",
    f"""WITH {RISK_SQL} SELECT least(5000, count(*)) AS sampled, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS drawn_too_often FROM risk""",
)
def _(spark, sf):
    # Rows are compared by all their columns; none may be drawn more often than it exists.
    rows = stored(spark, sf)
    drawn = split.discovery_sample(rows, 5_000).withColumns({"drawn": F.lit(1), "known": F.lit(0)})
    both = drawn.unionByName(rows.withColumns({"drawn": F.lit(0), "known": F.lit(1)}))
    counts = both.groupBy(*rows.columns).agg(F.sum("drawn").alias("drawn"), F.sum("known").alias("known"))
    return counts.agg(
        F.sum("drawn").alias("sampled"),
        F.count_if(F.col("known") == 0).alias("strangers"),
        F.count_if(F.col("drawn") > F.col("known")).alias("drawn_too_often"),
    )


PERIOD_SQL = (
    RISK_SQL
    + """, pd AS (SELECT DISTINCT snapshot_date AS day FROM risk),
 pr AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS g FROM pd),
 pe AS (SELECT day FROM pr WHERE i = greatest(1, least(g - 1, CAST(ceil(g * 0.6::DOUBLE) AS BIGINT)))),
 periods AS (SELECT risk.*, CASE WHEN snapshot_date <= (SELECT day FROM pe) THEN 'reference' ELSE 'current' END AS period FROM risk)"""
)


@query(
    "c5_period_split",
    f"""WITH {PERIOD_SQL} SELECT period, count(*) AS row_count, min(snapshot_date) AS first_day,
    max(snapshot_date) AS last_day FROM periods GROUP BY 1""",
)
def _(spark, sf):
    return (
        split.period_split(risk(spark, sf), "snapshot_date")
        .groupBy("period")
        .agg(
            F.count("*").alias("row_count"),
            F.min("snapshot_date").alias("first_day"),
            F.max("snapshot_date").alias("last_day"),
        )
    )


@query(
    "c5_order_split",
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM events)
    SELECT CASE WHEN i <= greatest(1, least(n - 1, n * 7 // 10)) THEN 'reference' ELSE 'current' END AS period,
    count(*) AS row_count, max(event_id) AS last_event FROM r GROUP BY 1""",
)
def _(spark, sf):
    return (
        split.period_split(table(spark, sf, "events"), "ts", time_enabled=False, order_by="event_id")
        .groupBy("period")
        .agg(F.count("*").alias("row_count"), F.max("event_id").alias("last_event"))
    )


@query(
    "c5_hot_order_split",
    """WITH r AS (SELECT count(*) AS n FROM lineitem), k AS (SELECT n, greatest(1, least(n - 1, n * 7 // 10)) AS keep FROM r)
    SELECT 'reference' AS period, keep AS row_count FROM k UNION ALL SELECT 'current', n - keep FROM k""",
)
def _(spark, sf):
    # Nearly all rows share the lowest order value.
    rows = table(spark, sf, "lineitem").withColumn(
        "place", F.when(F.col("l_linenumber") <= 6, 0).otherwise(F.col("l_linenumber"))
    )
    found = split.period_split(rows, "l_shipdate", time_enabled=False, order_by="place")
    return found.groupBy("period").agg(F.count("*").alias("row_count"))


@query(
    "c6_segment_subset",
    f"""WITH {RISK_SQL} SELECT target, count(*) AS row_count, {r6("sum(ord_total)")} AS total
    FROM risk WHERE segment = 'AUTOMOBILE' GROUP BY target""",
)
def _(spark, sf):
    part = split.segment_subset(risk(spark, sf), "segment", "AUTOMOBILE")
    return rounded(
        part.groupBy("target").agg(F.count("*").alias("row_count"), F.sum("ord_total").alias("total"))
    )


@query(
    "c7_partition_gates",
    f"""WITH {TIME_SPLIT_SQL}, q AS (SELECT "partition", CASE WHEN "partition" = 'holdout' THEN 0 ELSE target END AS target FROM parts)
    SELECT "partition", count(*) AS row_count, CAST(sum(target) AS BIGINT) AS positives,
    CASE WHEN "partition" = 'holdout' AND sum(target) IN (0, count(*)) THEN 'Holdout partition has a single target class; validation unavailable' END AS limitation,
    "partition" <> 'holdout' AS usable FROM q GROUP BY 1""",
)
def _(spark, sf):
    parts = split.time_split(risk(spark, sf), "snapshot_date")
    silent = F.when(F.col("partition") == "holdout", 0).otherwise(F.col("target"))
    return split.partition_gates(parts.withColumn("target", silent), "target")


# --- D. predicates and scalar expressions ---------------------------------------------


@query("d1_rule_evaluation", f"WITH {RISK_SQL}, c AS ({counts_sql('risk')}) SELECT rule_id, hit FROM c")
def _(spark, sf):
    return metrics.rule_counts(risk(spark, sf), RULES, "target").select("rule_id", "hit")


_OPS = [(">", 25.0), (">=", 25.0), ("<", 25.0), ("<=", 25.0), ("==", 25.0), ("!=", 25.0)]


@query(
    "d2_comparisons",
    f"WITH {DIRTY_SQL} SELECT "
    + ", ".join(
        f"count(*) FILTER (ord_price {o.replace('==', '=').replace('!=', '<>')} 25000 AND NOT isnan(ord_price)) AS c{i}"
        for i, (o, _) in enumerate(_OPS)
    )
    + " FROM dirty",
)
def _(spark, sf):
    df = dirty(spark, sf)
    return df.agg(
        *[
            F.count_if(condition_column(Condition("ord_price", o, 25000.0), df.schema)).alias(f"c{i}")
            for i, (o, _) in enumerate(_OPS)
        ]
    )


@query(
    "d3_is_null",
    f"""WITH {DIRTY_SQL} SELECT count(*) FILTER (cust_bal IS NULL) AS bal, count(*) FILTER (ord_price IS NULL) AS price,
    count(*) FILTER (isnan(ord_price)) AS nan_price FROM dirty""",
)
def _(spark, sf):
    df = dirty(spark, sf)
    return df.agg(
        F.count_if(rule_column(Rule("a", (Condition("cust_bal", "is_null"),)), df.schema)).alias("bal"),
        F.count_if(rule_column(Rule("b", (Condition("ord_price", "is_null"),)), df.schema)).alias("price"),
        F.count_if(F.isnan("ord_price")).alias("nan_price"),
    )


@query(
    "d5_month_bucket",
    f"""WITH {DIRTY_SQL} SELECT strftime(snapshot_date, '%Y-%m') AS month, count(*) AS row_count FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    return dirty(spark, sf).groupBy(month_of("snapshot_date").alias("month")).agg(
        F.count("*").alias("row_count")
    )


@query(
    "d6_lenient_month",
    """WITH t AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 50 = 1 THEN 'n/a'
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
       SELECT strftime(try_cast(d AS DATE), '%Y-%m') AS month, count(*) AS row_count FROM t
       WHERE try_cast(d AS DATE) IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    digit = F.col("o_custkey") % 50
    text = F.when(digit == 1, "n/a").when(digit != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, sf, "orders").select(text.alias("d"))
    month = month_of(day_of("d", df.schema["d"].dataType))
    return (
        df.groupBy(month.alias("month"))
        .agg(F.count("*").alias("row_count"))
        .filter(F.col("month").isNotNull())
    )


@query(
    "d7_row_expressions",
    f"""WITH {RISK_SQL} SELECT segment, {r6("avg(CASE WHEN ord_tax IS NOT NULL THEN greatest(ord_tax - 0.03::DOUBLE, 0) END)")} AS clipped,
    {r6("avg(CASE WHEN ord_qty > 25 THEN 1.0::DOUBLE ELSE 0 END)")} AS flag_rate,
    {r6("sum(ord_price / nullif(ord_qty - 25, 0))")} AS safe_ratio FROM risk GROUP BY segment""",
)
def _(spark, sf):
    tax = F.col("ord_tax")
    return rounded(
        risk(spark, sf)
        .groupBy("segment")
        .agg(
            F.avg(F.when(tax.isNotNull(), F.greatest(tax - 0.03, F.lit(0.0)))).alias("clipped"),
            F.avg((F.col("ord_qty") > 25).cast("double")).alias("flag_rate"),
            F.sum(F.try_divide(F.col("ord_price"), F.col("ord_qty") - 25)).alias("safe_ratio"),
        )
    )


EDGES = [5000.0, 20000.0, 40000.0, 60000.0]


@query(
    "d8_frozen_bins",
    f"""WITH {DIRTY_SQL} SELECT CASE WHEN isfinite(ord_price) THEN CAST((ord_price > 5000)::INT + (ord_price > 20000)::INT
    + (ord_price > 40000)::INT + (ord_price > 60000)::INT AS BIGINT) END AS bin, count(*) AS row_count FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    clean = dirty(spark, sf).select(finite("ord_price").alias("x"))
    bin_ = bucket_of("x", EDGES, closed="right").cast("long")
    return clean.groupBy(bin_.alias("bin")).agg(F.count("*").alias("row_count"))


@query(
    "d9_histogram_bins",
    f"""WITH {RISK_SQL} SELECT CAST((ord_qty >= 10)::INT + (ord_qty >= 25)::INT + (ord_qty >= 40)::INT AS BIGINT) AS bin,
    count(*) AS row_count FROM risk GROUP BY 1""",
)
def _(spark, sf):
    clean = risk(spark, sf).select(finite("ord_qty").alias("x"))
    bin_ = bucket_of("x", [10.0, 25.0, 40.0]).cast("long")
    return clean.groupBy(bin_.alias("bin")).agg(F.count("*").alias("row_count"))


# --- E. statistics ----------------------------------------------------------------------


@query(
    "e1_rule_metrics",
    f"WITH {RISK_SQL}, c AS ({counts_sql('risk')}) SELECT rule_id, {METRICS_SQL} FROM c",
)
def _(spark, sf):
    return rounded(
        metrics.rule_performance(risk(spark, sf), RULES, "target").select("rule_id", *METRIC_NAMES)
    )


SEGMENT_RULES_SQL = (
    f"WITH {RISK_SQL}, c AS ({counts_sql('risk', 'segment')}) "
    f"SELECT segment, rule_id, {METRICS_SQL} FROM c"
)


@query("e1_rule_metrics_by_segment", SEGMENT_RULES_SQL)
def _(spark, sf):
    df = metrics.rule_performance(risk(spark, sf), RULES, "target", ["segment"])
    return rounded(df.select("segment", "rule_id", *METRIC_NAMES))


@query(
    "e4_adjusted_p_values",
    """WITH g AS (SELECT l_suppkey % 60 AS rule_id, {p} AS p FROM lineitem GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY p, rule_id) AS k, count(*) OVER () AS m FROM g)
    SELECT rule_id, {r0} AS p_value,
    {r1} AS adjusted_p_value FROM r""".format(
        p="least(1.0::DOUBLE, (sum(l_linenumber) % 997)::DOUBLE / 5000)",
        r0=r6("p"),
        r1=r6("least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING))"),
    ),
)
def _(spark, sf):
    p = F.least(F.lit(1.0), (F.sum("l_linenumber") % 997).cast("double") / 5000)
    table_ = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 60).alias("rule_id")).agg(
        p.alias("p_value")
    )
    return rounded(with_adjusted_p(table_))


KS_SQL = """s AS (SELECT x, count(*) FILTER (bad) AS b, count(*) FILTER (NOT bad) AS g FROM {src}
   WHERE x IS NOT NULL AND isfinite(x) GROUP BY x),
 t AS (SELECT sum(b) AS nb, sum(g) AS ng FROM s),
 c AS (SELECT x, nb, ng, sum(g) OVER (ORDER BY x)::DOUBLE / ng - sum(b) OVER (ORDER BY x)::DOUBLE / nb AS d FROM s, t),
 best AS (SELECT * FROM c ORDER BY abs(d) DESC, x LIMIT 1),
 ks AS (SELECT abs(d) AS statistic, {sign} * d AS signed_statistic, CAST(nb AS BIGINT) AS bad_count, CAST(ng AS BIGINT) AS good_count,
   (SELECT count(*) FROM {src} WHERE x IS NULL OR NOT isfinite(x)) AS excluded_count,
   sqrt(nb::DOUBLE * ng / (nb + ng)) AS en FROM best),
 kl AS (SELECT *, en * statistic AS lam FROM ks),
-- Up to 10,000 rows a side: the chance of the lattice paths that leave the band, step by step.
band AS (SELECT bad_count AS m, good_count AS n, bad_count // gcd(bad_count, good_count) AS a,
   good_count // gcd(bad_count, good_count) AS b,
   CAST(round(statistic * (bad_count // gcd(bad_count, good_count)) * good_count) AS BIGINT) AS h
   FROM kl WHERE greatest(bad_count, good_count) <= 10000),
walk AS (SELECT CAST(0 AS BIGINT) AS step, [CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END for i in range(0, m + 1)] AS p, 0.0::DOUBLE AS gone FROM band
   UNION ALL
   SELECT step + 1, [CASE WHEN abs(i * b - (step + 1 - i) * a) >= h THEN 0 ELSE q[i + 1] END for i in range(0, m + 1)],
     gone + coalesce(list_sum([q[i + 1] for i in range(0, m + 1) if abs(i * b - (step + 1 - i) * a) >= h]), 0)
   FROM (SELECT step, gone, m, n, a, b, h,
      [(CASE WHEN step >= i AND step - i < n THEN p[i + 1] * (n - step + i) ELSE 0 END
        + CASE WHEN i > 0 THEN p[i] * (m - i + 1) ELSE 0 END) / (m + n - step) for i in range(0, m + 1)] AS q
      FROM walk, band WHERE step < m + n)),
exact AS (SELECT least(1, gone) AS chance FROM walk, band WHERE step = m + n)"""
KS_OUT = f"""SELECT {r6("statistic")} AS statistic, {r6("signed_statistic")} AS signed_statistic, bad_count, good_count,
 excluded_count, NULL::VARCHAR AS limitation, CASE WHEN (SELECT count(*) FROM exact) > 0 THEN (SELECT {r6("chance")} FROM exact) WHEN lam < 0.2::DOUBLE THEN 1.0::DOUBLE ELSE {r6(
    "greatest(0, least(1, 2 * (SELECT sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * lam * lam)) FROM range(1, 101) AS q(j))))"
 )} END AS p_value FROM kl"""


@query(
    "e5_score_separation",
    f"""WITH RECURSIVE {DIRTY_SQL}, src AS (SELECT ord_price AS x, target = 1 AS bad FROM dirty WHERE target IS NOT NULL),
    {KS_SQL.format(src='src', sign='1')} {KS_OUT}""",
)
def _(spark, sf):
    df = dirty(spark, sf).filter(F.col("target").isNotNull())
    return rounded(metrics.score_separation(df, "ord_price", "target"))


@query(
    "e5_score_separation_lower",
    f"""WITH RECURSIVE {RISK_SQL}, src AS (SELECT ord_disc AS x, target = 1 AS bad FROM risk),
    {KS_SQL.format(src='src', sign='-1')} {KS_OUT}""",
)
def _(spark, sf):
    df = risk(spark, sf)
    return rounded(
        metrics.score_separation(df, "ord_disc", "target", direction=metrics.LOWER_IS_BAD)
    )


@query(
    "e6_ks_p_value",
    f"""WITH RECURSIVE {RISK_SQL}, src AS (SELECT ord_total AS x, target = 1 AS bad FROM risk),
    {KS_SQL.format(src='src', sign='1')} SELECT statistic, bad_count, good_count, p_value FROM ({KS_OUT})""",
)
def _(spark, sf):
    found = metrics.score_separation(risk(spark, sf), "ord_total", "target")
    return rounded(found.select("statistic", "bad_count", "good_count", "p_value"))


@query(
    "e6_ks_p_value_small",
    f"""WITH RECURSIVE src AS (SELECT c_acctbal AS x, c_mktsegment = 'BUILDING' AS bad FROM customer),
    {KS_SQL.format(src='src', sign='1')} SELECT statistic, bad_count, good_count, p_value FROM ({KS_OUT})""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").select(
        "c_acctbal", (F.col("c_mktsegment") == "BUILDING").cast("int").alias("building")
    )
    found = metrics.score_separation(rows, "c_acctbal", "building")
    return rounded(found.select("statistic", "bad_count", "good_count", "p_value"))


@query(
    "e7_class_weights",
    f"""WITH {RISK_SQL}, w AS (SELECT count(*)::DOUBLE / (2 * count(*) FILTER (target = 0)) AS w0,
    count(*)::DOUBLE / (2 * count(*) FILTER (target = 1)) AS w1 FROM risk)
    SELECT target, count(*) AS row_count, {r6("sum(CASE WHEN target = 1 THEN w1 ELSE w0 END)")} AS weight
    FROM risk, w GROUP BY target""",
)
def _(spark, sf):
    weighted = metrics.row_weights(risk(spark, sf), "target")
    return rounded(
        weighted.groupBy("target").agg(F.count("*").alias("row_count"), F.sum("weight").alias("weight"))
    )


QUANTILE_PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def quantile_sql(source: str, names, probs) -> str:
    """SQL text: exact interpolated quantiles by rank, one row per feature."""

    def at(p: float) -> str:
        pos = f"((n - 1) * {p!r}::DOUBLE)"
        lo = f"max(CASE WHEN i = CAST(floor{pos} AS BIGINT) THEN x END)"
        hi = f"max(CASE WHEN i = CAST(ceil{pos} AS BIGINT) THEN x END)"
        return f"{lo} + ({hi} - {lo}) * (max{pos} - floor(max{pos}))"

    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, target FROM {source} "
        f"WHERE {c} IS NOT NULL AND isfinite({c})"
        for c in names
    )
    cols = ", ".join(f"{at(p)} AS q{i}" for i, p in enumerate(probs))
    return (
        f"lng AS ({parts}), rk AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, "
        f"count(*) OVER (PARTITION BY feature) AS n FROM lng), "
        f"qs AS (SELECT feature, max(n) AS n_finite, min(x) AS min_value, max(x) AS max_value, {cols} FROM rk GROUP BY feature)"
    )


@query(
    "e8_quantiles",
    f"WITH {DIRTY_SQL}, {quantile_sql('dirty', ['cust_bal', 'ord_price', 'ord_qty', 'ord_flat'], QUANTILE_PROBS)} "
    "SELECT feature, n_finite, min_value, max_value, "
    + ", ".join(f"{r6(f'q{i}')} AS q{i}" for i in range(len(QUANTILE_PROBS)))
    + " FROM qs",
)
def _(spark, sf):
    names = ["cust_bal", "ord_price", "ord_qty", "ord_flat"]
    q = quantiles(dirty(spark, sf), names, QUANTILE_PROBS)
    return rounded(
        q.select(
            "feature", "n_finite", "min_value", "max_value",
            *[F.col("q")[i].alias(f"q{i}") for i in range(len(QUANTILE_PROBS))],
        )
    )


def rates_sql(source: str, names) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS n, count(*) FILTER ({c} IS NOT NULL AND isfinite({c})) AS n_finite, "
        f"count(*) FILTER ({c} IS NOT NULL AND isfinite({c}) AND {c} = 0) AS n_zero, "
        f"{r6(f'stddev_samp({c}) FILTER ({c} IS NOT NULL AND isfinite({c}))')} AS std, "
        f"{r6(f'avg({c}) FILTER ({c} IS NOT NULL AND isfinite({c}))')} AS mean FROM {source}"
        for c in names
    )


@query(
    "e9_column_rates",
    f"WITH {DIRTY_SQL}, t AS ({rates_sql('dirty', ['cust_bal', 'ord_price', 'ord_qty', 'ord_flat'])}) "
    f"SELECT feature, n, n_finite, n_zero, {r6('(n - n_finite)::DOUBLE / n')} AS missing_rate, "
    f"{r6('n_zero::DOUBLE / n_finite')} AS zero_rate FROM t",
)
def _(spark, sf):
    df = metrics.column_rates(dirty(spark, sf), ["cust_bal", "ord_price", "ord_qty", "ord_flat"])
    return rounded(df.drop("std", "mean"))


@query(
    "e10_sample_std",
    f"WITH {RISK_SQL}, t AS ({rates_sql('risk', FEATURE_NAMES)}) SELECT feature, std FROM t",
)
def _(spark, sf):
    return rounded(metrics.column_rates(risk(spark, sf), FEATURE_NAMES).select("feature", "std"))
