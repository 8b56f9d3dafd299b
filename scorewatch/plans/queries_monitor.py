"""Queries for diagnostics, monitoring alerts and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded, small_table
from scorewatch.operators import contract, findings, monitoring
from scorewatch.plans.queries_core import quantile_sql, uneven
from scorewatch.plans.registry import query
from scorewatch.plans.views import (
    DIRTY_SQL,
    FEATURE_NAMES,
    FEATURES,
    REF_CUR_SQL,
    RISK_SQL,
    ROLES,
    current,
    dirty,
    r6,
    reference,
    risk,
    sql_list,
    stored,
)


DIRTY_FEATURES = ["cust_bal", "ord_flat", "ord_price", "ord_qty"]
RANGES = {"ord_price": (1000.0, 60000.0), "ord_qty": (None, 48.0)}


def flat(df, *names):
    """Findings with the given metrics as columns."""
    return rounded(
        df.select(
            "kind", "severity", "code", "feature", "period", "segment_token",
            *[F.col("metrics")[n].alias(n) for n in names],
        )
    )


def finding_sql(kind, severity, code, metrics_, *, feature="NULL", period="NULL", token="NULL"):
    cols = ", ".join(f"{r6(v)} AS {k}" for k, v in metrics_.items())
    return (
        f"SELECT '{kind}' AS kind, {severity} AS severity, {code} AS code, CAST({feature} AS VARCHAR) AS feature, "
        f"CAST({period} AS VARCHAR) AS period, CAST({token} AS VARCHAR) AS segment_token, {cols}"
    )


LEVEL = "CASE WHEN {v} >= {c}::DOUBLE THEN 'critical' WHEN {v} >= {w}::DOUBLE THEN 'warning' ELSE {low} END"


def level(value, warning, critical, low="NULL"):
    return LEVEL.format(v=value, w=warning, c=critical, low=low)


# --- I. quality ----------------------------------------------------------------------

_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'missing_values' AS code, count(*) FILTER ({c} IS NULL) AS k, count(*) AS n FROM dirty"
    for c in ["entity_id", "snapshot_date", "target", *DIRTY_FEATURES]
)
_FLAT = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'constant_feature' AS code, CASE WHEN count(DISTINCT {c}) = 1 THEN count(*) ELSE 0 END AS k, count(*) AS n FROM dirty"
    for c in DIRTY_FEATURES
)
_NONFINITE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'non_finite_values' AS code, count(*) FILTER ({c} IS NOT NULL AND NOT isfinite({c})) AS k, count(*) AS n FROM dirty"
    for c in DIRTY_FEATURES
)
_RANGE = (
    "SELECT 'ord_price' AS feature, 'numeric_out_of_range' AS code, count(*) FILTER (isfinite(ord_price) AND (ord_price < 1000 OR ord_price > 60000)) AS k, count(*) AS n FROM dirty "
    "UNION ALL SELECT 'ord_qty', 'numeric_out_of_range', count(*) FILTER (ord_qty > 48), count(*) FROM dirty"
)
_DUP = (
    "SELECT NULL AS feature, 'duplicate_entity_snapshot' AS code, CAST(sum(c - 1) AS BIGINT) AS k, CAST(sum(c) AS BIGINT) AS n "
    "FROM (SELECT count(*) AS c FROM dirty GROUP BY entity_id, snapshot_date)"
)
QUALITY_SQL = (
    DIRTY_SQL + f", q AS ({_NULLS} UNION ALL {_FLAT} UNION ALL {_NONFINITE} UNION ALL {_RANGE} UNION ALL {_DUP}), "
    "quality AS ("
    + finding_sql(
        "data_quality",
        "CASE WHEN k::DOUBLE / n >= 0.25 AND code <> 'constant_feature' THEN 'critical' ELSE 'warning' END",
        "code",
        {"affected_count": "k", "affected_rate": "k::DOUBLE / n"},
        feature="feature",
    )
    + " FROM q WHERE k > 0)"
)


def _quality(spark, sf):
    return flat(
        findings.quality_findings(dirty(spark, sf), ROLES, DIRTY_FEATURES, RANGES),
        "affected_count",
        "affected_rate",
    )


for _name, _code in (
    ("i1_missing_values", "missing_values"),
    ("i2_constant_feature", "constant_feature"),
    ("i3_non_finite_values", "non_finite_values"),
    ("i4_out_of_range", "numeric_out_of_range"),
    ("i5_duplicate_keys", "duplicate_entity_snapshot"),
):

    @query(_name, f"WITH {QUALITY_SQL} SELECT * FROM quality WHERE code = '{_code}'")
    def _(spark, sf, code=_code):
        return _quality(spark, sf).filter(F.col("code") == code)


# --- I. drift between two periods -------------------------------------------------------

DECILES = [i / 10 for i in range(1, 10)]


def psi_bins_sql(ref: str, cur: str, names, probs=DECILES) -> str:
    """SQL text: counts per feature and bin of both sides on reference quantile cuts."""
    cuts = " UNION ".join(
        f"SELECT feature, q{i} AS e FROM qs WHERE q{i} > min_value AND q{i} < max_value"
        for i in range(len(probs))
    )
    both = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS x, {side} AS cur FROM {src} WHERE {c} IS NOT NULL AND isfinite({c})"
        for c in names
        for src, side in ((ref, "0"), (cur, "1"))
    )
    return (
        f"{quantile_sql(ref, names, probs)}, cuts AS ({cuts}), "
        "bounds AS (SELECT feature, list(e ORDER BY e) AS es FROM cuts GROUP BY feature), "
        f"both_ AS ({both}), "
        "binned AS (SELECT b.feature, cur, len(list_filter(coalesce(es, []::DOUBLE[]), lambda e: e <= x)) AS bin "
        "FROM both_ b LEFT JOIN bounds USING (feature)), "
        "grid AS (SELECT q.feature, len(coalesce(es, []::DOUBLE[])) + 1 AS bins, unnest(range(0, len(coalesce(es, []::DOUBLE[])) + 1)) AS bin "
        "FROM qs q LEFT JOIN bounds USING (feature)), "
        "bc AS (SELECT g.feature, g.bin, g.bins, count(*) FILTER (cur = 0) AS r, count(*) FILTER (cur = 1) AS c "
        "FROM grid g LEFT JOIN binned b ON b.feature = g.feature AND b.bin = g.bin GROUP BY 1, 2, 3), "
        "bt AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS rt, sum(c) OVER (PARTITION BY feature) AS ct FROM bc), "
        "bp AS (SELECT *, (r + 0.000001::DOUBLE) / (rt + 0.000001::DOUBLE * bins) AS rp, "
        "(c + 0.000001::DOUBLE) / (ct + 0.000001::DOUBLE * bins) AS cp FROM bt), "
        "psi AS (SELECT feature, CAST(max(rt) AS BIGINT) AS reference_count, CAST(max(ct) AS BIGINT) AS current_count, "
        "CASE WHEN max(rt) > 0 AND max(ct) > 0 THEN sum((cp - rp) * ln(cp / rp)) ELSE 0 END AS psi FROM bp GROUP BY feature)"
    )


def periods_of(spark, sf):
    """Reference and current rows, joined once."""
    rows = stored(spark, sf, "entity_id", "supplier_id", "line_no")
    return reference(spark, sf, rows), current(spark, sf, rows)


@query(
    "i6_feature_psi",
    f"WITH {REF_CUR_SQL}, {psi_bins_sql('reference', 'current_', FEATURE_NAMES)} "
    f"SELECT feature, reference_count, current_count, {r6('psi')} AS psi FROM psi",
)
def _(spark, sf):
    periods = findings.label_periods(*periods_of(spark, sf))
    return rounded(findings.feature_psi(periods, FEATURE_NAMES))


def missing_sql(source, names):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 1.0::DOUBLE ELSE 0 END) AS m FROM {source}"
        for c in names
    )


def drift_sql(ref, cur, names):
    """SQL text of the drift findings between two sources, on CTE ``psi``."""
    nulls = ", NULL::DOUBLE AS psi, NULL::DOUBLE AS reference_count, NULL::DOUBLE AS current_count"
    shift = {"reference_rate": "rm", "current_rate": "cm", "rate_shift": "abs(cm - rm)"}
    return (
        f"mr AS ({missing_sql(ref, names)}), mc AS ({missing_sql(cur, names)}), "
        "ms AS (SELECT feature, mr.m AS rm, mc.m AS cm FROM mr JOIN mc USING (feature)), "
        f"ts AS (SELECT (SELECT avg(target) FROM {ref}) AS rm, (SELECT avg(target) FROM {cur}) AS cm), "
        "drift AS ("
        + finding_sql("population_shift", level("abs(cm - rm)", 0.1, 0.25), "'missing_rate_shift'", shift, feature="feature")
        + nulls + " FROM ms WHERE abs(cm - rm) >= 0.1::DOUBLE UNION ALL "
        + finding_sql("target_shift", level("abs(cm - rm)", 0.1, 0.25), "'target_rate_shift'", shift)
        + nulls + " FROM ts WHERE abs(cm - rm) >= 0.1::DOUBLE UNION ALL "
        "SELECT 'feature_drift', " + level("psi", 0.1, 0.25) + ", 'feature_psi', feature, NULL, NULL, NULL, NULL, NULL, "
        + f"{r6('psi')}, CAST(reference_count AS DOUBLE), CAST(current_count AS DOUBLE) FROM psi WHERE psi >= 0.1::DOUBLE)"
    )


DRIFT_METRICS = ["reference_rate", "current_rate", "rate_shift", "psi", "reference_count", "current_count"]


@query(
    "i7_drift_findings",
    f"WITH {REF_CUR_SQL}, {psi_bins_sql('reference', 'current_', FEATURE_NAMES)}, "
    f"{drift_sql('reference', 'current_', FEATURE_NAMES)} SELECT * FROM drift",
)
def _(spark, sf):
    periods = findings.label_periods(*periods_of(spark, sf))
    return flat(findings.drift_findings(periods, FEATURE_NAMES, "target"), *DRIFT_METRICS)


@query(
    "i8_target_rate",
    f"WITH {DIRTY_SQL} SELECT {r6('avg(target) FILTER (part_id % 2 = 0)')} AS reference_rate, "
    f"{r6('avg(target) FILTER (part_id % 2 <> 0)')} AS current_rate FROM dirty",
)
def _(spark, sf):
    df = dirty(spark, sf).withColumn(
        "period", F.when(F.col("part_id") % 2 == 0, "reference").otherwise("current")
    )
    return rounded(findings.target_rates(df, "target"))


SEGMENT_SQL = (
    "sg AS (SELECT segment, count(*) AS n, CAST(sum(target) AS BIGINT) AS p, sum(count(*)) OVER () AS t, sum(sum(target)) OVER () AS b FROM {src} GROUP BY 1), "
    "sr AS (SELECT *, p::DOUBLE / n AS rate, (p::DOUBLE / n) / (b::DOUBLE / t) AS lift FROM sg WHERE n >= {size}), "
    "segments_ AS ("
    + finding_sql(
        "segment_risk",
        level("lift", 1.25, 2.0, "'info'"),
        "'segment_target_rate'",
        {"sample_count": "n", "target_rate": "rate", "lift": "lift", "population_share": "n::DOUBLE / t"},
        token="'segment-' || substring(sha256('{{\"namespace\":\"{ns}\",\"value\":\"' || segment || '\"}}'), 1, 24)",
    )
    + " FROM sr)"
)


def uneven_risk(spark, sf):
    """Segments with planted differences of the target rate."""
    return uneven(spark, sf).withColumn(
        "target",
        F.when((F.col("supplier_id") % 11 == 8) & (F.col("part_id") % 2 == 0), 1).otherwise(F.col("target")),
    )


UNEVEN_SQL = (
    RISK_SQL
    + """, uneven AS (SELECT * REPLACE (
    CASE WHEN supplier_id % 11 < 8 THEN segment ELSE segment || '-' || CAST(supplier_id % 11 AS VARCHAR) END AS segment,
    CASE WHEN supplier_id % 11 = 8 AND part_id % 2 = 0 THEN 1 ELSE target END AS target) FROM risk)"""
)


@query(
    "i9_segment_findings",
    f"WITH {UNEVEN_SQL}, {SEGMENT_SQL.format(src='uneven', size=100, ns='risk')} SELECT * FROM segments_",
)
def _(spark, sf):
    df = findings.segment_findings(
        uneven_risk(spark, sf), "segment", "target", min_group_size=100, namespace="risk"
    )
    return flat(df, "sample_count", "target_rate", "lift", "population_share")


TIME_SQL = (
    "mo AS (SELECT strftime(snapshot_date, '%Y-%m') AS period, count(*) AS n, sum(target)::DOUBLE / count(*) AS rate FROM {src} WHERE snapshot_date IS NOT NULL GROUP BY 1), "
    "ml AS (SELECT *, lag(n) OVER (ORDER BY period) AS pn, lag(rate) OVER (ORDER BY period) AS pr FROM mo), "
    "times AS ("
    + finding_sql(
        "time_instability", level("abs(rate - pr)", 0.1, 0.25), "'monthly_target_rate_change'",
        {"previous_rate": "pr", "current_rate": "rate", "rate_shift": "abs(rate - pr)", "previous_count": "NULL", "current_count": "NULL", "drop_rate": "NULL"},
        period="period",
    )
    + " FROM ml WHERE abs(rate - pr) >= 0.1::DOUBLE UNION ALL "
    + finding_sql(
        "time_instability", level("(pn - n)::DOUBLE / pn", 0.25, 0.5), "'monthly_sample_drop'",
        {"previous_rate": "NULL", "current_rate": "NULL", "rate_shift": "NULL", "previous_count": "pn", "current_count": "n", "drop_rate": "(pn - n)::DOUBLE / pn"},
        period="period",
    )
    + " FROM ml WHERE n < pn AND (pn - n)::DOUBLE / pn >= 0.25::DOUBLE)"
)


def seasonal(spark, sf):
    """The risk view with every fifth month thinned out and another one relabelled."""
    month = F.month("snapshot_date")
    return risk(spark, sf).filter((month % 5 != 0) | (F.col("part_id") % 3 == 0)).withColumn(
        "target", F.when((month == 7) & (F.col("part_id") % 3 == 0), 1).otherwise(F.col("target"))
    )


SEASONAL_SQL = (
    RISK_SQL
    + """, seasonal AS (SELECT * REPLACE (CASE WHEN month(snapshot_date) = 7 AND part_id % 3 = 0 THEN 1 ELSE target END AS target)
    FROM risk WHERE month(snapshot_date) % 5 <> 0 OR part_id % 3 = 0)"""
)
TIME_METRICS = ["previous_rate", "current_rate", "rate_shift", "previous_count", "current_count", "drop_rate"]


@query("i10_time_findings", f"WITH {SEASONAL_SQL}, {TIME_SQL.format(src='seasonal')} SELECT * FROM times")
def _(spark, sf):
    df = findings.time_findings(seasonal(spark, sf), "snapshot_date", "target")
    return flat(df, *TIME_METRICS)


def diagnosed_rows(spark, sf):
    rows = stored(spark, sf, "ord_disc", "ord_tax", "ord_total", "line_no", "supplier_id")
    return dirty(spark, sf, rows).withColumn("target", F.coalesce("target", F.lit(0)))


def diagnosed(spark, sf):
    return findings.diagnose(
        diagnosed_rows(spark, sf),
        ROLES, DIRTY_FEATURES, dataset_id="risk", ranges=RANGES,
    )


_ALL = "SELECT kind, severity, code, feature, period, segment_token FROM"


@query(
    "i11_report_limitations",
    f"""WITH {DIRTY_SQL}, d AS (SELECT count(DISTINCT snapshot_date) AS days FROM dirty)
    SELECT 'dated' AS run, 'label_performance_window_unknown' AS limitation UNION ALL SELECT 'dated', 'insufficient_drift_reference' FROM d WHERE days < 2
    UNION ALL SELECT 'undated', unnest(['time_monitoring_disabled', 'insufficient_drift_reference', 'label_performance_window_unknown'])""",
)
def _(spark, sf):
    rows = diagnosed_rows(spark, sf)
    found = []
    for run, time_enabled in (("dated", True), ("undated", False)):
        report = findings.diagnostic_report(
            rows, ROLES, DIRTY_FEATURES, dataset_id="risk", ranges=RANGES, time_enabled=time_enabled
        )
        found += [(run, limit) for limit in report.limitations]
    return spark.createDataFrame(found, "run string, limitation string")


@query(
    "i11_diagnose",
    f"""WITH {DIRTY_SQL.replace('dirty AS (', 'dirty0 AS (')}, dirty AS (SELECT * REPLACE (coalesce(target, 0) AS target) FROM dirty0),
    pd AS (SELECT DISTINCT snapshot_date AS day FROM dirty WHERE snapshot_date IS NOT NULL),
    pr AS (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS g FROM pd),
    pe AS (SELECT day FROM pr WHERE i = greatest(1, least(g - 1, CAST(ceil(g * 0.6::DOUBLE) AS BIGINT)))),
    dref AS (SELECT * FROM dirty WHERE snapshot_date <= (SELECT day FROM pe)),
    dcur AS (SELECT * FROM dirty WHERE snapshot_date > (SELECT day FROM pe)),
    {QUALITY_SQL[len(DIRTY_SQL) + 2:]}, {psi_bins_sql('dref', 'dcur', DIRTY_FEATURES)}, {drift_sql('dref', 'dcur', DIRTY_FEATURES)},
    {SEGMENT_SQL.format(src='dirty', size=100, ns='risk')}, {TIME_SQL.format(src='dirty')}
    {_ALL} quality UNION ALL {_ALL} drift UNION ALL {_ALL} segments_ UNION ALL {_ALL} times""",
)
def _(spark, sf):
    return diagnosed(spark, sf).drop("metrics", "finding_id")


@query("i12_finding_report")
def _(spark, sf):
    return findings.report_order(diagnosed(spark, sf)).select(
        "finding_id", "severity", "kind", "code", "feature", "period"
    )


# --- I. reference snapshot and alerts ---------------------------------------------------------

def order_catalog(spark):
    return contract.feature_catalog(spark, FEATURE_NAMES, FEATURES.families)


def alert_rules(frame, lift):
    """A small rule table whose lift depends on the data."""
    return frame.groupBy(F.concat(F.lit("rule-"), F.col("line_no") % 4).alias("rule_id")).agg(
        (F.count("*") / F.count("*")).alias("coverage"),
        F.avg("target").alias("hit_bad_rate"),
        lift.alias("lift"),
    )


def monitored(spark, sf):
    """What snapshots and alerts read of the risk view, joined once."""
    return stored(spark, sf, "entity_id", "supplier_id")


def snapshot_of(spark, sf, rows=None):
    ref = reference(spark, sf, monitored(spark, sf) if rows is None else rows)
    evidence = alert_rules(ref, 10 * F.avg("target"))
    return monitoring.build_snapshot(
        ref, ROLES, FEATURE_NAMES, dataset_id="risk", catalog=order_catalog(spark), evidence=evidence
    )


QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
SNAP_SQL = (
    f"{quantile_sql('reference', FEATURE_NAMES, QUARTILES)}, "
    "ed AS (SELECT feature, list_sort(list_distinct([q0, q1, q2, q3, q4])) AS es FROM qs), "
    "rx AS (SELECT l.feature, x, es, least(len(list_filter(es, lambda e: e <= x)), len(es) - 1) - 1 AS bin FROM lng l JOIN ed USING (feature)), "
    "rc AS (SELECT feature, bin, count(*) AS n FROM rx GROUP BY 1, 2), "
    "rg AS (SELECT feature, es, unnest(range(0, len(es) - 1)) AS bin FROM ed), "
    "rh AS (SELECT g.feature, g.es, g.bin, coalesce(n, 0) AS n FROM rg g LEFT JOIN rc c ON c.feature = g.feature AND c.bin = g.bin), "
    f"rr AS ({missing_sql('reference', FEATURE_NAMES)}), "
    "rz AS (SELECT feature, avg(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END) AS z FROM lng GROUP BY 1), "
    "fam AS (SELECT feature, CASE WHEN feature LIKE 'ord_%' THEN 'order' ELSE 'customer' END AS family FROM qs)"
)


@query(
    "i13_reference_features",
    f"""WITH {REF_CUR_SQL}, {SNAP_SQL} SELECT h.feature, any_value(family) AS family, 'double' AS dtype,
    {r6("any_value(m)")} AS missing_rate, {r6("any_value(z)")} AS zero_rate,
    {r6("any_value(es)[1]")} AS first_edge, {r6("list_sum(any_value(es))")} AS edge_sum,
    CAST(any_value(len(es)) AS BIGINT) AS edge_count,
    string_agg(CAST(n AS VARCHAR), ',' ORDER BY bin) AS counts
    FROM rh h JOIN fam USING (feature) JOIN rr USING (feature) JOIN rz USING (feature) GROUP BY h.feature""",
)
def _(spark, sf):
    rows = monitoring.reference_features(reference(spark, sf), FEATURE_NAMES, order_catalog(spark))
    df = monitoring.reference_frame(spark, rows)
    return rounded(
        df.select(
            "feature", "family", "dtype", "missing_rate", "zero_rate",
            F.col("edges")[0].alias("first_edge"),
            F.aggregate("edges", F.lit(0.0), lambda a, x: a + x).alias("edge_sum"),
            F.size("edges").cast("long").alias("edge_count"),
            F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"),
        )
    )


@query(
    "i14_reference_segments",
    f"WITH {REF_CUR_SQL} SELECT segment, count(*) AS n FROM reference GROUP BY 1 HAVING count(*) >= 100",
)
def _(spark, sf):
    return snapshot_of(spark, sf).segments


@query("i14_snapshot_identity")
def _(spark, sf):
    return monitoring.snapshot_id(snapshot_of(spark, sf))


def both_periods(spark, sf):
    """Snapshot of the reference period and the rows of the current one."""
    rows = monitored(spark, sf)
    return snapshot_of(spark, sf, rows), current(spark, sf, rows)


def drifted(spark, sf):
    """The current period without one feature and with one feature as text."""
    return current(spark, sf).drop("cust_bal").withColumn("ord_disc", F.col("ord_disc").cast("string"))


ALERT_COLS = ["alert_id", "alert_type", "severity", "scope", "scope_value", "metric",
              "reference_value", "current_value", "delta"]


def alert_view(df):
    return rounded(df.select(*ALERT_COLS))


def alert_sql(kind, scope, metric, value, severity, ref="NULL", cur="NULL", delta="NULL"):
    return (
        f"SELECT substring(sha256('{kind}|{scope}|' || {value} || '|{metric}'), 1, 12) AS alert_id, '{kind}' AS alert_type, "
        f"{severity} AS severity, '{scope}' AS scope, {value} AS scope_value, '{metric}' AS metric, "
        f"{r6(ref)} AS reference_value, {r6(cur)} AS current_value, {r6(delta)} AS delta"
    )


@query(
    "i15_schema_alerts",
    "SELECT * FROM (" + alert_sql("schema", "feature", "column", "'cust_bal'", "'critical'")
    + ") WHERE (SELECT count(*) FROM lineitem) > 0 UNION ALL SELECT * FROM ("
    + alert_sql("schema", "feature", "dtype_family", "'ord_disc'", "'critical'")
    + ") WHERE (SELECT count(*) FROM lineitem) > 0",
)
def _(spark, sf):
    return alert_view(monitoring.schema_alerts(snapshot_of(spark, sf), drifted(spark, sf)))


MISSING_ALERT_SQL = (
    f"ca AS ({missing_sql('current_', FEATURE_NAMES)}), ra AS ({missing_sql('reference', FEATURE_NAMES)}), "
    "mj AS (SELECT feature, ra.m AS r, ca.m AS c FROM ra JOIN ca USING (feature)), missing_ AS ("
    + alert_sql("missingness", "feature", "missing_rate", "feature", level("c - r", 0.1, 0.25), "r", "c", "c - r")
    + " FROM mj WHERE c - r >= 0.1::DOUBLE)"
)


@query("i16_missingness_alerts", f"WITH {REF_CUR_SQL}, {MISSING_ALERT_SQL} SELECT * FROM missing_")
def _(spark, sf):
    return alert_view(monitoring.missing_alerts(*both_periods(spark, sf)))


_CUR_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS x FROM current_ WHERE {c} IS NOT NULL AND isfinite({c})" for c in FEATURE_NAMES
)
DIST_SQL = (
    f"{SNAP_SQL}, cl AS ({_CUR_LONG}), "
    "cx AS (SELECT l.feature, greatest(0, least(len(list_filter(es, lambda e: e <= x)), len(es) - 1) - 1) AS bin FROM cl l JOIN ed USING (feature)), "
    "cc AS (SELECT feature, bin, count(*) AS n FROM cx GROUP BY 1, 2), "
    "pj AS (SELECT h.feature, h.bin, len(es) - 1 AS bins, h.n AS r, coalesce(c.n, 0) AS c, sum(h.n) OVER (PARTITION BY h.feature) AS rt, "
    "sum(coalesce(c.n, 0)) OVER (PARTITION BY h.feature) AS ct FROM rh h LEFT JOIN cc c ON c.feature = h.feature AND c.bin = h.bin), "
    "pf AS (SELECT feature, bins, greatest(r::DOUBLE / rt, 0.000001::DOUBLE) AS rp, greatest(c::DOUBLE / ct, 0.000001::DOUBLE) AS cp FROM pj), "
    "fp AS (SELECT feature, max(bins) AS bins, sum((cp - rp) * ln(cp / rp)) AS psi FROM pf GROUP BY feature), dist_ AS ("
    + alert_sql("distribution", "feature", "psi", "feature", level("abs(psi)", 0.2, 0.3), "0", "psi", "psi")
    + " FROM fp WHERE abs(psi) >= 0.2::DOUBLE)"
)


@query("i17_distribution_alerts", f"WITH {REF_CUR_SQL}, {DIST_SQL} SELECT * FROM dist_")
def _(spark, sf):
    return alert_view(monitoring.distribution_alerts(*both_periods(spark, sf)))


@query(
    "i17_floored_psi",
    f"WITH {REF_CUR_SQL}, {DIST_SQL} SELECT feature, CAST(bins AS BIGINT) AS bins, {r6('psi')} AS psi FROM fp",
)
def _(spark, sf):
    df = monitoring.psi_floored(*both_periods(spark, sf))
    return rounded(df.withColumn("bins", F.col("bins").cast("long")))


FAMILY_SQL = (
    "fa AS (SELECT CASE WHEN scope_value LIKE 'ord_%' THEN 'order' ELSE 'customer' END AS family, count(*) AS k, "
    "max(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS crit FROM missing_ GROUP BY 1 HAVING count(*) >= 2), family_ AS ("
    + alert_sql("missingness", "family", "missing_rate", "family", "CASE WHEN crit = 1 THEN 'critical' ELSE 'warning' END")
    + " FROM fa)"
)


@query(
    "i18_family_alerts",
    f"WITH {REF_CUR_SQL}, {MISSING_ALERT_SQL}, {FAMILY_SQL} SELECT * FROM family_",
)
def _(spark, sf):
    snap, now = both_periods(spark, sf)
    missing = monitoring.missing_alerts(snap, now)
    return alert_view(monitoring.family_alerts(snap, missing))


LABEL_SQL = (
    "la AS (SELECT (SELECT avg(target) FROM reference) AS r, (SELECT sum(CASE WHEN target = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) FROM current_) AS c), label_ AS ("
    + alert_sql("label", "dataset", "positive_rate", "'risk'", level("abs(c - r)", 0.03, 0.08), "r", "c", "c - r")
    + " FROM la WHERE abs(c - r) >= 0.03::DOUBLE)"
)


@query("i19_label_alerts", f"WITH {REF_CUR_SQL}, {LABEL_SQL} SELECT * FROM label_")
def _(spark, sf):
    return alert_view(monitoring.label_alerts(*both_periods(spark, sf)))


POP_SQL = (
    "rs AS (SELECT segment, count(*) AS n FROM reference GROUP BY 1 HAVING count(*) >= 100), "
    "cs AS (SELECT segment, count(*) AS n FROM current_ GROUP BY 1), "
    "pp AS (SELECT segment, coalesce(rs.n, 0) AS r, coalesce(cs.n, 0) AS c FROM rs FULL JOIN cs USING (segment)), "
    "ps AS (SELECT segment, r::DOUBLE / (SELECT count(*) FROM reference) AS r, c::DOUBLE / (SELECT count(*) FROM current_) AS c FROM pp "
    "WHERE (r = 0 AND c >= 100) OR (c = 0 AND r >= 100) OR (r >= 100 AND c >= 100)), population_ AS ("
    + alert_sql("population", "institution", "share", "segment", "'warning'", "r", "c", "c - r")
    + " FROM ps WHERE abs(c - r) >= 0.1::DOUBLE)"
)


@query("i20_population_alerts", f"WITH {REF_CUR_SQL}, {POP_SQL} SELECT * FROM population_")
def _(spark, sf):
    return alert_view(monitoring.population_alerts(*both_periods(spark, sf)))


DECAY_SQL = (
    "r0 AS (SELECT 'rule-' || CAST(line_no % 4 AS VARCHAR) AS rule_id, 10 * avg(target) AS lift FROM reference GROUP BY 1), "
    "c0 AS (SELECT 'rule-' || CAST(line_no % 4 AS VARCHAR) AS rule_id, 1.3::DOUBLE + 0.1::DOUBLE * any_value(line_no % 4) AS lift FROM current_ WHERE line_no % 4 <> 3 GROUP BY 1), "
    "rj AS (SELECT rule_id, r0.lift AS r, c0.lift AS c, (r0.lift - c0.lift) / r0.lift AS d FROM r0 JOIN c0 USING (rule_id) WHERE r0.lift > 0), decay_ AS ("
    + alert_sql("rule_decay", "rule", "lift_decay", "rule_id", level("d", 0.2, 0.4), "r", "c", "d")
    + " FROM rj WHERE d >= 0.2::DOUBLE)"
)


def current_rules(now):
    return alert_rules(now.filter(F.col("line_no") % 4 != 3), 1.3 + 0.1 * F.first(F.col("line_no") % 4))


@query("i21_rule_decay_alerts", f"WITH {REF_CUR_SQL}, {DECAY_SQL} SELECT * FROM decay_")
def _(spark, sf):
    snap, now = both_periods(spark, sf)
    return alert_view(monitoring.rule_decay_alerts(snap.rules, current_rules(now)))


ALERTS_SQL = (
    f"{MISSING_ALERT_SQL}, {DIST_SQL}, {FAMILY_SQL}, {LABEL_SQL}, {POP_SQL}, {DECAY_SQL}, alerts AS ("
    "SELECT * FROM missing_ UNION ALL SELECT * FROM dist_ UNION ALL SELECT * FROM family_ UNION ALL SELECT * FROM label_ "
    "UNION ALL SELECT * FROM population_ UNION ALL SELECT * FROM decay_)"
)


def detected(spark, sf):
    """Snapshot, current rows, their facts (read once for alerts and causes) and alerts."""
    snap, now = both_periods(spark, sf)
    known = monitoring.facts(snap, now)
    return snap, now, known, small_table(monitoring.detect(snap, now, current_rules(now), known))


@query("i22_detect", f"WITH {REF_CUR_SQL}, {ALERTS_SQL} SELECT * FROM alerts")
def _(spark, sf):
    return alert_view(monitoring.alert_order(detected(spark, sf)[-1]))


@query(
    "i23_alert_overview",
    f"""WITH {REF_CUR_SQL}, {ALERTS_SQL} SELECT t.alert_type, count(a.alert_id) AS alert_count,
    count(*) FILTER (scope <> 'institution') AS global_count, count(*) FILTER (scope = 'institution') AS institution_count
    FROM (VALUES ({sql_list(monitoring.ALERT_TYPES).replace("', '", "'), ('")})) AS t(alert_type)
    LEFT JOIN alerts a USING (alert_type) GROUP BY 1""",
)
def _(spark, sf):
    return monitoring.alert_overview(detected(spark, sf)[-1])


# --- K. attribution ------------------------------------------------------------------------------


@query(
    "k1_eligible_segments",
    f"""WITH {REF_CUR_SQL} SELECT segment, count(*) AS n, {r6("count(*)::DOUBLE / (SELECT count(*) FROM current_)")} AS share
    FROM current_ WHERE segment <> 'HOUSEHOLD' OR part_id % 40 = 0 GROUP BY 1 HAVING count(*) >= 1000""".replace(
        "(SELECT count(*) FROM current_)",
        "(SELECT count(*) FROM current_ WHERE segment <> 'HOUSEHOLD' OR part_id % 40 = 0)",
    ),
)
def _(spark, sf):
    df = current(spark, sf).filter((F.col("segment") != "HOUSEHOLD") | (F.col("part_id") % 40 == 0))
    return rounded(monitoring.eligible_segments(df, "segment", 1000))


def _parts_sql():
    missing = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, segment, count(*) AS n, avg(CASE WHEN {c} IS NULL OR NOT isfinite({c}) THEN 1.0::DOUBLE ELSE 0 END) AS m, "
        f"coalesce(avg({c}) FILTER ({c} IS NOT NULL AND isfinite({c})), 0) AS a FROM current_ GROUP BY segment"
        for c in FEATURE_NAMES
    )
    return (
        f"sm AS ({missing}), ec AS (SELECT feature, list_sum(es) / len(es) AS center FROM ed), "
        "parts AS (SELECT feature, family, segment, n::DOUBLE / (SELECT count(*) FROM current_) AS share, rr.m AS ref_missing, sm.m AS missing_rate, "
        "abs(sm.m - rr.m) * (n::DOUBLE / (SELECT count(*) FROM current_)) AS missing_part, center AS ref_center, a AS center, "
        "abs(a - center) * (n::DOUBLE / (SELECT count(*) FROM current_)) AS center_part "
        "FROM sm JOIN rr USING (feature) JOIN ec USING (feature) JOIN fam USING (feature) WHERE n >= 100)"
    )


@query(
    "k2_missing_contributions",
    f"WITH {REF_CUR_SQL}, {SNAP_SQL}, {_parts_sql()} SELECT feature, segment, {r6('share')} AS share, "
    f"{r6('ref_missing')} AS ref_missing, {r6('missing_rate')} AS missing_rate, {r6('missing_part')} AS missing_part FROM parts",
)
def _(spark, sf):
    parts = monitoring.segment_contributions(*both_periods(spark, sf), FEATURE_NAMES)
    return rounded(parts.select("feature", "segment", "share", "ref_missing", "missing_rate", "missing_part"))


@query(
    "k3_center_contributions",
    f"WITH {REF_CUR_SQL}, {SNAP_SQL}, {_parts_sql()} SELECT feature, segment, round({r6('ref_center')}, 3) AS ref_center, "
    f"round({r6('center')}, 3) AS center, round({r6('center_part')}, 3) AS center_part FROM parts",
)
def _(spark, sf):
    parts = monitoring.segment_contributions(*both_periods(spark, sf), FEATURE_NAMES)
    return rounded(parts.select("feature", "segment", "ref_center", "center", "center_part"), 3)


CAUSES_SQL = (
    _parts_sql()
    + ", lc AS (SELECT segment, count(*) AS n, avg(CASE WHEN target = 1 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM current_ GROUP BY 1), "
    "fa_ AS (SELECT alert_id, alert_type, scope_value AS feature, delta FROM alerts WHERE scope = 'feature'), "
    "mm AS (SELECT alert_id, f.feature, family, segment, delta, missing_part AS part FROM fa_ f JOIN parts USING (feature) WHERE alert_type = 'missingness' "
    "UNION ALL SELECT alert_id, f.feature, family, segment, delta, center_part FROM fa_ f JOIN parts USING (feature) WHERE alert_type = 'distribution'), "
    "ff AS (SELECT alert_id, p.feature, p.segment, p.family, missing_part AS part FROM alerts a JOIN parts p ON a.scope_value = p.family WHERE a.scope = 'family'), "
    "causes AS (SELECT alert_id, 'segment' AS dimension, scope_value AS value, abs(delta) AS contribution FROM alerts WHERE alert_type = 'population' "
    "UNION ALL SELECT alert_id, 'rule', scope_value, abs(delta) FROM alerts WHERE alert_type = 'rule_decay' "
    "UNION ALL SELECT alert_id, 'target', 'target', abs(delta) FROM alerts WHERE alert_type = 'label' "
    "UNION ALL SELECT alert_id, 'segment', segment, abs(rate - reference_value) * (n::DOUBLE / (SELECT count(*) FROM current_)) FROM alerts, lc WHERE alert_type = 'label' AND n >= 100 "
    "UNION ALL SELECT alert_id, 'segment', segment, part FROM mm "
    "UNION ALL SELECT alert_id, 'feature', feature, abs(max(delta)) FROM mm GROUP BY alert_id, feature "
    "UNION ALL SELECT alert_id, 'family', family, sum(part) FROM mm GROUP BY alert_id, family "
    "UNION ALL SELECT alert_id, 'segment', segment, sum(part) FROM ff GROUP BY alert_id, segment "
    "UNION ALL SELECT alert_id, 'feature', feature, sum(part) FROM ff GROUP BY alert_id, feature "
    "UNION ALL SELECT alert_id, 'family', family, sum(part) FROM ff GROUP BY alert_id, family)"
)


def _cause_query(name, where, top=100):
    sql = (
        f"WITH {REF_CUR_SQL}, {ALERTS_SQL}, {CAUSES_SQL}, ranked AS (SELECT c.alert_id, dimension, value, contribution, "
        "row_number() OVER (PARTITION BY c.alert_id ORDER BY round(contribution, 5) DESC, list_position(['segment', 'family', 'feature', 'target', 'rule', 'schema'], dimension), value) AS rank "
        f"FROM causes c JOIN alerts a USING (alert_id) WHERE {where}) "
        f"SELECT alert_id, dimension, value, round({r6('contribution')}, 4) AS contribution, rank FROM ranked WHERE rank <= {top}"
    )

    @query(name, sql)
    def _(spark, sf):
        snap, now, known, alerts = detected(spark, sf)
        causes = monitoring.root_causes(alerts.filter(where), snap, now, top_k=top, known=known)
        return rounded(causes.select("alert_id", "dimension", "value", "contribution", "rank"), 4)


_cause_query("k4_label_causes", "alert_type = 'label'")
_cause_query("k5_direct_causes", "alert_type IN ('population', 'rule_decay')")
_cause_query("k6_family_causes", "scope = 'family'")
_cause_query("k7_root_causes", "scope <> 'nothing'", top=3)
