"""Queries for rule discovery, validation and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded
from scorewatch.functions.ranks import quantiles
from scorewatch.functions.stats import fisher_p, lift_interval
from scorewatch.operators import discovery, validation
from scorewatch.operators.metrics import rule_counts
from scorewatch.operators.split import time_split
from scorewatch.plans.queries_core import (
    METRIC_NAMES,
    METRICS_SQL,
    RULES,
    TIME_SPLIT_SQL,
    counts_sql,
    quantile_sql,
)
from scorewatch.plans.registry import query
from scorewatch.plans.views import (
    DIRTY_SQL,
    FEATURE_NAMES,
    RISK_SQL,
    ROLES,
    dirty,
    r6,
    risk,
    stored,
)
from scorewatch.roles import DiscoveryConfig, ValidationConfig
from scorewatch.sources.tables import evidence_output, rules_frame

CONFIG = DiscoveryConfig()
VALIDATION = ValidationConfig(bootstrap_rounds=200)


def parts(spark, sf):
    return time_split(stored(spark, sf, "entity_id", "line_no", "part_id", "supplier_id"), "snapshot_date")


def train(spark, sf):
    return parts(spark, sf).filter("partition = 'train'")


# --- F. discovery ------------------------------------------------------------------------

TRAIN_SQL = f"""{TIME_SPLIT_SQL}, train AS (SELECT * FROM parts WHERE "partition" = 'train'),
 {quantile_sql('train', FEATURE_NAMES, discovery.THRESHOLD_PROBS)},
 tot AS (SELECT count(*) AS tn, CAST(sum(target) AS BIGINT) AS tp, CAST(ceil(count(*) * 0.05) AS BIGINT) AS low,
         CAST(floor(count(*) * 0.95) AS BIGINT) AS high FROM train)"""


@query(
    "f1_quantile_thresholds",
    f"WITH {TRAIN_SQL} SELECT feature, "
    + ", ".join(f"{r6(f'q{i}')} AS q{i}" for i in range(5))
    + " FROM qs",
)
def _(spark, sf):
    q = quantiles(train(spark, sf), FEATURE_NAMES, discovery.THRESHOLD_PROBS)
    return rounded(q.select("feature", *[F.col("q")[i].alias(f"q{i}") for i in range(5)]))


@query(
    "f2_eligible_features",
    f"WITH {DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (isinf({c})) AS infinite, min({c}) FILTER (isfinite({c})) AS min_value, "
        f"max({c}) FILTER (isfinite({c})) AS max_value, count(*) FILTER (isinf({c})) = 0 AND "
        f"min({c}) FILTER (isfinite({c})) < max({c}) FILTER (isfinite({c})) AS eligible FROM dirty"
        for c in ["cust_bal", "ord_flat", "ord_price", "ord_qty"]
    ),
)
def _(spark, sf):
    return discovery.eligible_features(
        dirty(spark, sf), ["cust_bal", "ord_flat", "ord_price", "ord_qty"]
    )


def tree_sql(balanced: bool = False) -> str:
    """SQL text: depth-2 Gini tree thresholds per feature on CTE ``lng``."""
    w1 = "fn / (2 * fb)" if balanced else "1.0::DOUBLE"
    w0 = "fn / (2 * (fn - fb))" if balanced else "1.0::DOUBLE"

    def side(n, b):
        return f"((({b}) * w1) * (({b}) * w1) + ((({n}) - ({b})) * w0) * ((({n}) - ({b})) * w0)) / (({b}) * w1 + (({n}) - ({b})) * w0)"

    def split(name, source, keys):
        using = f"PARTITION BY {keys}"
        return (
            f"{name}r AS (SELECT *, sum(n) OVER ({using} ORDER BY v)::DOUBLE AS cn, sum(bad) OVER ({using} ORDER BY v)::DOUBLE AS cb, "
            f"lead(v) OVER ({using} ORDER BY v) AS nv, sum(n) OVER ({using})::DOUBLE AS an, sum(bad) OVER ({using})::DOUBLE AS ab, "
            f"sum(n) OVER (PARTITION BY feature)::DOUBLE AS fn, sum(bad) OVER (PARTITION BY feature)::DOUBLE AS fb FROM {source}), "
            f"{name}w AS (SELECT *, {w1} AS w1, {w0} AS w0 FROM {name}r), "
            f"{name}g AS (SELECT *, {side('cn', 'cb')} + {side('an - cn', 'ab - cb')} AS gain FROM {name}w, tot "
            "WHERE ab > 0 AND ab < an AND cn >= low AND an - cn >= low AND an > cn AND nv > v + 1e-7::DOUBLE), "
            f"{name} AS (SELECT {keys}, CASE WHEN v / 2 + nv / 2 < nv THEN v / 2 + nv / 2 ELSE v END AS threshold FROM "
            f"(SELECT *, row_number() OVER ({using} ORDER BY gain DESC, v) AS k FROM {name}g) WHERE k = 1)"
        )

    return (
        "vc AS (SELECT feature, CAST(CAST(x AS FLOAT) AS DOUBLE) AS v, count(*) AS n, sum(target) AS bad FROM lng GROUP BY 1, 2), "
        + split("root", "vc", "feature")
        + ", nodes AS (SELECT vc.*, CASE WHEN v > threshold THEN 1 ELSE 0 END AS node FROM vc JOIN root USING (feature)), "
        + split("child", "nodes", "feature, node")
        + ", tree AS (SELECT feature, threshold FROM root UNION SELECT feature, threshold FROM child)"
    )


def _tree(spark, sf, balanced):
    df = train(spark, sf)
    low, _ = discovery.support_bounds(df.count(), CONFIG.min_support)
    found = discovery.tree_thresholds(df, FEATURE_NAMES, "target", low, balanced=balanced)
    return spark.createDataFrame(
        [(f, t) for f, cuts in found.items() for t in cuts], "feature string, threshold double"
    )


@query("f4_tree_thresholds", f"WITH {TRAIN_SQL}, {tree_sql()} SELECT * FROM tree")
def _(spark, sf):
    return _tree(spark, sf, False)


@query("f4_balanced_tree_thresholds", f"WITH {TRAIN_SQL}, {tree_sql(True)} SELECT * FROM tree")
def _(spark, sf):
    return _tree(spark, sf, True)


@query("f5_boosted_thresholds")
def _(spark, sf):
    cuts = discovery.boosted_thresholds(train(spark, sf), FEATURE_NAMES, "target")
    return spark.createDataFrame([(f, c) for f, own in cuts.items() for c in own], "feature string, threshold double")


JSON_SQL = """'[{"feature":"' || feature || '","operator":"' || op || '","value":' || CAST(t AS VARCHAR) || '}]'"""
LIFT_SQL = "(hit_pos::DOUBLE / hit) / (tp::DOUBLE / tn)"
SINGLES_SQL = f"""{TRAIN_SQL}, {tree_sql()},
 thr AS (SELECT feature, threshold AS t FROM tree """ + " ".join(
    f"UNION SELECT feature, q{i} FROM qs" for i in range(5)
) + f"""),
 hits AS (SELECT feature, t, count(*) FILTER (x <= t) AS lo, CAST(coalesce(sum(target) FILTER (x <= t), 0) AS BIGINT) AS lob,
   count(*) FILTER (x > t) AS hi, CAST(coalesce(sum(target) FILTER (x > t), 0) AS BIGINT) AS hib FROM lng JOIN thr USING (feature) GROUP BY 1, 2),
 sides AS (SELECT feature, t, '<=' AS op, lo AS hit, lob AS hit_pos FROM hits UNION ALL SELECT feature, t, '>', hi, hib FROM hits),
 singles AS (SELECT feature, t, op, hit, hit_pos, {LIFT_SQL} AS lift, {JSON_SQL} AS expression FROM sides, tot WHERE hit BETWEEN low AND high)"""
BEAM_SQL = """placed AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY lift DESC, hit DESC, expression DESC) AS place FROM singles),
 beam AS (SELECT *, row_number() OVER (ORDER BY place, feature) AS k FROM placed QUALIFY row_number() OVER (ORDER BY place, feature) <= 20)"""
PAIR_SQL = f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM train),
 tl AS ({' UNION ALL '.join(f"SELECT rid, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, target FROM numbered" for c in FEATURE_NAMES)}),
 on_ AS MATERIALIZED (SELECT rid, target, k FROM tl JOIN beam b ON tl.feature = b.feature AND ((op = '<=' AND x <= t) OR (op = '>' AND x > t))),
 pc AS (SELECT a.k AS i, b.k AS j, count(*) AS hit, CAST(sum(a.target) AS BIGINT) AS hit_pos FROM on_ a JOIN on_ b ON a.rid = b.rid AND a.k < b.k GROUP BY 1, 2),
 pj AS (SELECT pc.hit, pc.hit_pos, CASE WHEN l.feature < r.feature THEN l.expression ELSE r.expression END AS e1,
        CASE WHEN l.feature < r.feature THEN r.expression ELSE l.expression END AS e2,
        least(l.feature, r.feature) || '+' || greatest(l.feature, r.feature) AS fp
        FROM pc JOIN beam l ON l.k = i JOIN beam r ON r.k = j WHERE l.feature <> r.feature AND pc.hit <> l.hit AND pc.hit <> r.hit),
 pairs AS (SELECT hit, hit_pos, fp, {LIFT_SQL} AS lift, rtrim(e1, ']') || ',' || ltrim(e2, '[') AS expression FROM pj, tot WHERE hit >= low)"""
PICK_SQL = """firsts AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY lift DESC, hit DESC, expression DESC) AS k FROM pairs),
 picked AS (SELECT * FROM firsts QUALIFY row_number() OVER (ORDER BY (k = 1) DESC, lift DESC, hit DESC, expression DESC) <= 50)"""
CANDIDATE_OUT = f"substring(sha256(expression), 1, 12) AS rule_id, expression, hit, hit_pos, {r6('lift')} AS lift"
CANDIDATE_COLS = ["rule_id", "expression", "hit", "hit_pos", "lift"]


def _totals(df):
    row = df.agg(F.count("*").alias("n"), F.sum("target").alias("p")).first()
    return row["n"], row["p"]


def _singles(spark, sf):
    df = train(spark, sf)
    n, p = _totals(df)
    cuts = discovery.rule_thresholds(df, FEATURE_NAMES, "target", CONFIG, n)
    return df, n, p, discovery.single_candidates(df, cuts, "target", CONFIG, n, p)


def _pairs(spark, sf):
    df, n, p, singles = _singles(spark, sf)
    return discovery.pair_candidates(df, discovery.pair_beam(singles, 20), "target", CONFIG, n, p)


@query(
    "f6_supported_rules",
    f"WITH {RISK_SQL}, c AS ({counts_sql('risk')}) SELECT rule_id, hit FROM c "
    "WHERE hit BETWEEN ceil(n * 0.15) AND floor(n * 0.85)",
)
def _(spark, sf):
    df = risk(spark, sf)
    low, high = discovery.support_bounds(df.count(), 0.15)
    counts = rule_counts(df, RULES, "target")
    return counts.filter(F.col("hit").between(low, high)).select("rule_id", "hit")


@query("f7_single_candidates", f"WITH {SINGLES_SQL} SELECT {CANDIDATE_OUT} FROM singles")
def _(spark, sf):
    return rounded(_singles(spark, sf)[3].select(*CANDIDATE_COLS))


@query(
    "f8_pair_beam",
    f"WITH {SINGLES_SQL}, {BEAM_SQL} SELECT {CANDIDATE_OUT}, feature, place FROM beam",
)
def _(spark, sf):
    beam = discovery.pair_beam(_singles(spark, sf)[3], 20)
    return rounded(beam.select(*CANDIDATE_COLS, "feature", F.col("place").cast("long").alias("place")))


@query(
    "f9_pair_candidates",
    f"WITH {SINGLES_SQL}, {BEAM_SQL}, {PAIR_SQL} SELECT {CANDIDATE_OUT} FROM pairs",
)
def _(spark, sf):
    return rounded(_pairs(spark, sf).select(*CANDIDATE_COLS))


@query(
    "f10_diverse_pairs",
    f"WITH {SINGLES_SQL}, {BEAM_SQL}, {PAIR_SQL}, {PICK_SQL} SELECT {CANDIDATE_OUT} FROM picked",
)
def _(spark, sf):
    return rounded(discovery.diverse_pairs(_pairs(spark, sf), 50).select(*CANDIDATE_COLS))


@query(
    "f11_discovered_rules",
    f"""WITH {SINGLES_SQL}, {BEAM_SQL}, {PAIR_SQL}, {PICK_SQL},
    best AS (SELECT * FROM singles ORDER BY lift DESC, hit DESC, expression DESC LIMIT 100)
    SELECT {CANDIDATE_OUT}, 'discovery_single' AS origin FROM best
    UNION ALL SELECT {CANDIDATE_OUT}, 'discovery_pair' FROM picked""",
)
def _(spark, sf):
    found = discovery.discover(train(spark, sf), FEATURE_NAMES, "target", CONFIG)
    return rounded(found.frame.select(*CANDIDATE_COLS, "origin"))


@query("f3_woe_thresholds")
def _(spark, sf):
    df = train(spark, sf)
    config = DiscoveryConfig(tree_cuts=False, woe_cuts=True)
    cuts = discovery.rule_thresholds(df, FEATURE_NAMES, "target", config, df.count())
    return spark.createDataFrame(
        [(f, t) for f, c in cuts.items() for t in c], "feature string, threshold double"
    )


@query(
    "d4_rule_identity",
    f"""WITH {RISK_SQL}, m AS (SELECT segment, round(avg(ord_price), 3) AS t, 'ord_price' AS feature, '>' AS op FROM risk GROUP BY 1)
    SELECT segment, substring(sha256({JSON_SQL}), 1, 12) AS rule_id FROM m""",
)
def _(spark, sf):
    means = risk(spark, sf).groupBy("segment").agg(F.round(F.avg("ord_price"), 3).alias("t"))
    rules = means.select(
        "segment",
        F.expr("array(named_struct('feature', 'ord_price', 'operator', '>', 'value', t))").alias(
            "conditions"
        ),
    )
    return discovery.with_identity(rules).select("segment", "rule_id")


# --- E2, E3. tests on rule tables ------------------------------------------------------------

CHOOSE = "(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def fisher_sql(source: str, name: str = "fisher") -> str:
    """SQL text: two-sided Fisher p-values of a count table, by summing all tables."""

    def log_pmf(x):
        return (
            CHOOSE.format(n="pos", k=x) + " + " + CHOOSE.format(n="(n - pos)", k=f"(hit - {x})")
            + " - " + CHOOSE.format(n="n", k="hit")
        )

    return (
        f"{name}0 AS (SELECT rule_id, n, pos, hit, hit_pos, unnest(range(greatest(0, hit - (n - pos)), least(pos, hit) + 1)) AS x FROM {source}), "
        f"{name} AS (SELECT rule_id, least(1.0::DOUBLE, sum(exp({log_pmf('x')})) FILTER ({log_pmf('x')} <= {log_pmf('hit_pos')} + 1e-7::DOUBLE)) AS p_value "
        f"FROM {name}0 GROUP BY rule_id, n, pos, hit, hit_pos)"
    )


WHOLE_SQL = f"c AS ({counts_sql('risk')})"


@query(
    "e2_fisher_exact",
    f"WITH {RISK_SQL}, {WHOLE_SQL}, {fisher_sql('c')} SELECT rule_id, {r6('p_value')} AS p_value FROM fisher",
)
def _(spark, sf):
    counts = rule_counts(risk(spark, sf), RULES, "target")
    p = fisher_p("n", "pos", "hit", "hit_pos")
    return rounded(counts.select("rule_id", p.alias("p_value")))


@query("e3_lift_interval")
def _(spark, sf):
    counts = rule_counts(risk(spark, sf), RULES, "target")
    return counts.withColumn("ci", lift_interval("n", "pos", "hit", "hit_pos")).select(
        "rule_id", "ci.lower", "ci.upper"
    )


# --- G. validation ----------------------------------------------------------------------------


def counted(spark, sf):
    return validation.validation_counts(parts(spark, sf), RULES, ROLES)


COUNTED_SQL = f"""{TIME_SPLIT_SQL}, months_ AS (SELECT *, strftime(snapshot_date, '%Y-%m') AS month FROM parts),
 vc AS ({counts_sql('months_', '"partition", segment, month')}),
 tr AS (SELECT rule_id, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum(hit)::BIGINT AS hit, sum(hit_pos)::BIGINT AS hit_pos FROM vc WHERE "partition" = 'train' GROUP BY 1),
 te AS (SELECT rule_id, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum(hit)::BIGINT AS hit, sum(hit_pos)::BIGINT AS hit_pos FROM vc WHERE "partition" = 'test' GROUP BY 1),
 sl AS (SELECT "partition", rule_id, 'segment' AS slice_type, segment AS slice_value, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, sum(hit)::BIGINT AS hit, sum(hit_pos)::BIGINT AS hit_pos
   FROM vc GROUP BY 1, 2, 4 HAVING sum(n) >= 100 UNION ALL
   SELECT "partition", rule_id, 'time', month, sum(n)::BIGINT, sum(pos)::BIGINT, sum(hit)::BIGINT, sum(hit_pos)::BIGINT FROM vc GROUP BY 1, 2, 4 HAVING sum(n) >= 100),
 ls AS (SELECT *, {METRICS_SQL} FROM sl WHERE pos > 0 AND pos < n)"""


@query(
    "g1_slice_metrics",
    f"""WITH {COUNTED_SQL} SELECT rule_id, slice_type, slice_value, n, {', '.join(METRIC_NAMES)} FROM ls WHERE "partition" = 'test'""",
)
def _(spark, sf):
    counts = counted(spark, sf)
    both = validation.slice_metrics(counts, "test", "segment", 100).unionByName(
        validation.slice_metrics(counts, "test", "time", 100)
    )
    return rounded(
        both.filter("NOT single_class").select("rule_id", "slice_type", "slice_value", "n", *METRIC_NAMES)
    )


RAW_LIFT = "((CASE WHEN hit > 0 THEN hit_pos::DOUBLE / hit ELSE 0 END) / (pos::DOUBLE / n))"
CONSISTENT_SQL = f"""cons AS (SELECT "partition", rule_id, avg(CASE WHEN {RAW_LIFT} > 1 THEN 1.0::DOUBLE ELSE 0 END) AS segment_consistency, count(*) AS segments
   FROM sl WHERE slice_type = 'segment' AND pos > 0 AND pos < n GROUP BY 1, 2),
 low_ AS (SELECT "partition", rule_id, min({RAW_LIFT}) AS lowest, count(*) AS months FROM sl WHERE slice_type = 'time' AND pos > 0 AND pos < n GROUP BY 1, 2),
 decay AS (SELECT "partition", rule_id, months, CASE WHEN {RAW_LIFT} > 0 THEN greatest(0, ({RAW_LIFT} - lowest) / {RAW_LIFT}) ELSE 0 END AS max_time_decay
   FROM tr JOIN low_ USING (rule_id))"""


@query(
    "g2_segment_consistency",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL} SELECT rule_id, {r6('segment_consistency')} AS segment_consistency, segments FROM cons WHERE "partition" = 'test'""",
)
def _(spark, sf):
    slices = validation.slice_metrics(counted(spark, sf), "test", "segment", 100)
    return rounded(
        validation.segment_consistency(slices).select("rule_id", "segment_consistency", "segments")
    )


@query(
    "g3_time_decay",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL} SELECT rule_id, months, {r6('max_time_decay')} AS max_time_decay FROM decay WHERE "partition" = 'test'""",
)
def _(spark, sf):
    counts = counted(spark, sf)
    slices = validation.slice_metrics(counts, "test", "time", 100)
    return rounded(validation.time_decay(slices, validation.dataset_metrics(counts, "train")))


def cards_of(spark, sf, partition="test"):
    return validation.evidence(counted(spark, sf), config=VALIDATION, partition=partition)


@query(
    "g4_insufficient_samples",
    f"""WITH {COUNTED_SQL}, one AS (SELECT DISTINCT rule_id FROM sl WHERE "partition" = 'test' AND (pos = 0 OR pos = n)),
    {CONSISTENT_SQL} SELECT tr.rule_id, tr.n < 100 OR te.n < 100 OR coalesce(segments, 0) = 0 OR coalesce(months, 0) = 0 OR one.rule_id IS NOT NULL AS insufficient_samples
    FROM tr JOIN te USING (rule_id) LEFT JOIN (SELECT * FROM cons WHERE "partition" = 'test') k USING (rule_id)
    LEFT JOIN (SELECT * FROM decay WHERE "partition" = 'test') d USING (rule_id) LEFT JOIN one USING (rule_id)""",
)
def _(spark, sf):
    return cards_of(spark, sf)[0].select("rule_id", "insufficient_samples")


TRAIN_P_SQL = f"""{fisher_sql('tr')}, bh AS (SELECT *, row_number() OVER (ORDER BY p_value, rule_id) AS k, count(*) OVER () AS m FROM fisher),
 adj AS (SELECT rule_id, p_value, least(1.0::DOUBLE, min(p_value * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS adjusted_p_value FROM bh)"""


@query(
    "g5_grades",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL}, {TRAIN_P_SQL}, g AS (SELECT te.rule_id, {RAW_LIFT} * 0.9::DOUBLE AS low, adjusted_p_value, segment_consistency, max_time_decay,
      (SELECT max(CASE WHEN {RAW_LIFT} > 1 THEN 1 ELSE 0 END) FROM sl s WHERE s.rule_id = te.rule_id AND "partition" = 'test' AND slice_type = 'segment') AS up
      FROM te JOIN adj USING (rule_id) JOIN (SELECT * FROM cons WHERE "partition" = 'test') k USING (rule_id)
      JOIN (SELECT * FROM decay WHERE "partition" = 'test') d USING (rule_id))
    SELECT rule_id, CASE WHEN adjusted_p_value > 0.05::DOUBLE OR low <= 1 THEN 'Suspicious' WHEN max_time_decay > 0.3::DOUBLE THEN 'Unstable'
      WHEN segment_consistency < 0.6::DOUBLE AND up = 1 THEN 'Local' ELSE 'Stable' END AS grade FROM g""",
)
def _(spark, sf):
    # The interval is random, so this query grades against 90% of the lift instead.
    cards, _ = cards_of(spark, sf)
    fixed = cards.withColumns(
        {"lift_lower": F.col("lift") * 0.9, "insufficient_samples": F.lit(False)}
    )
    return fixed.select("rule_id", validation.grade_column(VALIDATION).alias("grade"))


@query(
    "g6_evidence",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL}, {TRAIN_P_SQL} SELECT te.rule_id, te.n AS test_n, te.hit AS support_count, {r6(RAW_LIFT)} AS lift,
    {r6('p_value')} AS p_value, {r6('adjusted_p_value')} AS adjusted_p_value, {r6('segment_consistency')} AS segment_consistency, {r6('max_time_decay')} AS max_time_decay
    FROM te JOIN adj USING (rule_id) JOIN (SELECT * FROM cons WHERE "partition" = 'test') k USING (rule_id) JOIN (SELECT * FROM decay WHERE "partition" = 'test') d USING (rule_id)""",
)
def _(spark, sf):
    cards, _ = cards_of(spark, sf)
    return rounded(
        cards.select(
            "rule_id", "test_n", "support_count", "lift", "p_value", "adjusted_p_value",
            "segment_consistency", "max_time_decay",
        )
    )


@query(
    "g7_attach_holdout",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL}, one AS (SELECT "partition", rule_id, count(*) AS c FROM sl WHERE pos = 0 OR pos = n GROUP BY 1, 2)
    SELECT rule_id, {r6('min(segment_consistency)')} AS segment_consistency, {r6('max(max_time_decay)')} AS max_time_decay,
    2 + coalesce((SELECT CAST(sum(c) AS BIGINT) FROM one WHERE one.rule_id = cons.rule_id AND "partition" <> 'train'), 0) AS limitations
    FROM cons JOIN decay USING ("partition", rule_id) WHERE "partition" <> 'train' GROUP BY rule_id""",
)
def _(spark, sf):
    counts = counted(spark, sf)
    cards, slices = validation.evidence(counts, config=VALIDATION)
    held, _ = validation.evidence(counts, config=VALIDATION, partition="holdout")
    merged, _ = validation.attach_holdout(cards, slices, held)
    return rounded(
        merged.select(
            "rule_id", "segment_consistency", "max_time_decay",
            F.size("limitations").cast("long").alias("limitations"),
        )
    )


@query(
    "g8_limitation_downgrade",
    f"""WITH {COUNTED_SQL} SELECT rule_id, 'Suspicious' AS grade,
    'Holdout partition is empty; validation unavailable' AS first_limitation FROM te""",
)
def _(spark, sf):
    cards, _ = cards_of(spark, sf)
    marked = validation.with_limitation(cards, validation.HOLDOUT_EMPTY, downgrade=True)
    return marked.select("rule_id", "grade", F.col("limitations")[0].alias("first_limitation"))


def as_local(spark, sf):
    cards, slices = cards_of(spark, sf)
    return cards.withColumn("grade", F.when(F.col("rule_id") == "disc", "Local").otherwise("Stable")), slices


LOCAL_SQL = f"""{COUNTED_SQL}, lc AS (SELECT slice_value AS segment, {RAW_LIFT} AS l, hit FROM sl
   WHERE "partition" = 'test' AND slice_type = 'segment' AND rule_id = 'disc' AND {RAW_LIFT} > 1),
 lt AS (SELECT segment, 'tok_' || substring(sha256('institution:' || segment), 1, 16) AS institution_token, l, hit FROM lc),
 lp AS (SELECT *, row_number() OVER (ORDER BY l DESC, hit DESC, institution_token) AS place FROM lt)"""


@query(
    "g9_local_candidates",
    f"""WITH {LOCAL_SQL} SELECT segment, institution_token, {r6('l')} AS global_lift, hit AS global_support, place,
    CASE WHEN place > 3 THEN 'local institution discovery limit reached' END AS status FROM lp""",
)
def _(spark, sf):
    return rounded(validation.local_candidates(*as_local(spark, sf), limit=3))


@query(
    "g10_local_gates",
    f"""WITH {LOCAL_SQL}, gc AS (SELECT segment, count(*) FILTER ("partition" = 'train') AS a, count(*) FILTER ("partition" = 'test') AS b FROM parts GROUP BY 1)
    SELECT segment, a AS train_rows, b AS test_rows, CASE WHEN place > 5 OR a < 2000 OR b < 2000 THEN 'blocked' ELSE 'completed' END AS status FROM lp JOIN gc USING (segment)""",
)
def _(spark, sf):
    candidates = validation.local_candidates(*as_local(spark, sf))
    gates = validation.local_gates(candidates, parts(spark, sf), ROLES, 2000)
    return gates.select("segment", "train_rows", "test_rows", "status")


def local_quantile(p: float) -> str:
    pos = f"((n - 1) * {p!r}::DOUBLE)"
    lo = f"max(CASE WHEN i = CAST(floor{pos} AS BIGINT) THEN x END)"
    hi = f"max(CASE WHEN i = CAST(ceil{pos} AS BIGINT) THEN x END)"
    return f"{lo} + ({hi} - {lo}) * (max{pos} - floor(max{pos}))"


BEST_FIRST = "lift DESC, hit DESC, expression DESC"
LOCAL_RULES_SQL = f"""{LOCAL_SQL}, gt AS (SELECT segment, count(*) FILTER ("partition" = 'train') AS tn, CAST(sum(target) FILTER ("partition" = 'train') AS BIGINT) AS tp,
   count(*) FILTER ("partition" = 'test') AS un, CAST(sum(target) FILTER ("partition" = 'test') AS BIGINT) AS up FROM parts GROUP BY 1),
 seg AS (SELECT segment, institution_token, tn, tp, un, up, CAST(ceil(tn * 0.05) AS BIGINT) AS low, CAST(floor(tn * 0.95) AS BIGINT) AS high FROM lp JOIN gt USING (segment)
   WHERE tn >= 100 AND un >= 100 AND tp BETWEEN 1 AND tn - 1 AND up BETWEEN 1 AND un - 1),
 numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM parts JOIN (SELECT segment FROM seg) USING (segment) WHERE "partition" IN ('train', 'test')),
 lg AS MATERIALIZED ({' UNION ALL '.join(f"""SELECT rid, "partition" AS side, segment, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, target FROM numbered WHERE {c} IS NOT NULL AND isfinite({c})""" for c in FEATURE_NAMES)}),
 rk AS (SELECT segment, feature, x, row_number() OVER (PARTITION BY segment, feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY segment, feature) AS n FROM lg WHERE side = 'train'),
 qs AS (SELECT segment, feature, {', '.join(f'{local_quantile(p)} AS q{i}' for i, p in enumerate(discovery.THRESHOLD_PROBS))} FROM rk GROUP BY 1, 2 HAVING min(x) < max(x)),
 thr AS ({' UNION '.join(f'SELECT segment, feature, q{i} AS t FROM qs' for i in range(5))}),
 hits AS (SELECT side, segment, feature, t, count(*) FILTER (x <= t) AS lo, CAST(coalesce(sum(target) FILTER (x <= t), 0) AS BIGINT) AS lob,
   count(*) FILTER (x > t) AS hi, CAST(coalesce(sum(target) FILTER (x > t), 0) AS BIGINT) AS hib FROM lg JOIN thr USING (segment, feature) GROUP BY 1, 2, 3, 4),
 sides AS (SELECT side, segment, feature, t, '<=' AS op, lo AS hit, lob AS hit_pos FROM hits UNION ALL SELECT side, segment, feature, t, '>', hi, hib FROM hits),
 singles AS (SELECT segment, feature, t, op, hit, hit_pos, {LIFT_SQL} AS lift, {JSON_SQL} AS expression FROM sides JOIN seg USING (segment) WHERE side = 'train' AND hit BETWEEN low AND high),
 best AS (SELECT * FROM singles QUALIFY row_number() OVER (PARTITION BY segment ORDER BY {BEST_FIRST}) <= 10),
 placed AS (SELECT *, row_number() OVER (PARTITION BY segment, feature ORDER BY {BEST_FIRST}) AS place FROM singles),
 beam AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY place, feature) AS k FROM placed QUALIFY k <= 20),
 on_ AS MATERIALIZED (SELECT rid, side, target, b.segment, k FROM lg JOIN beam b ON lg.segment = b.segment AND lg.feature = b.feature AND ((op = '<=' AND x <= t) OR (op = '>' AND x > t))),
 pc AS (SELECT a.segment, a.side, a.k AS i, b.k AS j, count(*) AS hit, CAST(sum(a.target) AS BIGINT) AS hit_pos FROM on_ a JOIN on_ b ON a.rid = b.rid AND a.k < b.k GROUP BY 1, 2, 3, 4),
 pj AS (SELECT pc.segment, i, j, pc.hit, pc.hit_pos, CASE WHEN l.feature < r.feature THEN l.expression ELSE r.expression END AS e1,
   CASE WHEN l.feature < r.feature THEN r.expression ELSE l.expression END AS e2, least(l.feature, r.feature) || '+' || greatest(l.feature, r.feature) AS fp
   FROM pc JOIN beam l ON l.segment = pc.segment AND l.k = i JOIN beam r ON r.segment = pc.segment AND r.k = j
   WHERE side = 'train' AND l.feature <> r.feature AND pc.hit <> l.hit AND pc.hit <> r.hit),
 pairs AS (SELECT segment, i, j, hit, hit_pos, fp, {LIFT_SQL} AS lift, rtrim(e1, ']') || ',' || ltrim(e2, '[') AS expression FROM pj JOIN seg USING (segment) WHERE hit >= low),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY segment, fp ORDER BY {BEST_FIRST}) AS f FROM pairs),
 picked AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY segment ORDER BY (f = 1) DESC, {BEST_FIRST}) <= 5),
 both_ AS (SELECT b.segment, b.expression, b.hit, b.lift, s.hit AS uh, s.hit_pos AS uhp FROM best b JOIN sides s ON s.side = 'test' AND s.segment = b.segment AND s.feature = b.feature AND s.t = b.t AND s.op = b.op
   UNION ALL SELECT p.segment, p.expression, p.hit, p.lift, coalesce(c.hit, 0), coalesce(c.hit_pos, 0) FROM picked p LEFT JOIN pc c ON c.side = 'test' AND c.segment = p.segment AND c.i = p.i AND c.j = p.j)"""


@query(
    "g10_local_rules",
    f"""WITH {LOCAL_RULES_SQL} SELECT institution_token, substring(sha256(expression), 1, 12) AS rule_id, hit AS train_support_count, {r6('lift')} AS train_lift,
    uh AS support_count, {r6('(CASE WHEN uh > 0 THEN uhp::DOUBLE / uh ELSE 0 END) / (up::DOUBLE / un)')} AS lift FROM both_ JOIN seg USING (segment)""",
)
def _(spark, sf):
    cards, slices = as_local(spark, sf)
    # The SQL has no tree search, so this query goes by quantiles alone.
    reports, local = validation.local_rules(
        parts(spark, sf), cards, slices, FEATURE_NAMES, ROLES,
        discovery=DiscoveryConfig(tree_cuts=False, max_single_rules=10, max_pair_rules=5),
        config=VALIDATION,
    )
    found = local.join(reports.select("segment", "institution_token"), "segment")
    return rounded(
        found.select("institution_token", "rule_id", "train_support_count", "train_lift", "support_count", "lift")
    )


@query(
    "g11_candidate_summary",
    f"""WITH {SINGLES_SQL}, {BEAM_SQL}, {PAIR_SQL}, {PICK_SQL}, best AS (SELECT * FROM singles ORDER BY lift DESC, hit DESC, expression DESC LIMIT 100),
    both_ AS (SELECT expression, lift, hit, 'single' AS rule_type FROM best UNION ALL SELECT expression, lift, hit, 'two_condition' FROM picked),
    ids AS (SELECT substring(sha256(expression), 1, 12) AS rule_id, lift, hit, rule_type FROM both_),
    ranked AS (SELECT *, 'top_rules' AS list, row_number() OVER (ORDER BY lift DESC, hit DESC, rule_id) AS rank FROM ids UNION ALL
      SELECT *, 'top_two_condition_rules', row_number() OVER (ORDER BY lift DESC, hit DESC, rule_id) FROM ids WHERE rule_type = 'two_condition')
    SELECT rule_id, {r6('lift')} AS lift, hit AS support_count, rule_type, list, rank FROM ranked WHERE rank <= 5""",
)
def _(spark, sf):
    found = discovery.discover(train(spark, sf), FEATURE_NAMES, "target", CONFIG)
    validation.require_confirmed(found.rules, FEATURE_NAMES)
    return rounded(validation.candidate_summary(found).drop("origin"))


@query(
    "g12_evidence_summary",
    f"""WITH {COUNTED_SQL}, l AS (SELECT rule_id, {RAW_LIFT} AS lift, hit, CASE WHEN rule_id IN ('qtybal', 'seg') THEN 'two_condition' WHEN rule_id = 'all' THEN 'multi_condition' ELSE 'single' END AS rule_type FROM te),
    ranked AS (SELECT *, 'top_rules' AS list, row_number() OVER (ORDER BY lift DESC, hit DESC, rule_id) AS rank FROM l UNION ALL
      SELECT *, 'top_two_condition_rules', row_number() OVER (ORDER BY lift DESC, hit DESC, rule_id) FROM l WHERE rule_type = 'two_condition')
    SELECT rule_id, {r6('lift')} AS lift, hit AS support_count, rule_type, list, rank FROM ranked WHERE rank <= 3""",
)
def _(spark, sf):
    cards, _ = cards_of(spark, sf)
    rules = rules_frame(spark, [r for r in RULES if r.rule_id != "seg"]).unionByName(
        # The rule on a text column has no numeric condition table form.
        rules_frame(spark, [r for r in RULES if r.rule_id == "qtybal"]).withColumn("rule_id", F.lit("seg"))
    )
    out = validation.evidence_summary(cards, rules, 3).filter(F.col("list") != "stable_top_rules")
    return rounded(out.drop("grade"))


@query(
    "g12_grade_counts",
    f"WITH {COUNTED_SQL} SELECT count(*) - 1 AS \"Stable\", CAST(1 AS BIGINT) AS \"Local\", CAST(0 AS BIGINT) AS \"Unstable\", CAST(0 AS BIGINT) AS \"Suspicious\" FROM te",
)
def _(spark, sf):
    return validation.grade_counts(as_local(spark, sf)[0])


@query(
    "g12_segment_directions",
    f"""WITH {COUNTED_SQL} SELECT rule_id, 'tok_' || substring(sha256('institution:' || slice_value), 1, 16) AS institution_token,
    CASE WHEN {RAW_LIFT} > 1 THEN 'positive' ELSE 'non_positive' END AS direction, hit AS support_count, {r6(RAW_LIFT)} AS lift
    FROM sl WHERE "partition" = 'test' AND slice_type = 'segment'""",
)
def _(spark, sf):
    return rounded(validation.segment_directions(cards_of(spark, sf)[1]))


@query(
    "g13_reason_codes",
    f"""WITH {COUNTED_SQL}, {CONSISTENT_SQL}, {TRAIN_P_SQL}, one AS (SELECT DISTINCT rule_id FROM sl WHERE "partition" = 'test' AND (pos = 0 OR pos = n)),
    g AS (SELECT te.rule_id, te.hit, {RAW_LIFT} * 0.9::DOUBLE AS low, adjusted_p_value, segment_consistency, max_time_decay, one.rule_id IS NOT NULL AS one_class,
      (SELECT max(CASE WHEN {RAW_LIFT} > 1 THEN 1 ELSE 0 END) FROM sl s WHERE s.rule_id = te.rule_id AND "partition" = 'test' AND slice_type = 'segment') AS up
      FROM te JOIN adj USING (rule_id) JOIN (SELECT * FROM cons WHERE "partition" = 'test') k USING (rule_id)
      JOIN (SELECT * FROM decay WHERE "partition" = 'test') d USING (rule_id) LEFT JOIN one USING (rule_id))
    SELECT rule_id, concat_ws(',', CASE WHEN adjusted_p_value > 0.05::DOUBLE THEN 'adjusted_p_value_above_alpha' END,
      CASE WHEN low <= 1 THEN 'lift_ci_lower_not_above_one' END, CASE WHEN hit < 100 OR one_class THEN 'insufficient_samples' END,
      CASE WHEN max_time_decay > 0.3::DOUBLE THEN 'time_decay_above_limit' END,
      CASE WHEN segment_consistency < 0.6::DOUBLE AND up = 1 THEN 'low_segment_consistency' END) AS reason_codes,
      CASE WHEN one_class THEN 'label_performance_window_unknown,single_class_slice' ELSE 'label_performance_window_unknown' END AS limitation_codes FROM g""",
)
def _(spark, sf):
    cards, slices = cards_of(spark, sf)
    fixed = cards.withColumn("lift_lower", F.col("lift") * 0.9)
    codes = validation.reason_codes(fixed, slices, VALIDATION, time_enabled=True)
    return codes.select(
        "rule_id",
        F.array_join("reason_codes", ",").alias("reason_codes"),
        F.array_join("limitation_codes", ",").alias("limitation_codes"),
    )


@query(
    "a6_evidence_sink",
    f"""WITH {COUNTED_SQL}, nested AS (SELECT rule_id, count(*) AS slices, min('segment-' || substring(sha256(slice_value), 1, 8)) FILTER (slice_type = 'segment') AS first_segment
      FROM sl WHERE "partition" = 'test' AND slice_type = 'segment' AND pos > 0 AND pos < n GROUP BY 1)
    SELECT te.rule_id, CASE WHEN te.rule_id = 'disc' THEN 'Local' ELSE 'Stable' END AS grade, slices, first_segment FROM te JOIN nested USING (rule_id)""",
)
def _(spark, sf):
    cards, slices = as_local(spark, sf)
    out = evidence_output(cards, slices, time_enabled=False)
    return out.select(
        "rule_id",
        "grade",
        F.size("slices").cast("long").alias("slices"),
        F.array_min(F.transform("slices", lambda s: s["slice_value"])).alias("first_segment"),
    )
