"""Queries for scorecards and history features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded
from scorewatch.operators import history, scorecard
from scorewatch.plans.queries_rules import train
from scorewatch.plans.queries_core import RULES, TIME_SPLIT_SQL, quantile_sql
from scorewatch.plans.registry import query
from scorewatch.plans.views import FEATURE_NAMES, RISK_SQL, r6, risk, table

# --- H. scorecards ------------------------------------------------------------------------

FIFTHS = [0.2, 0.4, 0.6, 0.8]
EDGES_SQL = (
    f"{TIME_SPLIT_SQL}, train AS (SELECT * FROM parts WHERE \"partition\" = 'train'), {quantile_sql('train', FEATURE_NAMES, FIFTHS)}, "
    "cut AS (SELECT DISTINCT feature, e FROM ("
    + " UNION ALL ".join(f"SELECT feature, q{i} AS e, min_value, max_value FROM qs" for i in range(4))
    + ") WHERE e > min_value AND e < max_value), "
    "ed AS (SELECT feature, list(e ORDER BY e) AS es FROM cut GROUP BY feature)"
)


@query(
    "h1_initial_edges",
    f"WITH {EDGES_SQL} SELECT feature, {r6('e')} AS edge FROM cut",
)
def _(spark, sf):
    edges = scorecard.initial_edges(train(spark, sf), FEATURE_NAMES, 5)
    return rounded(
        spark.createDataFrame(
            [(f, e) for f, cuts in edges.items() for e in cuts], "feature string, edge double"
        )
    )


@query(
    "h1_few_valued_edges",
    f"""WITH {RISK_SQL}, v AS (SELECT DISTINCT line_no AS e FROM risk)
    SELECT 'line_no' AS feature, CAST(e AS DOUBLE) AS edge FROM v WHERE e > (SELECT min(e) FROM v) AND e < (SELECT max(e) FROM v)""",
)
def _(spark, sf):
    edges = scorecard.initial_edges(risk(spark, sf), ["line_no"], 10)
    return spark.createDataFrame([("line_no", e) for e in edges["line_no"]], "feature string, edge double")


BINS_SQL = (
    f"{EDGES_SQL}, lb AS (SELECT l.feature, len(list_filter(es, lambda e: e < x)) AS bin, target FROM lng l JOIN ed USING (feature)), "
    "bs AS (SELECT feature, bin, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad FROM lb GROUP BY 1, 2)"
)


@query("h2_bin_counts", f"WITH {BINS_SQL} SELECT feature, bin, n, bad FROM bs")
def _(spark, sf):
    df = train(spark, sf)
    edges = scorecard.initial_edges(df, FEATURE_NAMES, 5)
    bins = scorecard.bin_stats(df, edges, "target")
    return bins.select("feature", F.col("bin").cast("long").alias("bin"), "n", "bad")


@query("h3_h4_merged_bins")
def _(spark, sf):
    df = train(spark, sf)
    bins = scorecard.bin_stats(df, scorecard.initial_edges(df, FEATURE_NAMES, 20), "target")
    return scorecard.merged_bins(bins, 0.08, "auto")


_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, -1 AS bin, count(*) AS n, CAST(sum(target) AS BIGINT) AS bad FROM train WHERE {c} IS NULL OR NOT isfinite({c})"
    for c in FEATURE_NAMES
)
WOE_SQL = (
    f"{BINS_SQL}, wb AS (SELECT * FROM bs UNION ALL SELECT * FROM ({_MISSING}) WHERE n > 0), "
    "wd AS (SELECT *, (n - bad + 0.5::DOUBLE) / (sum(n - bad) OVER w + 0.5::DOUBLE * count(*) OVER w) AS gd, "
    "(bad + 0.5::DOUBLE) / (sum(bad) OVER w + 0.5::DOUBLE * count(*) OVER w) AS bd FROM wb WINDOW w AS (PARTITION BY feature)), "
    "woe AS (SELECT feature, bin, n, bad, ln(gd / bd) AS woe, (gd - bd) * ln(gd / bd) AS iv FROM wd)"
)


def fifths(spark, sf):
    """Five quantile bins per feature: none is small enough to be merged."""
    df = train(spark, sf)
    return df, scorecard.fit_woe(df, FEATURE_NAMES, "target", max_bins=5)


@query(
    "h5_woe_models",
    f"WITH {WOE_SQL} SELECT feature, count(*) FILTER (bin >= 0) AS bins, {r6('sum(iv)')} AS iv, {r6('sum(woe) FILTER (bin >= 0)')} AS woe_sum, "
    f"{r6('coalesce(max(woe) FILTER (bin = -1), 0)')} AS missing_woe, {r6('sum(bad::DOUBLE / n) FILTER (bin >= 0)')} AS rate_sum FROM woe GROUP BY feature",
)
def _(spark, sf):
    _, models = fifths(spark, sf)
    rows = [
        (m.feature, len(m.woe), m.iv, sum(m.woe), m.missing_woe, sum(m.bad_rates)) for m in models
    ]
    return rounded(
        spark.createDataFrame(
            rows,
            "feature string, bins long, iv double, woe_sum double, missing_woe double, rate_sum double",
        )
    )


@query(
    "h6_woe_transform",
    f"WITH {WOE_SQL}, lt AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, segment, CASE WHEN {c} IS NOT NULL AND isfinite({c}) THEN CAST({c} AS DOUBLE) END AS x FROM risk" for c in FEATURE_NAMES
    ) + f"), lw AS (SELECT l.feature, segment, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(es, lambda e: e < x)) END AS bin FROM lt l JOIN ed USING (feature)) "
    f"SELECT feature, segment, {r6('sum(coalesce(woe, 0))')} AS woe_sum FROM lw LEFT JOIN woe USING (feature, bin) GROUP BY 1, 2",
)
def _(spark, sf):
    _, models = fifths(spark, sf)
    table_ = scorecard.design(risk(spark, sf), models, [], "segment")
    names = {f"x{i}": m.feature for i, m in enumerate(models)}
    sums = table_.groupBy("segment").agg(*[F.sum(x).alias(f) for x, f in names.items()])
    return rounded(sums.unpivot(["segment"], list(names.values()), "feature", "woe_sum"))


@query("h7_scorecard_fit")
def _(spark, sf):
    card = scorecard.fit_scorecard(
        train(spark, sf), FEATURE_NAMES, "target", RULES[:2], min_iv=0.001, weighting="class_weight"
    )
    return spark.createDataFrame(
        list(zip(["intercept", *card.labels], [card.intercept, *card.coefficients])),
        "label string, coefficient double",
    )


# A small fixed scorecard, so that scoring can be stated in SQL.
CARD = scorecard.Scorecard(
    (
        scorecard.WoeModel("ord_disc", (0.03, 0.07), (0.4, 0.25, -0.9), (), (), 0.0, None, 0.1, "none"),
        scorecard.WoeModel("ord_tax", (0.02, 0.05), (0.1, 0.0, -0.1), (), (), 0.3, None, 0.1, "none"),
    ),
    (RULES[1],),
    (-1.1, -0.7, 2.2),
    -1.2,
    "disabled",
    (0, 0),
)
CARD_SQL = f"""{RISK_SQL}, parts_ AS (SELECT *, -1.1::DOUBLE * (CASE WHEN ord_disc <= 0.03::DOUBLE THEN 0.4::DOUBLE WHEN ord_disc <= 0.07::DOUBLE THEN 0.25::DOUBLE ELSE -0.9::DOUBLE END) AS c0,
 -0.7::DOUBLE * (CASE WHEN ord_tax IS NULL THEN 0.3::DOUBLE WHEN ord_tax <= 0.02::DOUBLE THEN 0.1::DOUBLE WHEN ord_tax <= 0.05::DOUBLE THEN 0 ELSE -0.1::DOUBLE END) AS c1,
 CASE WHEN ord_qty > 30 AND cust_bal < 2000 THEN 2.2::DOUBLE ELSE 0 END AS c2 FROM risk),
 scored AS (SELECT *, 1 / (1 + exp(-(-1.2::DOUBLE + c0 + c1 + c2))) AS p FROM parts_)"""


@query(
    "h8_scores",
    f"""WITH {CARD_SQL} SELECT entity_id, line_no, part_id, supplier_id, {r6('p')} AS probability, round({r6('p * 1000')}, 3) AS risk_score,
    CASE WHEN p < 0.25::DOUBLE THEN 'low' WHEN p < 0.5::DOUBLE THEN 'medium' WHEN p < 0.75::DOUBLE THEN 'high' ELSE 'critical' END AS risk_level FROM scored""",
)
def _(spark, sf):
    scored = scorecard.score(risk(spark, sf), CARD)
    keys = ["entity_id", "line_no", "part_id", "supplier_id"]
    out = rounded(scored.select(*keys, "probability", "risk_score", "risk_level"))
    return out.withColumn("risk_score", F.round("risk_score", 3))


@query(
    "h9_reason_codes",
    f"""WITH {CARD_SQL}, r AS (SELECT list_sort([{{'s': -abs(c0), 'i': 0, 'l': 'ord_disc'}}, {{'s': -abs(c1), 'i': 1, 'l': 'ord_tax'}}, {{'s': -abs(c2), 'i': 2, 'l': 'rule:qtybal'}}]) AS a FROM scored),
    t AS (SELECT list_transform(list_filter(a[1:2], lambda z: z.s <> 0), lambda z: z.l) AS reasons FROM r)
    SELECT array_to_string(reasons, ',') AS reasons, count(*) AS row_count FROM t GROUP BY 1""",
)
def _(spark, sf):
    scored = scorecard.score(risk(spark, sf), CARD, top_reason_codes=2)
    return scored.groupBy(F.array_join("reason_codes", ",").alias("reasons")).agg(
        F.count("*").alias("row_count")
    )


# --- J. history features ---------------------------------------------------------------------------

AS_OF = date(2001, 9, 1)


def history_inputs(spark, sf):
    """The provided tables in the shape of the six history tables."""
    orders = table(spark, sf, "orders").withColumn(
        "age", F.datediff(F.col("o_orderdate").cast("date"), F.lit(AS_OF))
    )
    lines = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.datediff(F.col("l_shipdate").cast("date"), F.lit(AS_OF))
    month = F.floor(ship / 30).cast("int")
    entity = F.col("o_custkey").alias("SK_ID_CURR")
    return {
        "application_train": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("SK_ID_CURR"),
            (F.col("c_custkey") % 7 == 0).cast("int").alias("TARGET"),
            F.col("c_mktsegment").alias("NAME_INCOME_TYPE"),
            F.lit(-10000).alias("DAYS_BIRTH"),
            F.col("c_acctbal").alias("AMT_INCOME_TOTAL"),
        ),
        "previous_application": orders.select(
            entity,
            F.col("age").alias("DAYS_DECISION"),
            F.col("o_totalprice").alias("AMT_APPLICATION"),
            F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") * 0.8).alias("AMT_CREDIT"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Refused").otherwise("Approved").alias(
                "NAME_CONTRACT_STATUS"
            ),
        ),
        "installments_payments": lines.select(
            entity,
            ship.cast("double").alias("DAYS_INSTALMENT"),
            F.when(F.col("l_partkey") % 19 != 0, ship + F.col("l_linenumber") - 3.0).alias(
                "DAYS_ENTRY_PAYMENT"
            ),
            F.col("l_extendedprice").alias("AMT_INSTALMENT"),
            F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice") * 0.5)
            .otherwise(F.col("l_extendedprice"))
            .alias("AMT_PAYMENT"),
        ),
        "POS_CASH_balance": lines.select(
            entity,
            month.alias("MONTHS_BALANCE"),
            F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber")).alias("SK_DPD"),
            F.lit(0).alias("SK_DPD_DEF"),
        ),
        "credit_card_balance": lines.select(
            entity,
            month.alias("MONTHS_BALANCE"),
            (F.col("l_extendedprice") - 30000).alias("AMT_BALANCE"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("AMT_PAYMENT_CURRENT"),
            F.col("l_linenumber").alias("SK_DPD"),
        ),
        "bureau": orders.select(
            entity,
            F.col("age").alias("DAYS_CREDIT"),
            (F.col("o_totalprice") - 200000).alias("AMT_CREDIT_SUM"),
            (F.col("o_totalprice") * 0.5).alias("AMT_CREDIT_SUM_DEBT"),
            F.when(F.col("o_orderstatus") == "O", "Active").otherwise("Closed").alias("CREDIT_ACTIVE"),
        ),
    }


HISTORY_SQL = """oo AS (SELECT *, date_diff('day', DATE '2001-09-01', CAST(o_orderdate AS DATE)) AS age FROM orders),
 ll AS (SELECT *, date_diff('day', DATE '2001-09-01', CAST(l_shipdate AS DATE)) AS ship FROM lineitem JOIN oo ON l_orderkey = o_orderkey),
 prev AS (SELECT o_custkey AS k, age, o_totalprice AS amt, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice * 0.8::DOUBLE END AS credit, o_orderpriority = '1-URGENT' AS refused FROM oo),
 inst AS (SELECT o_custkey AS k, ship AS age, CASE WHEN l_partkey % 19 <> 0 THEN greatest(l_linenumber - 3, 0)::DOUBLE END AS late, l_discount > 0.05::DOUBLE AND l_extendedprice > 0 AS under FROM ll),
 pos AS (SELECT o_custkey AS k, CAST(floor(ship / 30.0::DOUBLE) AS INTEGER) AS age, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber END AS dpd FROM ll),
 cc AS (SELECT o_custkey AS k, CAST(floor(ship / 30.0::DOUBLE) AS INTEGER) AS age, l_extendedprice - 30000 AS bal, l_extendedprice * l_tax AS pay, l_linenumber AS dpd FROM ll),
 bur AS (SELECT o_custkey AS k, age, o_totalprice - 200000 AS lim, o_totalprice * 0.5::DOUBLE AS debt, o_orderstatus = 'O' AS act FROM oo)"""


def window_sql(source: str, windows, suffix: str, columns: dict[str, str], extra: str = "") -> str:
    """SQL text: one aggregate per window, full joined on the entity."""
    base = f"(SELECT DISTINCT k FROM {source}) b"
    joins, cols = [], []
    for w in windows:
        parts = ", ".join(f"{sql} AS {name}_{w}{suffix}" for name, sql in columns.items())
        joins.append(f"LEFT JOIN (SELECT k, {parts} FROM {source} WHERE age >= -{w} GROUP BY k) w{w} USING (k)")
        cols += [f"{name}_{w}{suffix}" for name in columns]
    return f"SELECT k AS entity_id, {', '.join(cols)}{extra} FROM {base} {' '.join(joins)}"


J_SQL = {
    "previous_application": window_sql(
        "prev", (30, 90, 365), "d",
        {
            "prev_application_cnt": "count(*)",
            "prev_application_amt": r6("coalesce(sum(amt), 0)"),
            "prev_credit_amt": r6("coalesce(sum(credit), 0)"),
        },
        f", (SELECT {r6('avg(CASE WHEN refused THEN 1.0::DOUBLE ELSE 0 END)')} FROM prev p WHERE p.k = b.k) AS prev_refused_rate_all",
    ),
    "installments_payments": window_sql(
        "inst", (30, 90, 365), "d",
        {
            "inst_record_cnt": "count(*)",
            "inst_overdue_days_mean": r6("avg(late)"),
            "inst_underpayment_rate": r6("avg(CASE WHEN under THEN 1.0::DOUBLE ELSE 0 END)"),
        },
    ),
    "POS_CASH_balance": window_sql(
        "pos", (3, 6, 12), "m",
        {
            "pos_active_month_cnt": "count(DISTINCT age)",
            "pos_dpd_mean": r6("avg(dpd)"),
            "pos_dpd_max": "max(dpd)",
        },
    ),
    "credit_card_balance": window_sql(
        "cc", (3, 6, 12), "m",
        {
            "cc_balance_mean": r6("avg(bal)"),
            "cc_payment_balance_ratio": r6("CASE WHEN sum(bal) > 0 THEN sum(pay) / sum(bal) END"),
            "cc_dpd_max": "max(dpd)",
        },
    ),
    "bureau": window_sql(
        "bur", (90, 365), "d",
        {
            "bureau_query_cnt": "count(*)",
            "bureau_active_credit_cnt": "count(*) FILTER (act)",
            "bureau_debt_credit_ratio": r6("CASE WHEN sum(lim) > 0 THEN sum(debt) / sum(lim) END"),
        },
    ),
}

for _i, (_name, _sql) in enumerate(J_SQL.items(), start=1):

    @query(f"j{_i}_{_name.lower()}", f"WITH {HISTORY_SQL} {_sql}")
    def _(spark, sf, name=_name):
        return rounded(history.AGGREGATES[name](history_inputs(spark, sf)[name]))


@query(
    "j6_prepared_history",
    f"WITH {HISTORY_SQL}, " + ", ".join(f"a{i} AS ({sql})" for i, sql in enumerate(J_SQL.values()))
    + " SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS target, c_mktsegment AS customer_segment, "
    "'public_relative_reference' AS snapshot_date, a0.* EXCLUDE (entity_id), a1.* EXCLUDE (entity_id), a2.* EXCLUDE (entity_id), "
    "a3.* EXCLUDE (entity_id), a4.* EXCLUDE (entity_id) FROM customer "
    + " ".join(f"LEFT JOIN a{i} ON a{i}.entity_id = c_custkey" for i in range(5)),
)
def _(spark, sf):
    return rounded(history.prepare_history(history_inputs(spark, sf)))
