"""Queries for sinks, streams and the whole workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded
from scorewatch.operators import history, retrieval
from scorewatch.operators.monitoring import FeatureReference
from scorewatch.plans import workflows
from scorewatch.plans.queries_models import HISTORY_SQL, J_SQL, history_inputs
from scorewatch.plans.queries_monitor import both_periods, current_rules
from scorewatch.plans.queries_rules import VALIDATION
from scorewatch.plans.queries_text import CORPUS_SQL, corpus
from scorewatch.plans.registry import query
from scorewatch.plans.views import FEATURES, RISK_SQL, ROLES, r6, risk, stored, table
from scorewatch.roles import Rule
from scorewatch.sources.scratch import scratch_path
from scorewatch.sources.tables import read_history_csv, unreadable_cells, write_table
from scorewatch.streaming import monitor as streaming


@query("a2_history_csv", f"WITH {HISTORY_SQL} {J_SQL['bureau']}")
def _(spark, sf):
    path = scratch_path(spark, "bureau")
    wide = history_inputs(spark, sf)["bureau"].withColumn("UNUSED", F.lit("x"))
    wide.write.option("header", True).csv(path)
    return rounded(history.bureau_records(read_history_csv(spark, path, "bureau")))


@query(
    "a2_unreadable_cells",
    """WITH n AS (SELECT count(*) AS row_count, count(*) FILTER (o_custkey % 13 = 0) AS bad, count(*) FILTER (o_custkey % 7 = 0) AS late FROM orders)
    SELECT row_count, 'SK_ID_CURR' AS "column", CAST(0 AS BIGINT) AS unreadable FROM n UNION ALL SELECT row_count, 'DAYS_CREDIT', late FROM n
    UNION ALL SELECT row_count, 'AMT_CREDIT_SUM', bad FROM n UNION ALL SELECT row_count, 'AMT_CREDIT_SUM_DEBT', 0 FROM n UNION ALL SELECT row_count, 'CREDIT_ACTIVE', 0 FROM n""",
)
def _(spark, sf):
    path = scratch_path(spark, "bureau")
    rows = history_inputs(spark, sf)["bureau"]
    texts = {c: F.col(c).cast("string") for c in rows.columns}
    texts["AMT_CREDIT_SUM"] = F.when(F.col("SK_ID_CURR") % 13 == 0, "n/a").otherwise(texts["AMT_CREDIT_SUM"])
    texts["DAYS_CREDIT"] = F.when(F.col("SK_ID_CURR") % 7 == 0, "12 days").otherwise(texts["DAYS_CREDIT"])
    rows.select(*[c.alias(n) for n, c in texts.items()]).write.option("header", True).csv(path)
    return unreadable_cells(spark, path, "bureau")


@query(
    "a3_table_sink",
    f"WITH {RISK_SQL} SELECT segment, count(*) AS row_count, {r6('sum(ord_total)')} AS total FROM risk GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "risk")
    write_table(risk(spark, sf), path)
    back = spark.read.parquet(path)
    return rounded(
        back.groupBy("segment").agg(F.count("*").alias("row_count"), F.sum("ord_total").alias("total"))
    )


@query(
    "n5_scope_replacement",
    f"WITH {CORPUS_SQL} SELECT scope, count(*) AS documents FROM corpus WHERE scope <> 'en' OR length(text) > 1000 GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "corpus")
    documents = corpus(spark, sf)
    retrieval.replace_scope(documents, path)
    long = documents.filter((F.col("scope") == "en") & (F.length("text") > 1000))
    retrieval.replace_scope(long, path)
    return spark.read.parquet(path).groupBy("scope").agg(F.count("*").alias("documents"))


def drained(stream, name: str, mode: str):
    """Run a stream over what is there now; the sink only takes aggregates."""
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(
        availableNow=True
    ).start()
    try:
        running.awaitTermination()  # until all input is read; a failure is raised here
    finally:
        running.stop()
    return stream.sparkSession.table(name)


def read_stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


STREAM_RULES = [
    Rule.of(("l_discount", ">", 0.07)),
    Rule.of(("l_quantity", ">", 30.0), ("l_tax", "<=", 0.03)),
]


@query(
    "s1_stream_flags",
    """SELECT l_returnflag, count(*) AS row_count, count(*) FILTER (l_discount > 0.07::DOUBLE) AS first_hits,
    count(*) FILTER (l_quantity > 30 AND l_tax <= 0.03::DOUBLE) AS second_hits FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    flagged = streaming.flag_and_score(read_stream(spark, sf, "lineitem"), STREAM_RULES)
    a, b = (F.col(f"rule_{r.rule_id}") for r in STREAM_RULES)
    counts = flagged.groupBy("l_returnflag").agg(
        F.count("*").alias("row_count"),
        F.count_if(a).alias("first_hits"),
        F.count_if(b).alias("second_hits"),
    )
    return drained(counts, "stream_flags", "complete")


@query(
    "s2_window_bins",
    """SELECT date_trunc('day', ts) AS window_start, 'value' AS feature, CAST((value >= 20)::INT + (value >= 60)::INT AS BIGINT) AS bin, count(*) AS n
    FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 3""",
)
def _(spark, sf):
    bins = streaming.window_bins(
        read_stream(spark, sf, "events"), "ts", {"value": [0.0, 20.0, 60.0, 1000.0]}
    )
    done = drained(bins, "stream_bins", "append")
    return done.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "feature",
        F.col("bin").cast("long").alias("bin"),
        "n",
    )


@query(
    "s2_window_alerts",
    f"""WITH b AS (SELECT date_trunc('day', ts) AS window_start, (value >= 20)::INT + (value >= 60)::INT AS bin, count(*) AS n FROM events
      WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND isfinite(value) GROUP BY 1, 2),
    w AS (SELECT window_start, sum(n) AS total FROM b GROUP BY 1), g AS (SELECT window_start, total, bin, r FROM w, (VALUES (0, 0.6::DOUBLE), (1, 0.3::DOUBLE), (2, 0.1::DOUBLE)) AS v(bin, r)),
    p AS (SELECT window_start, greatest(coalesce(n, 0)::DOUBLE / total, 1e-6) AS c, r FROM g LEFT JOIN b USING (window_start, bin)),
    s AS (SELECT window_start, sum((c - r) * ln(c / r)) AS psi FROM p GROUP BY 1)
    SELECT window_start, 'value' AS feature, {r6('psi')} AS psi, CASE WHEN abs(psi) >= 0.3 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE abs(psi) >= 0.2""",
)
def _(spark, sf):
    reference = FeatureReference("value", "events", "double", 0.0, 0.0, (0.0, 20.0, 60.0, 1000.0), (60, 30, 10))
    bins = streaming.window_bins(read_stream(spark, sf, "events"), "ts", {"value": reference.edges})
    path = scratch_path(spark, "alerts")
    running = streaming.alert_stream(bins, [reference], path, scratch_path(spark, "alerts-state"))
    try:
        running.awaitTermination()
    finally:
        running.stop()
    schema = "alert_id string, window_start timestamp, feature string, psi double, severity string"
    found = spark.read.schema(schema).parquet(path)
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return rounded(found.select(start, "feature", "psi", "severity"))


@query("w1_analysis")
def _(spark, sf):
    result = workflows.analyse(
        stored(spark, sf), ROLES, FEATURES, dataset_id="risk", config=VALIDATION
    )
    columns = [
        "rule_id", "grade", "test_n", "support_count", "coverage", "lift", "lift_lower", "lift_upper",
        "p_value", "adjusted_p_value", "segment_consistency", "max_time_decay",
    ]
    return rounded(result.cards.select(*columns)).orderBy(F.desc("lift"), "rule_id")


@query("w2_monitoring")
def _(spark, sf):
    snap, now = both_periods(spark, sf)
    out = workflows.monitor(snap, now, current_rules=current_rules(now))
    return out["recommendations"]
