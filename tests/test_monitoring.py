import dataclasses
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from scorewatch.operators import findings, injection, monitoring, remediation
from scorewatch.operators.contract import feature_catalog, profile, window_inversions
from scorewatch.roles import ContractError, Features, Roles

ROLES = Roles("entity_id", "snapshot_date", "segment", "target")
FEATURES = ["f_a", "f_b", "f_c"]


@pytest.fixture(scope="module")
def snapshot(planted, spark):
    specs = feature_catalog(spark, FEATURES, {"fam": ("f_",)})
    return monitoring.build_snapshot(
        planted, ROLES, FEATURES, dataset_id="demo", min_group_size=50, catalog=specs
    )


def alerts(snapshot, current):
    return {(r.alert_type, r.scope_value): r for r in monitoring.detect(snapshot, current).collect()}


def test_same_data_raises_nothing(snapshot, planted):
    assert alerts(snapshot, planted) == {}
    psi = monitoring.psi_floored(snapshot, planted).collect()
    assert all(r.psi == pytest.approx(0.0) for r in psi)


def test_every_alert_type(snapshot, planted):
    now = planted.withColumns(
        {
            "f_a": F.when(F.col("f_a") > 0.5, F.col("f_a")),
            "target": F.lit(1),
            "segment": F.when(F.col("segment") == "B", "Z").otherwise(F.col("segment")),
        }
    ).drop("f_c")
    got = alerts(snapshot, now)
    assert {k for k in got} == {
        ("missingness", "f_a"), ("distribution", "f_a"), ("schema", "f_c"),
        ("label", "demo"), ("population", "B"), ("population", "Z"),
    }
    assert got[("population", "B")].current_value == 0.0
    key = "schema|feature|f_c|column"
    assert got[("schema", "f_c")].alert_id == hashlib.sha256(key.encode()).hexdigest()[:12]


def test_small_segments_are_left_out(snapshot, planted):
    tiny = planted.limit(30).withColumn("segment", F.lit("tiny"))
    assert ("population", "tiny") not in alerts(snapshot, planted.unionByName(tiny))


def test_injection_is_detected_and_explained(snapshot, planted, spark):
    s = injection.Scenario("m", "missingness", "f_a", 0.9, segment="A")
    now = injection.inject(planted, s).cache()
    assert now.count() == planted.count()
    found = spark.createDataFrame(*(lambda d: (d.collect(), d.schema))(monitoring.detect(snapshot, now)))
    assert found.filter("alert_type = 'missingness' AND scope_value = 'f_a'").count() == 1
    causes = monitoring.root_causes(found, snapshot, now, top_k=3)
    mine = causes.join(found.filter("scope = 'feature' AND alert_type = 'missingness'"), "alert_id")
    first = mine.filter("rank = 1").select("dimension", "value").first()
    assert tuple(first) == ("segment", "A")


@pytest.mark.parametrize("share", [0.0, 0.1, 0.33])
def test_oversampling_is_exact_with_copies(planted, spark, share):
    copies = spark.createDataFrame([("A", 1)] * 500 + [("B", i) for i in range(700)], "segment string, i int")
    s = injection.Scenario("p", "population_shift", "segment", share, segment="A")
    got = {r.segment: r["count"] for r in injection.inject(copies, s).groupBy("segment").count().collect()}
    assert got == {"A": 500 + round(1200 * share), "B": 700}


PATHS = [
    "/tmp/x", "a%2Fb", "a%252fb", "C:data", "c%3Adata", "%43:data", "file:x", "%66ILE%3Ax", "a\\b", "a%5Cb",
]
PLAIN = ["demo-1", "ab:c", "50% off", "profile:x", "x%2", "%41"]


def test_path_like_identifiers_are_rejected(planted, spark):
    df = spark.createDataFrame([(x,) for x in PATHS + PLAIN], "x string")
    found = [r.p for r in df.select(monitoring.path_like(F.col("x")).alias("p")).collect()]
    assert found == [True] * len(PATHS) + [False] * len(PLAIN)
    with pytest.raises(ContractError):
        monitoring.build_snapshot(planted.limit(5), ROLES, [FEATURES[0]], dataset_id="a%2Fb")
    few = spark.createDataFrame([("a%2Fb",), ("ok",), ("ok",)], "segment string")
    with pytest.raises(Exception, match="path-like segment"):
        monitoring.reference_segments(few, "segment", 2).collect()
    rules = spark.createDataFrame([("/x/y", 0.1, 0.2, 1.5)], "rule_id string, coverage double, hit_bad_rate double, lift double")
    with pytest.raises(Exception, match="path-like rule"):
        monitoring.reference_rules(rules).collect()


def test_a_saved_snapshot_gives_the_same_alerts(snapshot, planted, spark, tmp_path):
    monitoring.save_snapshot(snapshot, f"{tmp_path}/snapshot")
    again = monitoring.load_snapshot(spark, f"{tmp_path}/snapshot")
    assert again == snapshot and again.rules is None
    assert monitoring.snapshot_id(again).first() == monitoring.snapshot_id(snapshot).first()
    now = planted.withColumn("f_a", F.when(F.col("segment") != "A", F.col("f_a")))
    rows = [sorted(map(str, monitoring.detect(s, now).collect())) for s in (snapshot, again)]
    assert rows[0] == rows[1] and rows[0]


def test_feature_catalog(spark):
    names = ["ord_amt_sum_30d", "ord_pay_cnt_7d", "cust_num_avg_90d_x", "cust_rate_amt", "other_30days", "ord_"]
    rows = {r.feature: tuple(r)[1:] for r in feature_catalog(spark, names, {"order": ("ord_",), "customer": ("cust_", "c_")}).collect()}
    assert rows == {
        "ord_amt_sum_30d": ("order", 30, "amt_sum", "amount", False),
        "ord_pay_cnt_7d": ("order", 7, "pay_cnt", "count", True),
        "cust_num_avg_90d_x": ("customer", 90, "num_avg_x", "count", False),
        "cust_rate_amt": ("customer", None, "rate_amt", "ratio", False),
        "other_30days": ("unknown", None, "other_30days", "numeric", False),
        "ord_": ("order", None, "", "numeric", False),
    }


def test_psi_closed_form(spark):
    df = spark.createDataFrame(
        [("reference", x) for x in (0.0, 0.0, 1.0, 1.0)] + [("current", 1.0)] * 4, "period string, x double"
    )
    (r,) = findings.psi_additive(findings.period_bins(df, {"x": [0.5]})).collect()
    e = 1e-6
    ref, cur = [(2 + e) / (4 + 2 * e)] * 2, [e / (4 + 2 * e), (4 + e) / (4 + 2 * e)]
    assert r.psi == pytest.approx(sum((c - p) * math.log(c / p) for p, c in zip(ref, cur)))


def test_finding_identity(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0)], "e int, x double").select(
        "*", F.lit("2024-01-01").alias("d"), F.lit(0).alias("t"), F.lit("s").alias("s")
    )
    rows = findings.identified(findings.quality_findings(df, Roles("e", "d", "s", "t"), ["x"])).collect()
    by_code = {r.code: r for r in rows}
    assert set(by_code) == {"missing_values", "constant_feature", "duplicate_entity_snapshot"}
    payload = {
        "code": "missing_values", "feature": "x", "kind": "data_quality", "limitations": [],
        "metrics": {"affected_count": 1, "affected_rate": 0.5}, "period": None,
        "segment_token": None, "severity": "critical",
    }
    text = json.dumps(payload, separators=(",", ":"), sort_keys=True)
    assert by_code["missing_values"].finding_id == hashlib.sha256(text.encode()).hexdigest()


def test_time_findings(spark):
    rows = [("2024-01-05", 0)] * 100 + [("2024-02-05", 1)] * 20 + [("2024-02-06", 0)] * 20 + [("bad", 1)]
    df = spark.createDataFrame(rows, "d string, t int")
    few = findings.time_findings(df, "d", "t").collect()
    assert [r.code for r in few] == ["insufficient_time_data"] and few[0].metrics["sample_count"] == 141
    got = {r.code: r for r in findings.time_findings(df, "d", "t", min_months=2).collect()}
    assert got["monthly_target_rate_change"].metrics["rate_shift"] == pytest.approx(0.5)
    assert got["monthly_sample_drop"].severity == "critical"


def test_profile_contract(spark):
    ok = [("e", "2024-01-01", "s", 1, 3, 2)]
    schema = "entity_id string, snapshot_date string, segment string, target int, order_cnt_7d int, order_cnt_30d int"
    features = Features({"order": ("order_",)})
    df = spark.createDataFrame(ok, schema)
    assert profile(df, ROLES, features, dataset_id="d").first().feature_count == 2
    broken = window_inversions(df, feature_catalog(spark, features.select(df.columns, ROLES), features.families))
    assert broken.first().affected_rows == 1
    for change in ({"target": F.lit(2)}, {"snapshot_date": F.lit("n/a")}, {"target": F.lit(None).cast("int")}):
        with pytest.raises(Exception, match="column"):
            profile(df.withColumns(change), ROLES, features, dataset_id="d").collect()


def test_retest_rules(spark):
    schema = "kind string, severity string, code string, feature string, period string, segment_token string, metrics map<string,double>"
    before = findings.identified(
        spark.createDataFrame(
            [
                ("feature_drift", "critical", "a", "x", None, None, {"psi": 0.5}),
                ("feature_drift", "critical", "b", "x", None, None, {"psi": 0.5}),
                ("feature_drift", "critical", "c", "x", None, None, {}),
                ("feature_drift", "critical", "d", "x", None, None, {}),
            ],
            schema,
        )
    )
    after = findings.identified(
        spark.createDataFrame(
            [
                ("feature_drift", "critical", "b", "x", None, None, {"psi": 0.6}),
                ("feature_drift", "warning", "c", "x", None, None, {}),
                ("feature_drift", "critical", "d", "x", None, None, {}),
            ],
            schema,
        )
    )
    opened = remediation.open_remediations(remediation.recommendations(before))
    codes = before.select("finding_id", "code")

    def outcome(**kw):
        got = remediation.retest(opened, before, after, **kw).join(codes, "finding_id").collect()
        return {r.code: r.outcome for r in got}

    assert outcome() == {"a": "resolved", "b": "remaining", "c": "resolved", "d": "inconclusive"}
    assert outcome(reference_severity_rule=True)["c"] == "inconclusive"
    done = remediation.verifications(remediation.retest(opened, before, after))
    state = remediation.apply_verifications(opened, done).first()
    assert state.status == "failed" and state.remediation_id != opened.first().remediation_id


def test_report_limitations(spark):
    df = spark.createDataFrame([("e", "2024-01-01", "s", 0, k) for k in range(4)], "entity_id string, snapshot_date string, segment string, target int, k int")
    with_time = df.withColumn("snapshot_date", F.format_string("2024-0%d-01", F.col("k") + 1))
    assert findings.report_limitations(with_time, ROLES, grade="A") == []
    assert findings.report_limitations(with_time, ROLES) == ["label_performance_window_unknown"]
    off = findings.report_limitations(df, ROLES, time_enabled=False, grade="A")
    assert off == ["time_monitoring_disabled", "insufficient_drift_reference"]
    ordered = findings.report_limitations(df, ROLES, time_enabled=False, order_by="k", grade="A")
    assert ordered == ["time_monitoring_disabled"]
    wide = with_time.withColumn("x", F.col("k").cast("double"))
    report = findings.diagnostic_report(wide, ROLES, ["x"], time_enabled=False, order_by="k", min_group_size=1)
    assert report.limitations == ("time_monitoring_disabled", "label_performance_window_unknown")
    assert report.findings.columns == findings.diagnose(wide, ROLES, ["x"], min_group_size=1).columns


def test_unreadable_cells_are_counted(spark, tmp_path):
    from scorewatch.sources.tables import read_history_csv, unreadable_cells

    text = "SK_ID_CURR,DAYS_CREDIT,AMT_CREDIT_SUM,AMT_CREDIT_SUM_DEBT,CREDIT_ACTIVE,MORE\n1,-5,10.5,,Active,x\n2,five,1e3,n/a,Closed,y\n,-1,bad,2,,z\n"
    (tmp_path / "bureau.csv").write_text(text)
    path = str(tmp_path / "bureau.csv")
    got = {r["column"]: (r["row_count"], r["unreadable"]) for r in unreadable_cells(spark, path, "bureau").collect()}
    assert got == {"SK_ID_CURR": (3, 0), "DAYS_CREDIT": (3, 1), "AMT_CREDIT_SUM": (3, 1), "AMT_CREDIT_SUM_DEBT": (3, 1), "CREDIT_ACTIVE": (3, 0)}
    assert [r["DAYS_CREDIT"] for r in read_history_csv(spark, path, "bureau").collect()] == [-5, None, -1]


def test_backtest_equals_one_scenario_after_another(planted):
    from scorewatch.functions.expr import small_table

    names = ["f_a", "f_b", "f_c"]
    roles = ROLES
    snapshot = monitoring.build_snapshot(planted, roles, names, dataset_id="demo", min_group_size=50)
    scenarios = injection.standard_scenarios("f_a", "B", "rule-1")
    scenarios.append(injection.Scenario("lost", "schema", "segment", 1.0))
    rules = planted.sparkSession.createDataFrame([("rule-1", 3.0)], "rule_id string, lift double")
    snapshot = dataclasses.replace(snapshot, rules=rules)
    got = {r["scenario_id"]: r.asDict() for r in injection.backtest(planted, snapshot, scenarios, rules).collect()}
    assert set(got) == {s.scenario_id for s in scenarios}
    for s in scenarios:
        now = injection.inject(planted, s).cache()
        current = rules.withColumn("lift", F.lit(1.0 if s.drift_type == "rule_decay" else 3.0))
        alerts = small_table(monitoring.detect(snapshot, now, current))
        causes = monitoring.root_causes(alerts, snapshot, now)
        (row,) = injection.truth_rows([s])
        scope = {"population_shift": s.segment, "label_shift": "demo"}.get(s.drift_type, row[2])
        truth = injection.truth_frame(planted.sparkSession, [(row[0], row[1], scope, row[3], row[4])])
        tag = F.lit(s.scenario_id).alias("scenario_id")
        want = injection.alert_scores(alerts.select(tag, "*"), truth, causes.select(tag, "*")).first().asDict()
        assert got[s.scenario_id] == pytest.approx(want), s.scenario_id


def test_all_alerts_read_the_table_once(planted):
    roles = ROLES
    snapshot = monitoring.build_snapshot(planted, roles, ["f_a", "f_b"], dataset_id="demo", min_group_size=50)
    segments = planted.sparkSession.createDataFrame(snapshot.segments.collect(), snapshot.segments.schema)
    snapshot = dataclasses.replace(snapshot, segments=segments)
    known = monitoring.facts(snapshot, planted)
    for made in (monitoring.detect(snapshot, planted, known=known), monitoring.root_causes(monitoring.detect(snapshot, planted, known=known), snapshot, planted, known=known)):
        assert "InMemoryTableScan" not in made._jdf.queryExecution().executedPlan().toString()
    assert known.counts.count() <= 4 * 3 * 6
