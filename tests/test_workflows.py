import pytest
from pyspark.sql import functions as F

from scorewatch.operators import contract, injection, monitoring, split, validation
from scorewatch.plans import workflows
from scorewatch.roles import GRADES, DiscoveryConfig, Features, Roles, ValidationConfig

ROLES = Roles("entity_id", "snapshot_date", "segment", "target")
FEATURES = Features({"fam": ("f_",)})
SMALL = DiscoveryConfig(max_single_rules=6, max_pair_rules=4, beam_width=6, tree_cuts=False)
CONFIG = ValidationConfig(bootstrap_rounds=100, min_group_size=50)


@pytest.fixture(scope="module")
def analysis(planted):
    return workflows.analyse(
        planted, ROLES, FEATURES, dataset_id="demo", discovery=SMALL, config=CONFIG
    )


def test_analysis_grades_every_rule(analysis):
    cards = {r.rule_id: r for r in analysis.cards.collect()}
    assert set(cards) == {r.rule_id for r in analysis.discovery.rules}
    assert {r.grade for r in cards.values()} <= set(GRADES)
    best = cards[analysis.discovery.rules[0].rule_id]
    assert best.lift > 1.5 and "label performance window unknown" in best.limitations
    assert [r.usable for r in analysis.gates.collect()] == [True, True, True]
    assert analysis.profile.first().row_count == 8000


def test_local_rules_run_only_where_gates_pass(analysis, planted):
    parts = split.time_split(planted, "snapshot_date")
    cards = analysis.cards.withColumn("grade", F.lit("Local"))
    reports, local = validation.local_rules(
        parts, cards, analysis.slices, ["f_a", "f_b", "f_c"], ROLES,
        discovery=SMALL, config=ValidationConfig(bootstrap_rounds=100, min_group_size=300),
    )
    status = {r.segment: (r.status, r.rule_count) for r in reports.collect()}
    assert status["A"][0] == "completed" and status["A"][1] > 0
    assert status["C"] == ("blocked", None)
    assert {r.segment for r in local.select("segment").distinct().collect()} == {
        s for s, (state, n) in status.items() if state == "completed" and n
    }


def test_nothing_is_local_without_local_cards(analysis):
    cards = analysis.cards.withColumn("grade", F.lit("Stable"))
    assert validation.local_candidates(cards, analysis.slices).count() == 0


def test_monitor_and_scores(planted, spark):
    specs = contract.feature_catalog(spark, ["f_a", "f_b", "f_c"], FEATURES.families)
    snapshot = monitoring.build_snapshot(
        planted, ROLES, ["f_a", "f_b", "f_c"], dataset_id="demo", min_group_size=50, catalog=specs
    )
    s = injection.Scenario("label", "label_shift", "target", 1.0)
    out = workflows.monitor(snapshot, injection.inject(planted, s))
    assert [(r.alert_type, r.severity) for r in out["alerts"].collect()] == [("label", "critical")]
    (action,) = out["recommendations"].collect()
    assert (action.action_code, action.priority) == ("investigate_target_shift", "critical")
    truth = injection.truth_frame(
        planted.sparkSession, [("label", "label", "demo", "target", "target")]
    )
    tag = lambda df: df.withColumn("scenario_id", F.lit("label"))
    score = injection.alert_scores(tag(out["alerts"]), truth, tag(out["root_causes"])).first()
    assert (score.precision, score.recall, score.top_k_root_cause_hit) == (1.0, 1.0, 1.0)
