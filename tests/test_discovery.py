import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.operators import discovery, split, validation
from scorewatch.roles import DiscoveryConfig, Roles, Rule, ValidationConfig

FEATURES = ["f_a", "f_b", "f_c"]
ROLES = Roles("entity_id", "snapshot_date", "segment", "target")


def test_support_bounds_are_decimal():
    assert discovery.support_bounds(100, 0.07) == (7, 93)
    assert discovery.support_bounds(101, 0.05) == (6, 95)


def test_rule_identity_is_canonical():
    a = Rule.of(("b", ">", 1e-05), ("a", "<=", 2.0))
    b = Rule.of(("a", "<=", 2.0), ("b", ">", 1e-05))
    assert a.rule_id == b.rule_id and [c.feature for c in a.conditions] == ["a", "b"]


@pytest.fixture(scope="module")
def found(planted):
    return discovery.discover(planted, FEATURES, "target", DiscoveryConfig(max_single_rules=20))


def test_planted_rules_are_found(found):
    assert found.rules[0].conditions[0].feature == "f_a"
    cuts = [r.conditions[0].value for r in found.rules if r.conditions[0].operator == ">"]
    assert min(abs(c - 0.8) for c in cuts) < 0.02
    pairs = [{c.feature for c in r.conditions} for r in found.rules if len(r.conditions) == 2]
    assert {"f_b", "f_c"} in pairs and found.pairs_selected == len(pairs)


def test_discovery_ignores_row_order(planted, found):
    again = discovery.discover(planted.repartition(9), FEATURES, "target", DiscoveryConfig(max_single_rules=20))
    assert again.rules == found.rules


def test_counts_equal_direct_evaluation(planted, found):
    direct = {
        r["rule_id"]: (r["hit"], r["hit_pos"])
        for r in validation.rule_counts(planted, found.rules, "target").collect()
    }
    for r in found.frame.collect():
        assert direct[r["rule_id"]] == (r["hit"], r["hit_pos"])


def test_pair_counts_against_brute_force(planted):
    beam = [Rule.of(("f_a", ">", round(i / 70, 4))) for i in range(65)] + [Rule.of(("f_b", "<=", 0.5))]
    pdf = planted.select("f_a", "f_b", "target").toPandas()
    on = np.array([pdf["f_a"] > r.conditions[0].value for r in beam[:65]] + [pdf["f_b"] <= 0.5])
    got = {(r.i, r.j): (r.hit, r.hit_pos) for r in discovery.pair_counts(planted, beam, "target").collect()}
    assert len(got) == 66 * 65 // 2
    for i, j in itertools.islice(itertools.combinations(range(66), 2), 0, None, 37):
        both = on[i] & on[j]
        assert got[(i, j)] == (both.sum(), (both & (pdf["target"] == 1)).sum())


def brute_tree(x, y, leaf):
    def split(ix):
        order = ix[np.argsort(x[ix], kind="stable")]
        best = (-np.inf, None)
        if y[ix].min() == y[ix].max():
            return None
        for k in range(leaf, len(order) - leaf + 1):
            a, b = x[order[k - 1]], x[order[min(k, len(order) - 1)]]
            if k == len(order) or b <= a + 1e-7:
                continue
            parts = (order[:k], order[k:])
            gain = sum((y[p].sum() ** 2 + (len(p) - y[p].sum()) ** 2) / len(p) for p in parts)
            if gain > best[0] + 1e-9:
                best = (gain, a / 2 + b / 2)
        return best[1]

    every = np.arange(len(x))
    root = split(every)
    found = [root]
    for side in (every[x <= root], every[x > root]):
        t = split(side)
        if t is not None:
            found.append(t)
    return sorted(found)


def test_tree_thresholds_against_brute_force(planted):
    small = planted.limit(600)
    pdf = small.select("f_a", "f_c", "target").toPandas()
    frame = planted.sparkSession.createDataFrame(pdf)
    got = discovery.tree_thresholds(frame, ["f_a", "f_c"], "target", 30)
    for f in ("f_a", "f_c"):
        x = pdf[f].to_numpy().astype(np.float32).astype(np.float64)
        assert got[f] == pytest.approx(brute_tree(x, pdf["target"].to_numpy(), 30))


def test_one_class_and_infinite_features_give_nothing(planted):
    assert discovery.discover(planted.filter("target = 0"), FEATURES, "target").rules == ()
    broken = planted.withColumn("f_a", F.when(F.col("f_a") > 0.99, float("inf")).otherwise(F.col("f_a")))
    usable = discovery.eligible_features(broken, FEATURES).filter("eligible").collect()
    assert {r.feature for r in usable} == {"f_b", "f_c"}


def test_grades(planted, found):
    parts = split.time_split(planted, "snapshot_date")
    counts = validation.validation_counts(parts, found.rules, ROLES)
    cards, slices = validation.validate(counts, config=ValidationConfig(bootstrap_rounds=100, min_group_size=50))
    rows = {r.rule_id: r for r in cards.collect()}
    best = rows[found.rules[0].rule_id]
    assert best.grade in ("Stable", "Unstable") and best.lift_lower > 1 and best.adjusted_p_value < 0.01
    assert all(r.adjusted_p_value >= r.p_value - 1e-15 for r in rows.values())
    assert slices.filter("slice_value = 'Holdout'").count() == len(found.rules)


@pytest.mark.parametrize(
    "adjusted, low, thin, decay, share, grade",
    [
        (0.06, 2.0, False, 0.0, 1.0, "Suspicious"),
        (0.01, 1.0, False, 0.0, 1.0, "Suspicious"),
        (0.01, 2.0, True, 0.0, 1.0, "Suspicious"),
        (0.01, 2.0, False, 0.31, 0.1, "Unstable"),
        (0.01, 2.0, False, 0.3, 0.5, "Local"),
        (0.01, 2.0, False, 0.3, 0.6, "Stable"),
    ],
)
def test_grade_precedence(spark, adjusted, low, thin, decay, share, grade):
    df = spark.createDataFrame(
        [(adjusted, low, thin, decay, share, 1)],
        "adjusted_p_value double, lift_lower double, insufficient_samples boolean, "
        "max_time_decay double, segment_consistency double, any_lift int",
    )
    assert df.select(validation.grade_column(ValidationConfig())).first()[0] == grade


CONFIGS = (
    DiscoveryConfig(max_single_rules=15, max_pair_rules=6, beam_width=8),
    DiscoveryConfig(max_single_rules=8, max_pair_rules=3, beam_width=70, tree_cuts=False, boosted_cuts=True, balanced=True),
)


@pytest.mark.parametrize("config", CONFIGS)
def test_groups_equal_separate_searches(planted, config):
    columns = ["rule_id", "origin", "expression", "n", "pos", "hit", "hit_pos", "lift"]
    rows = planted.withColumn("segment", F.when(F.col("f_c") < 5, F.col("segment")))
    one_class = F.when(F.col("segment") == "C", 0).otherwise(F.col("target"))
    rows = rows.withColumn("target", one_class)
    found = discovery.discover_groups(rows, "segment", FEATURES, "target", config).collect()
    assert {r["g"] for r in found} == {"A", "B", "None"}
    for g in ("A", "B", "None"):
        own = rows.filter(F.coalesce("segment", F.lit("None")) == g)
        want = [tuple(r) for r in discovery.discover(own, FEATURES, "target", config).frame.select(*columns).collect()]
        assert sorted(tuple(r[c] for c in columns) for r in found if r["g"] == g) == sorted(want)


def test_jobs_do_not_grow_with_the_groups(planted):
    context = planted.sparkSession.sparkContext

    def jobs(rows, name):
        context.setJobGroup(name, name)
        try:
            discovery.discover_groups(rows, "segment", FEATURES, "target", CONFIGS[0])
            return len(context.statusTracker().getJobIdsForGroup(name))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    many = planted.withColumn("segment", F.concat("segment", (F.col("f_c") % 3).cast("string")))
    one = jobs(planted.filter("segment = 'A'"), "one-group")
    # Rounds of the quantiles depend on the values; a search for every group would need nine times as many.
    assert jobs(many, "nine-groups") < 2 * one


def test_one_round_of_boosting_by_hand():
    n, bad = np.full(4, 10.0), np.array([0.0, 5.0, 5.0, 10.0])
    # Residuals are -5, 0, 0, 5: the first split is after the first range, the second before the last one.
    assert discovery.boosted_cuts(n, bad, trees=1, rate=0.1) == [1, 3]
    assert discovery.boosted_cuts(n, np.array([0.0, 0.0, 10.0, 10.0]), trees=1, rate=0.1) == [2]
    assert discovery.boosted_cuts(n, np.zeros(4), trees=5, rate=0.1) == []


def test_boosted_cuts_find_the_step(planted):
    found = discovery.boosted_thresholds(planted, FEATURES, "target")
    assert min(abs(t - 0.8) for t in found["f_a"]) < 0.02
    assert set(found) <= set(FEATURES)
