import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorewatch.functions.expr import bucket_of, rule_column
from scorewatch.functions.ranks import quantile_lists, quantiles, running_totals
from scorewatch.functions.stats import fisher_two_sided, lift_interval, rule_metrics, with_adjusted_p
from scorewatch.operators.metrics import rule_performance, row_weights, score_separation
from scorewatch.roles import Condition, ContractError, Rule


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def hits(spark, rule, values, schema="x double"):
    df = rows(spark, values, schema)
    return [r[0] for r in df.select(rule_column(rule, df.schema)).collect()]


def test_rule_on_null_and_nan(spark):
    values = [(3.0,), (None,), (float("nan"),), (1.0,)]
    assert hits(spark, Rule("r", (Condition("x", ">", 2),)), values) == [True, False, False, False]
    assert hits(spark, Rule("r", (Condition("x", "!=", 3),)), values) == [False, False, False, True]
    assert hits(spark, Rule("r", (Condition("x", "is_null"),)), values) == [False, True, False, False]
    assert hits(spark, Rule("r", ()), values) == [True] * 4


def test_rule_on_text_and_quotes(spark):
    rule = Rule("r", (Condition("x", "==", "it's"),))
    assert hits(spark, rule, [("it's",), ("its",), (None,)], "x string") == [True, False, False]


@pytest.mark.parametrize("closed", ["left", "right"])
def test_bucket_matches_searchsorted(spark, closed):
    cuts = [0.0, 1.0, 1.5, 7.0]
    xs = [-1.0, 0.0, 0.5, 1.0, 1.2, 1.5, 7.0, 9.0]
    df = rows(spark, [(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(bucket_of("x", cuts, closed=closed)).collect()]
    side = "right" if closed == "left" else "left"
    assert got == list(np.searchsorted(cuts, xs, side=side))


def test_rule_metrics_by_hand(spark):
    df = rows(spark, [(1, 1), (1, 1), (0, 1), (0, 0), (0, 0), (0, 0)], "target int, f int")
    (m,) = rule_performance(df, [Rule("r", (Condition("f", ">", 0.5),))], "target").collect()
    assert (m.support_count, m.coverage, m.recall) == (3, 0.5, 1.0)
    assert m.hit_bad_rate == pytest.approx(2 / 3) and m.lift == pytest.approx(2.0)
    assert m.ks_signed == pytest.approx(2 / 3 - 1 / 4)


def test_metrics_without_goods_or_positives(spark):
    counts = rows(spark, [(4, 4, 2, 2), (4, 0, 2, 0)], "n long, pos long, hit long, hit_pos long")
    full, none = rule_metrics(counts).orderBy(F.desc("pos")).collect()
    assert full.ks_signed is None and none.lift is None


def brute_fisher(a, b, c, d):
    n, k, m = a + b + c + d, a + c, a + b
    lo, hi = max(0, m - (n - k)), min(k, m)
    pmf = [math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(lo, hi + 1)]
    return min(1.0, sum(p for p in pmf if p <= pmf[a - lo] * (1 + 1e-7)))


def test_fisher_against_brute_force():
    for table in itertools.product((0, 1, 3, 8, 20), repeat=4):
        if sum(table):
            assert fisher_two_sided(*table) == pytest.approx(brute_fisher(*table), rel=1e-9, abs=1e-300)


def test_fisher_on_huge_tables_is_fast_and_sane():
    assert fisher_two_sided(10**9, 10**9, 10**9, 10**9) == pytest.approx(1.0)
    assert fisher_two_sided(6 * 10**8, 10**9, 10**9, 2 * 10**9) < 1e-100
    near = fisher_two_sided(50_000_000 + 5_000, 50_000_000, 50_000_000, 50_000_000 + 5_000)
    assert 0 < near < 1


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = rows(spark, [(f"r{i}", v) for i, v in enumerate(p)], "rule_id string, p_value double")
    got = {r.rule_id: r.adjusted_p_value for r in with_adjusted_p(df).collect()}
    assert got == pytest.approx({"r0": 0.04, "r1": 0.04 * 4 / 3, "r2": 0.04 * 4 / 3, "r3": 0.5})


def test_lift_interval_repeats_and_covers(spark):
    df = rows(spark, [(10_000, 1_000, 2_000, 500)], "n long, pos long, hit long, hit_pos long")
    column = lift_interval("n", "pos", "hit", "hit_pos", rounds=400)
    first, second = (df.select(column.alias("c")).first().c for _ in range(2))
    assert first == second and first.lower < 2.5 < first.upper


def test_score_separation(spark):
    values = [(0.9, 1), (0.8, 1), (float("nan"), 0), (0.1, 0), (0.2, 0)]
    df = rows(spark, values, "s double, t int")
    r = score_separation(df, "s", "t").first()
    assert (r.statistic, r.signed_statistic, r.excluded_count) == (1.0, 1.0, 1)
    low = score_separation(df, "s", "t", direction="lower_is_bad").first()
    assert low.signed_statistic == -1.0
    one = score_separation(rows(spark, [(0.1, 1), (None, 1)], "s double, t int"), "s", "t").first()
    assert one.statistic is None and one.limitation == "single_class_or_no_finite_scores"


def test_score_separation_with_many_values(spark):
    rng = np.random.default_rng(1)
    s, t = rng.normal(size=5000).round(3), rng.integers(0, 2, 5000)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "t": t}))
    grid = np.unique(s)
    bad, good = np.sort(s[t == 1]), np.sort(s[t == 0])
    gap = np.searchsorted(good, grid, "right") / len(good) - np.searchsorted(bad, grid, "right") / len(bad)
    r = score_separation(df, "s", "t").first()
    assert r.statistic == pytest.approx(np.abs(gap).max())
    assert r.signed_statistic == pytest.approx(gap[np.argmax(np.abs(gap))])


@pytest.mark.parametrize("ranges", [(64, 512), (1, 2), (3, 7)])
def test_quantiles_equal_numpy(spark, monkeypatch, ranges):
    from scorewatch.functions import ranks

    monkeypatch.setattr(ranks, "RANGES_PER_DOUBLING", ranges[0])
    monkeypatch.setattr(ranks, "RANGES_PER_ROUND", ranges[1])
    rng = np.random.default_rng(3)
    n = 4000
    data = {
        "smooth": rng.normal(size=n),
        "hot": np.where(rng.uniform(size=n) < 0.4, 5.0, rng.exponential(size=n).round(2)),
        "few": rng.integers(0, 3, n).astype(float),
        "flat": np.full(n, 2.5),
        "holes": np.where(rng.uniform(size=n) < 0.3, np.nan, rng.uniform(size=n)),
    }
    if ranges[1] > 2:
        data["close"] = 1e6 + rng.integers(0, 50, n) * 2.0**-30
        data["wide"] = np.sign(rng.normal(size=n)) * 10.0 ** rng.integers(-320, 308, n)
    data["holes"][0] = np.inf
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = quantile_lists(quantiles(df, list(data), probs))
    for name, values in data.items():
        finite = values[np.isfinite(values)]
        assert got[name]["n"] == len(finite)
        assert (got[name]["min"], got[name]["max"]) == (finite.min(), finite.max())
        assert got[name]["q"] == pytest.approx(list(np.quantile(finite, probs)), rel=1e-12)


def test_quantiles_by_group_and_few_values(spark):
    from scorewatch.functions.ranks import few_values

    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000), "x": rng.normal(size=3000), "k": rng.integers(0, 5, 3000) * 0.1})
    df = spark.createDataFrame(pdf)
    for r in quantiles(df, ["x", "k"], [0.25, 0.5], by="g").collect():
        own = pdf.loc[pdf["g"] == r["g"], r["feature"]]
        assert r["n_finite"] == len(own) and list(r["q"]) == pytest.approx(list(own.quantile([0.25, 0.5])))
    assert few_values(df, ["x", "k"], 5) == {"k": sorted(pdf["k"].unique())}
    assert few_values(df, ["x", "k"], 4) == {}


def test_quantiles_of_tiny_and_empty_columns(spark):
    df = rows(spark, [(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    got = quantile_lists(quantiles(df, ["a", "b"], [0.25, 0.5]))
    assert got["a"]["q"] == [1.5, 2.0] and "b" not in got


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_running_totals_cross_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pdf = pd.DataFrame({"f": rng.choice(["a", "b", "c", None], 500, p=[0.9, 0.05, 0.03, 0.02]), "v": rng.permutation(500), "n": rng.integers(0, 5, 500), "w": rng.uniform(size=500)})
        got = running_totals(spark.createDataFrame(pdf).repartition(5), by=["f"], order=["v"], sums=["n", "w"], following="v").toPandas()
        assert len(got) == 500
        for _, own in got.sort_values("v").groupby("f", dropna=False):
            assert list(own["cum_n"]) == list(own["n"].cumsum())
            assert list(own["cum_w"]) == pytest.approx(list(own["w"].cumsum()))
            assert list(own["next_v"])[:-1] == list(own["v"])[1:] and own["next_v"].isna().iloc[-1]
        whole = running_totals(spark.createDataFrame(pdf), order=["v"], sums=["n"], following="v").toPandas().sort_values("v")
        assert list(whole["cum_n"]) == list(pdf.sort_values("v")["n"].cumsum())
        assert list(whole["next_v"])[:-1] == list(range(1, 500))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_class_weights(spark):
    df = rows(spark, [(1,), (0,), (0,), (0,)], "t int")
    got = {r.t: r.weight for r in row_weights(df, "t").collect()}
    assert got == {1: 2.0, 0: pytest.approx(2 / 3)}
    with pytest.raises(ContractError):
        row_weights(rows(spark, [(1,), (1,)], "t int"), "t")


def test_ks_chance_is_exact_for_small_samples():
    from itertools import combinations

    from scorewatch.functions.stats import ks_exact

    assert abs(ks_exact(0.6, 5, 5) - 0.35714285714285715) < 1e-12
    for d, m, n in ((0.5, 4, 6), (1.0, 2, 2), (0.4, 3, 5), (0.75, 4, 4)):
        found = 0
        for places in combinations(range(m + n), m):
            ones = [int(k in places) for k in range(m + n)]
            far = max(
                abs(sum(ones[:k]) / m - (k - sum(ones[:k])) / n) for k in range(1, m + n + 1)
            )
            found += far >= d - 1e-12
        assert abs(ks_exact(d, m, n) - found / math.comb(m + n, m)) < 1e-12


def test_feature_names_are_never_cut(spark):
    from scorewatch.functions.expr import long_bins

    a, b = "f" * 1004 + "a", "f" * 1004 + "b"
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 6.0)], f"{a} double, {b} double")
    rows = long_bins(df, {a: [1.5], b: [5.5]}).groupBy("feature", "bin").count().collect()
    assert {(r["feature"], r["bin"]) for r in rows} == {(x, k) for x in (a, b) for k in (0, 1)}
