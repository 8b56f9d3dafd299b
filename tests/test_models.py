import math

import numpy as np
import pytest

from scorewatch.operators import scorecard
from scorewatch.operators.history import Window, distinct, mean, rows, sum_ratio, total, window_features
from scorewatch.roles import Condition, Rule


def frame(spark, xs, ts):
    return spark.createDataFrame(list(zip(xs, ts)), "x double, t int")


def test_woe_with_missing_bin(spark):
    df = frame(spark, [10.0, 20.0, None, 40.0, 50.0, 60.0, 70.0, 80.0], [1, 1, 1, 0, 0, 0, 1, 0])
    (m,) = scorecard.fit_woe(df, ["x"], "t", max_bins=4)
    assert m.iv > 0 and len(m.edges) <= 3 and m.missing_bad_rate == 1.0
    good, bad = 4 + 0.5 * (len(m.woe) + 1), 4 + 0.5 * (len(m.woe) + 1)
    assert m.missing_woe == pytest.approx(math.log((0.5 / good) / (1.5 / bad)))
    got = [r[0] for r in df.select(scorecard.woe_column(m)).collect()]
    assert got[2] == m.missing_woe and got[0] == m.woe[0] and got[-1] == m.woe[-1]


def test_monotonic_merge(spark):
    xs = [float(i) for i in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6)]
    ts = [0, 0, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1]
    (m,) = scorecard.fit_woe(frame(spark, xs, ts), ["x"], "t", max_bins=6, monotonic="increasing")
    assert list(m.bad_rates) == sorted(m.bad_rates) and sum(m.bin_counts) == 12


def test_small_bins_merge_with_the_closer_neighbour(spark):
    bins = spark.createDataFrame(
        [("x", 0, 1.0, 50, 25), ("x", 1, 2.0, 2, 1), ("x", 2, None, 48, 0)],
        "feature string, bin int, edge double, n long, bad long",
    )
    got = scorecard.merged_bins(bins, 0.05).orderBy("bin").collect()
    assert [(r.n, r.bad, r.edge) for r in got] == [(52, 26, 2.0), (48, 0, None)]


def test_scorecard_is_the_regularised_optimum(spark, planted):
    card = scorecard.fit_scorecard(
        planted, ["f_a", "f_b"], "target", [Rule("r", (Condition("f_c", "<=", 1),))], C=0.5
    )
    table = scorecard.design(planted, card.models, card.rules, "target").toPandas()
    x, y = table[["x0", "x1", "x2"]].to_numpy(), table["target"].to_numpy()
    beta = np.array(card.coefficients)
    p = 1 / (1 + np.exp(-(card.intercept + x @ beta)))
    assert np.abs(beta + 0.5 * x.T @ (p - y)).max() < 0.05 and abs((p - y).sum()) < 0.05
    scored = scorecard.score(planted, card).select("probability", "risk_score", "risk_level", "reason_codes")
    got = scored.toPandas()
    assert np.sort(got["probability"]) == pytest.approx(np.sort(p), abs=1e-9)
    assert set(got["risk_level"]) <= {"low", "medium", "high", "critical"}
    assert got["reason_codes"].map(len).between(1, 3).all()


def test_windows_without_rows_are_null(spark):
    df = spark.createDataFrame(
        [(1, -10, 5.0, None), (1, -100, 7.0, 1.0), (2, -400, None, 2.0), (3, -1, None, None)],
        "k long, age int, v double, w double",
    )
    features = {"n": rows(), "v": total("v"), "m": mean("v"), "d": distinct("w"), "r": sum_ratio("w", "v")}
    got = {
        r.entity_id: r
        for r in window_features(df, "k", [Window("age", 30, "30d"), Window("age", 365, "1y")], features).collect()
    }
    assert (got[1].n_30d, got[1].v_30d, got[1].n_1y, got[1].v_1y) == (1, 5.0, 2, 12.0)
    assert got[1].d_1y == 2 and got[1].r_1y == pytest.approx(1 / 12)
    assert got[2].n_30d is None and got[2].v_1y is None
    assert got[3].n_30d == 1 and got[3].v_30d == 0.0 and got[3].m_30d is None and got[3].r_30d is None
