import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scorewatch.operators import split


def counts(df, *keys):
    return {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.count("*").alias("n")).collect()}


def dated(spark, sizes):
    rows = [(f"2024-01-{d + 1:02d}", i) for d, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "day string, i int")


def test_time_split_keeps_dates_whole(spark):
    parts = split.time_split(dated(spark, [10, 10, 10, 10, 10]), "day")
    assert counts(parts, "partition") == {("train",): 30, ("test",): 10, ("holdout",): 10}
    days = parts.groupBy("day").agg(F.count_distinct("partition").alias("n"))
    assert days.filter("n > 1").count() == 0


def test_time_split_small_cases(spark):
    assert counts(split.time_split(dated(spark, [3, 4]), "day"), "partition") == {("train",): 3, ("test",): 4}
    assert counts(split.time_split(dated(spark, [5]), "day"), "partition") == {("train",): 5}
    # 90% on the first date: later parts still get one date each.
    assert counts(split.time_split(dated(spark, [90, 5, 5]), "day"), "partition") == {
        ("train",): 90, ("test",): 5, ("holdout",): 5,
    }


def turns(sizes, quota):
    got = [1] * len(sizes)
    left = quota - len(sizes)
    while left:
        for i, n in enumerate(sizes):
            if left and got[i] < n - 1:
                got[i] += 1
                left -= 1
    return got


def test_stratified_quotas_deal_in_turns(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"segment": rng.choice(list("ABCD"), 500, p=[0.6, 0.25, 0.1, 0.05])})
    pdf["target"] = (rng.uniform(size=500) < 0.3).astype(int)
    pdf["i"] = range(500)
    df = spark.createDataFrame(pdf)
    parts, limitations = split.stratified_split(df, "target", "segment")
    assert limitations == []
    got = counts(parts.filter("partition = 'train'"), "target", "segment")
    wanted = int(np.floor(0.7 * 500))
    exact = {t: (pdf.target == t).sum() / 500 * wanted for t in (0, 1)}
    base = {t: int(np.floor(v)) for t, v in exact.items()}
    for t in sorted(exact, key=lambda t: -(exact[t] - base[t]))[: wanted - sum(base.values())]:
        base[t] += 1
    for t in (0, 1):
        sizes = [int(((pdf.target == t) & (pdf.segment == s)).sum()) for s in "ABCD"]
        assert [got[(t, s)] for s in "ABCD"] == turns(sizes, base[t])
    assert parts.count() == 500 and parts.select("i").distinct().count() == 500


def test_split_falls_back_to_classes(spark):
    df = spark.createDataFrame([(f"s{i}", i % 2, i) for i in range(20)], "segment string, target int, i int")
    parts, limitations = split.stratified_split(df, "target", "segment")
    assert limitations == [split.FALLBACK_LIMITATION]
    assert counts(parts, "target", "partition") == {
        (0, "train"): 7, (0, "test"): 3, (1, "train"): 7, (1, "test"): 3,
    }


def test_exact_selection_with_a_large_group_of_copies(spark):
    rows = [("x", 1, 0)] * 4000 + [("x", 1, i) for i in range(1, 8000)]
    df = spark.createDataFrame(rows, "segment string, target int, i int").repartition(7)
    for quota in (1, 3999, 5000, 11_998):
        quotas = spark.createDataFrame([("x", quota)], "segment string, quota long")
        got = split.take_exact(df, ["segment"], quotas)
        assert counts(got, "partition") == {("train",): quota, ("test",): 11_999 - quota}
        assert got.filter("i = 0").count() == 4000


def test_selection_does_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("s", F.lit("x"))
    quotas = spark.createDataFrame([("x", 300)], "s string, quota long")
    picks = [
        {r.id for r in split.take_exact(d, ["s"], quotas).filter("partition = 'train'").collect()}
        for d in (df.repartition(3), df.coalesce(1))
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 300


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 2500), ("b", 0), ("c", 1)], "k string, n long")
    assert counts(split.repeat_rows(df, "n"), "k") == {("a",): 2500, ("c",): 1}


def test_period_split(spark):
    parts = split.period_split(dated(spark, [1, 1, 1, 1, 1]), "day")
    assert counts(parts, "period") == {("reference",): 3, ("current",): 2}
    ordered = split.period_split(spark.range(10).toDF("i"), "i", time_enabled=False, order_by="i")
    assert counts(ordered, "period") == {("reference",): 7, ("current",): 3}
    hot = spark.createDataFrame([(0, i) for i in range(90)] + [(None, 1)] * 5 + [(i, 0) for i in range(1, 6)], "k int, v int")
    found = split.period_split(hot, "k", time_enabled=False, order_by="k")
    assert counts(found, "period") == {("reference",): 70, ("current",): 30}
    assert counts(found.filter("k IS NULL"), "period") == {("reference",): 5}
    assert counts(found.filter("k > 0"), "period") == {("current",): 5}
