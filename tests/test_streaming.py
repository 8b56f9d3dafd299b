import datetime

import pytest

from scorewatch.operators.monitoring import FeatureReference
from scorewatch.streaming import monitor

REFERENCE = FeatureReference("value", "events", "double", 0.0, 0.0, (0.0, 1.0, 2.0), (50, 50))


def test_alerts_go_on_after_a_restart_without_repeats(spark, tmp_path):
    source, path, state = (str(tmp_path / name) for name in ("in", "alerts", "state"))
    start = datetime.datetime(2024, 1, 1)

    def add(day, values):
        rows = [(start + datetime.timedelta(days=day, minutes=k), float(v)) for k, v in enumerate(values)]
        spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema("ts timestamp, value double").parquet(source)
        bins = monitor.window_bins(stream, "ts", {"value": REFERENCE.edges}, delay="1 hour")
        query = monitor.alert_stream(bins, [REFERENCE], path, state)
        query.awaitTermination()
        found = spark.read.option("basePath", path).parquet(path).select("window_start", "feature", "psi", "severity").collect()
        return query, sorted((r["window_start"].day, r["severity"], round(r["psi"], 4)) for r in found)

    add(0, [0.5] * 10 + [1.5] * 10)  # as the reference
    add(1, [0.5] * 20)  # all in one bin
    add(2, [0.5] * 10)
    add(3, [1.5] * 2)
    _, first = run()
    assert [day for day, *_ in first] == [2] and {s for _, s, _ in first} == {"critical"}
    _, again = run()
    assert again == first
    add(1, [1.5] * 20)  # too late: the window is closed
    add(9, [0.5] * 3)
    query, later = run()
    assert later[: len(first)] == first and [day for day, *_ in later] == [2, 3, 4]
    assert monitor.late_rows(query) > 0


def test_windows_like_the_reference_raise_nothing(spark):
    rows = [("2024-01-01", "value", 0, 5), ("2024-01-01", "value", 1, 5), ("2024-01-02", "value", 1, 9)]
    bins = spark.createDataFrame(rows, "window_start string, feature string, bin int, n long")
    found = monitor.window_alerts(bins.selectExpr("to_timestamp(window_start) window_start", "feature", "bin", "n"), [REFERENCE]).collect()
    assert [r["window_start"].day for r in found] == [2]
    assert found[0]["psi"] == pytest.approx(0.5 * 0.6931471805599453 - 0.499999 * -13.122363377404328, rel=1e-4)
