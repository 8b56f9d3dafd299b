"""The same rules, scores and drift bins on a stream.

Rules and scorecards are column expressions, so they apply to a streaming
table as they are; drift needs one windowed count per feature and bin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scorewatch.functions.expr import long_bins, ratio
from scorewatch.functions.tokens import short_hash
from scorewatch.operators.monitoring import (
    PROBABILITY_FLOOR,
    PSI_CRITICAL,
    PSI_WARNING,
    FeatureReference,
    two_level,
)
from scorewatch.operators.scorecard import Scorecard, score
from scorewatch.roles import Rule
from scorewatch.sources.tables import rules_matching


def flag_and_score(stream: DataFrame, rules: Sequence[Rule], card: Scorecard | None = None) -> DataFrame:
    """Rule flags, and the score when a card is given; stateless."""
    flagged = rules_matching(stream, rules)
    return flagged if card is None else score(flagged, card)


def window_bins(
    stream: DataFrame,
    time: str,
    edges: Mapping[str, Sequence[float]],
    *,
    window: str = "1 day",
    delay: str = "1 day",
) -> DataFrame:
    """Finite rows per time window, feature and reference bin.

    State holds windows x features x bins; rows later than ``delay`` are dropped.
    """
    stamped = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    inner = {f: list(e[1:-1]) for f, e in edges.items() if len(e) > 1}
    return (
        long_bins(stamped, inner, "_at")
        .groupBy(F.window("_at", window).alias("w"), "feature", "bin")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "feature", "bin", "n")
    )


def window_psi(bins: DataFrame, features: Sequence[FeatureReference]) -> DataFrame:
    """Floored stability index per closed window and feature, for ``foreachBatch``."""
    grid = bins.sparkSession.createDataFrame(
        [
            (f.feature, b, int(n), int(sum(f.counts)))
            for f in features
            for b, n in enumerate(f.counts)
        ],
        "feature string, bin int, ref_n long, ref_total long",
    )
    windows = bins.select("window_start", "feature").distinct()
    full = (
        windows.join(grid, "feature")
        .join(bins, ["window_start", "feature", "bin"], "left")
        .fillna(0, ["n"])
        .withColumn("total", F.sum("n").over(W.partitionBy("window_start", "feature")))
    )
    r = F.greatest(F.col("ref_n") / F.col("ref_total"), F.lit(PROBABILITY_FLOOR))
    c = F.greatest(ratio(F.col("n"), F.col("total")), F.lit(PROBABILITY_FLOOR))
    return full.groupBy("window_start", "feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def window_alerts(bins: DataFrame, features: Sequence[FeatureReference]) -> DataFrame:
    """Distribution alerts of closed windows, from their bins: one row per window and drifted feature."""
    psi = window_psi(bins, features)
    severity = two_level(F.abs("psi"), PSI_WARNING, PSI_CRITICAL)
    start = F.col("window_start").cast("string")
    key = F.concat_ws("|", F.lit("distribution"), F.lit("feature"), "feature", F.lit("psi"), start)
    return psi.withColumn("severity", severity).filter(F.col("severity").isNotNull()).select(
        short_hash(key, 12).alias("alert_id"), "window_start", "feature", "psi", "severity"
    )


def alert_stream(
    bins: DataFrame,
    features: Sequence[FeatureReference],
    path: str,
    checkpoint: str,
    *,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Write the alerts of every closed window of :func:`window_bins` to the table at ``path``.

    The state holds the bins of open windows; a window's alerts are written once, with the batch in which it closes.
    A batch that is run again after a failure replaces its own files only, and a query that starts
    from ``checkpoint`` goes on where the last one ended.
    """

    def write(batch: DataFrame, number: int) -> None:
        window_alerts(batch, features).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = bins.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows (partial counts, as the state sees them) that a query dropped because their window was closed."""
    return sum(
        operator.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
