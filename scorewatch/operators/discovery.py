"""Discovery of one- and two-condition risk rules.

Only cut points, the pair beam and the selected rules reach the driver; all
counting runs as grouped aggregates whose shuffles hold feature x bin rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import (
    explode_structs,
    finite,
    kept,
    literal_sql,
    long_bins,
    number,
    quoted,
    small_table,
)
from scorewatch.functions.ranks import quantiles, range_place, running_totals
from scorewatch.functions.stats import rule_metrics
from scorewatch.operators.contract import require_columns
from scorewatch.roles import (
    Condition,
    DiscoveryConfig,
    Rule,
    canonical_conditions,
    numeric_columns,
)
from scorewatch.sources.scratch import staged

# The quantiles that serve as thresholds.
THRESHOLD_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
# Two values closer than this cannot be told apart by a tree split.
SPLIT_TOLERANCE = 1e-7
CONDITIONS = "array<struct<feature:string,operator:string,value:double>>"
_WORD = 62


def support_bounds(rows: int, min_support: float) -> tuple[int, int]:
    """Smallest and largest support, in decimal arithmetic."""
    share = Decimal(str(min_support))
    low = (share * rows).to_integral_value(rounding=ROUND_CEILING)
    high = ((1 - share) * rows).to_integral_value(rounding=ROUND_FLOOR)
    return int(low), int(high)


# --- thresholds --------------------------------------------------------------------


def eligible_features(df: DataFrame, features: Sequence[str], by: str | None = None) -> DataFrame:
    """Numeric features with their infinity count and finite range; ``eligible`` says usable.

    With ``by`` one row per group (``g``) and feature.
    """
    names = numeric_columns(df.schema, sorted(set(features)))
    aggs = []
    for i, c in enumerate(names):
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"i{i}"),
            F.min(finite(c)).alias(f"a{i}"),
            F.max(finite(c)).alias(f"b{i}"),
        ]
    keys = [] if by is None else [group_key(by)]
    wide = df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)
    return explode_structs(
        wide,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"i{i}").alias("infinite"),
                F.col(f"a{i}").alias("min_value"),
                F.col(f"b{i}").alias("max_value"),
                F.coalesce((F.col(f"i{i}") == 0) & (F.col(f"a{i}") < F.col(f"b{i}")), F.lit(False)).alias(
                    "eligible"
                ),
            )
            for i, c in enumerate(names)
        ],
        *(["g"] if by else []),
    )


def value_counts(df: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> DataFrame:
    """Rows and bads per group, feature and distinct single-precision value."""
    clean = df.select(
        group_key(by),
        (F.col(target) == 1).cast("long").alias("_bad"),
        *[finite(c).cast("float").alias(f"_v_{c}") for c in features],
    )
    return (
        clean.unpivot(["g", "_bad"], [f"_v_{c}" for c in features], "feature", "v")
        .filter(F.col("v").isNotNull())
        .groupBy("g", F.expr("substring(feature, 4)").alias("feature"), "v")
        .agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"))
        .withColumn("v", F.col("v").cast("double"))
    )


def group_key(by: str | None) -> Column:
    """The group a row belongs to (``g``); without ``by`` all rows are one group."""
    return F.lit("").alias("g") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("None")).alias("g")


def _best_splits(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best Gini split per node: ``keys..., threshold, left_n, left_bad``.

    ``run`` has class totals up to every sorted value (``cum_n, cum_bad``), the next value, and per
    node its totals, weights and smallest leaf.  The first best value wins; the threshold is the
    midpoint to the next value.
    """

    def purity(n: Column, bad: Column) -> Column:
        b, g = bad * F.col("w1"), (n - bad) * F.col("w0")
        return (b * b + g * g) / (b + g)

    left_n, left_bad = F.col("cum_n"), F.col("cum_bad")
    right_n, right_bad = F.col("n_all") - left_n, F.col("bad_all") - left_bad
    allowed = (
        (F.col("bad_all") > 0)
        & (F.col("bad_all") < F.col("n_all"))
        & (left_n >= F.col("leaf"))
        & (right_n >= F.col("leaf"))
        & (right_n > 0)
        & (F.col("next_v") > F.col("v") + SPLIT_TOLERANCE)
    )
    middle = F.col("v") / 2 + F.col("next_v") / 2
    threshold = F.when(middle < F.col("next_v"), middle).otherwise(F.col("v"))
    scored = run.filter(allowed).select(
        *keys,
        F.struct(
            (purity(left_n, left_bad) + purity(right_n, right_bad)).alias("gain"),
            (-F.col("v")).alias("first"),
            threshold.alias("threshold"),
            left_n.alias("left_n"),
            left_bad.alias("left_bad"),
        ).alias("s"),
    )
    found = scored.groupBy(*keys).agg(F.max("s").alias("s"))
    return found.select(*keys, "s.threshold", "s.left_n", "s.left_bad")


def tree_thresholds(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    min_leaf: int | Mapping[str, int],
    *,
    balanced: bool = False,
    by: str | None = None,
) -> dict:
    """Split points of a depth-2 Gini tree on every single feature, by exact search.

    Distinct values are put in order once, for all features and groups; totals up to each value give
    the first split, and the same totals less those of the left side give the splits of both sides.
    With ``balanced`` the classes of a feature weigh the same.  Keys of the result are features, with
    ``by`` pairs of group and feature; ``min_leaf`` may differ by group.
    """
    if not features:
        return {}
    counts = staged(value_counts(df, features, target, by), "values")
    run = running_totals(counts, by=["g", "feature"], order=["v"], sums=["n", "bad"], following="v")
    leaf = F.lit(min_leaf) if isinstance(min_leaf, int) else F.create_map(
        *[F.lit(x) for pair in min_leaf.items() for x in pair]
    )[F.col("g")]
    one = F.lit(1.0)
    totals = run.groupBy("g", "feature").agg(F.max("cum_n").alias("n_all"), F.max("cum_bad").alias("bad_all"))
    totals = totals.withColumns(
        {
            "w1": F.col("n_all") / F.nullif(2 * F.col("bad_all"), F.lit(0)) if balanced else one,
            "w0": F.col("n_all") / F.nullif(2 * (F.col("n_all") - F.col("bad_all")), F.lit(0)) if balanced else one,
            "leaf": leaf,
        }
    )
    # A row per group and feature, read by both searches.
    totals = small_table(totals)
    rows = run.join(F.broadcast(totals), ["g", "feature"])
    root = small_table(_best_splits(rows, ["g", "feature"]))
    found: dict[tuple, list] = {(r["g"], r["feature"]): [r["threshold"]] for r in root.collect()}
    if found:
        right = F.col("v") > F.col("threshold")

        def side(total: str, left: str) -> Column:
            return F.when(right, F.col(total) - F.col(left)).otherwise(F.col(left))

        children = rows.join(F.broadcast(root), ["g", "feature"]).select(
            "g", "feature", "v", "next_v", "w1", "w0", "leaf", right.alias("node"),
            (F.col("cum_n") - F.when(right, F.col("left_n")).otherwise(0)).alias("cum_n"),
            (F.col("cum_bad") - F.when(right, F.col("left_bad")).otherwise(0)).alias("cum_bad"),
            side("n_all", "left_n").alias("n_all"),
            side("bad_all", "left_bad").alias("bad_all"),
        )
        for r in _best_splits(children, ["g", "feature", "node"]).collect():
            found[r["g"], r["feature"]].append(r["threshold"])
    return {k if by else k[1]: sorted(t) for k, t in found.items()}


#: Settings of the boosted cuts: trees and learning rate.
BOOST_TREES, BOOST_RATE = 30, 0.05


def boosted_thresholds(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    balanced: bool = False,
    by: str | None = None,
    trees: int = BOOST_TREES,
    rate: float = BOOST_RATE,
) -> dict:
    """Split points of boosted depth-2 trees on every single feature, by histogram boosting.

    The trees of a feature see nothing but its values, so rows of one range of values always get the
    same score: one job counts rows and bads per group, feature and range (64 for each doubling of the
    value), and every round sums the residuals of these ranges, for all features at once.  Splits gain
    in squared residual sums, leaves take a Newton step; a cut lies midway between two ranges.  With
    ``balanced`` the classes weigh the same.
    """
    if not features:
        return {}
    long = df.select(
        group_key(by), (F.col(target) == 1).cast("long").alias("bad"), *[finite(c).alias(f"v_{c}") for c in features]
    ).unpivot(["g", "bad"], [f"v_{c}" for c in features], "feature", "v")
    counted = (
        long.filter(F.col("v").isNotNull())
        .groupBy("g", F.expr("substring(feature, 3)").alias("feature"), range_place(F.col("v")).alias("place"))
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.min("v").alias("low"), F.max("v").alias("high"))
    )

    def boost(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        found = boosted_cuts(pdf["n"].to_numpy(float), pdf["bad"].to_numpy(float), trees=trees, rate=rate, balanced=balanced)
        cuts = [float(high[k - 1] / 2 + low[k] / 2) for k in found]
        return pd.DataFrame({"g": pdf["g"].iloc[0], "feature": pdf["feature"].iloc[0], "cuts": [cuts]})

    # A group of this step has one row per range of one feature.
    found = counted.groupBy("g", "feature").applyInPandas(boost, "g string, feature string, cuts array<double>")
    return {
        ((r["g"], r["feature"]) if by else r["feature"]): list(r["cuts"]) for r in found.collect() if r["cuts"]
    }


def boosted_cuts(
    n: np.ndarray, bad: np.ndarray, *, trees: int, rate: float, balanced: bool = False
) -> list[int]:
    """Places at which a tree splits the ordered ranges of one feature, from their counts (logistic loss)."""
    if not 0 < bad.sum() < n.sum():
        return []
    w1 = n.sum() / (2 * bad.sum()) if balanced else 1.0
    w0 = n.sum() / (2 * (n - bad).sum()) if balanced else 1.0
    weight, positive = bad * w1 + (n - bad) * w0, bad * w1
    score = np.full(len(n), np.log(positive.sum() / (weight.sum() - positive.sum())))
    used: set[int] = set()

    def split(lo: int, hi: int, residual: np.ndarray) -> int | None:
        """Place of the best split of bins lo..hi: the largest sum of squared sums over weights."""
        r, w = np.cumsum(residual[lo:hi]), np.cumsum(weight[lo:hi])
        if hi - lo < 2:
            return None
        gain = r[:-1] ** 2 / w[:-1] + (r[-1] - r[:-1]) ** 2 / (w[-1] - w[:-1]) - r[-1] ** 2 / w[-1]
        at = int(np.argmax(gain))
        return lo + at + 1 if gain[at] > 1e-12 * weight.sum() else None

    for _ in range(trees):
        chance = 1 / (1 + np.exp(-score))
        residual, curve = positive - weight * chance, weight * chance * (1 - chance)
        edges = [0, len(n)]
        for _depth in range(2):
            more = [split(a, b, residual) for a, b in zip(edges, edges[1:])]
            edges = sorted({*edges, *(m for m in more if m is not None)})
        if len(edges) == 2:
            break
        used.update(edges[1:-1])
        for a, b in zip(edges, edges[1:]):
            score[a:b] += rate * residual[a:b].sum() / max(curve[a:b].sum(), 1e-12)
    return sorted(used)


def rule_thresholds(
    df: DataFrame, features: Sequence[str], target: str, config: DiscoveryConfig, rows: int
) -> dict[str, list[float]]:
    """Sorted distinct thresholds of every eligible feature."""
    return {f: cuts for (_, f), cuts in group_thresholds(df, features, target, config, {"": rows}).items()}


def group_thresholds(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    config: DiscoveryConfig,
    rows: Mapping[str, int],
    by: str | None = None,
) -> dict[tuple[str, str], list[float]]:
    """Sorted distinct thresholds per group and eligible feature; ``rows`` has the groups and their sizes.

    Quantiles, tree cuts and boosted cuts are found for all groups and features at once.  WOE cuts,
    off by default, are fitted group after group.
    """
    usable = {
        (r["g"] if by else "", r["feature"])
        for r in eligible_features(df, features, by).filter("eligible").collect()
    }
    usable = {k for k in usable if k[0] in rows}
    names = sorted({f for _, f in usable})
    if not names:
        return {}
    if by is not None:
        df = df.withColumn("g", group_key(by)).filter(F.col("g").isin(list(rows)))
    key = None if by is None else "g"
    cuts: dict[tuple[str, str], set[float]] = {k: set() for k in usable}
    for r in quantiles(df, names, THRESHOLD_PROBS, by=key).collect():
        cuts.get((r["g"] if by else "", r["feature"]), set()).update(r["q"])

    def add(found: Mapping) -> None:
        for k, values in found.items():
            cuts.get(k if by else ("", k), set()).update(values)

    if config.tree_cuts:
        leaves = {g: support_bounds(n, config.min_support)[0] for g, n in rows.items()}
        leaf = leaves if by else leaves[""]
        add(tree_thresholds(df, names, target, leaf, balanced=config.balanced, by=key))
    if config.woe_cuts:
        from scorewatch.operators.scorecard import fit_woe

        for g in rows:
            own = [f for f in names if (g, f) in usable]
            models = fit_woe(
                df if by is None else df.filter(F.col("g") == g),
                own,
                target,
                max_bins=config.woe_max_bins,
                min_bin_fraction=config.woe_min_bin_fraction,
                monotonic=config.woe_monotonic,
            )
            for m in models:
                if m.iv >= config.woe_min_iv:
                    cuts[g, m.feature].update(m.edges)
    if config.boosted_cuts:
        add(boosted_thresholds(df, names, target, balanced=config.balanced, by=key))
    return {k: sorted(v) for k, v in sorted(cuts.items())}


# --- candidates ----------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def canonical_text(conditions: pd.Series) -> pd.Series:
    """Canonical JSON of candidate conditions (rule rows only, never data rows)."""
    return pd.Series(
        [
            canonical_conditions(
                Condition(c["feature"], c["operator"], float(c["value"])) for c in row
            )[1]
            for row in conditions
        ],
        dtype=object,
    )


def with_identity(candidates: DataFrame) -> DataFrame:
    """Add the canonical expression and the rule id (first 12 hex digits of its hash)."""
    text = candidates.withColumn("expression", canonical_text("conditions"))
    return text.withColumn("rule_id", F.substring(F.sha2("expression", 256), 1, 12))


def _condition(feature: Column, operator: Column | str, value: Column) -> Column:
    operator = F.lit(operator) if isinstance(operator, str) else operator
    return F.struct(feature.alias("feature"), operator.alias("operator"), value.alias("value"))


def by_rank() -> list[Column]:
    """Best first: lift, support, expression, all descending."""
    return [F.desc(n) for n in ("lift", "support_count", "expression")]


def single_candidates(
    df: DataFrame,
    thresholds: Mapping[str, Sequence[float]],
    target: str,
    config: DiscoveryConfig,
    rows: int,
    positives: int,
) -> DataFrame:
    """Counts of every ``feature <= t`` and ``feature > t`` within the support bounds.

    Rows are binned between the thresholds once; running sums over the bins
    give all candidates, however many thresholds there are.
    """
    binned = (
        long_bins(
            df.withColumn("_bad", (F.col(target) == 1).cast("long")), thresholds, "_bad", closed="right"
        )
        .groupBy(F.lit("").alias("g"), "feature", "bin")
        .agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"))
    )
    named = {("", f): cuts for f, cuts in thresholds.items()}
    return _sides(binned, named, {"": (rows, positives)}, config).drop("g")


def group_candidates(
    df: DataFrame,
    thresholds: Mapping[tuple[str, str], Sequence[float]],
    target: str,
    config: DiscoveryConfig,
    sizes: Mapping[str, tuple[int, int]],
    by: str,
) -> DataFrame:
    """:func:`single_candidates` of every group, each with thresholds and totals of its own.

    One histogram over group, feature and bin: a value is compared with the few cuts of its group,
    which come as one literal row per group and feature.
    """
    names = sorted({f for _, f in thresholds})
    spark = df.sparkSession
    cuts = spark.createDataFrame(
        [(g, f, [float(t) for t in values]) for (g, f), values in thresholds.items()],
        "g string, feature string, cuts array<double>",
    )
    long = df.select(
        group_key(by), (F.col(target) == 1).cast("long").alias("bad"), *[finite(c).alias(f"v_{c}") for c in names]
    ).unpivot(["g", "bad"], [f"v_{c}" for c in names], "feature", "v")
    long = long.filter(F.col("v").isNotNull()).withColumn("feature", F.expr("substring(feature, 3)"))
    binned = (
        long.join(F.broadcast(cuts), ["g", "feature"])
        .groupBy("g", "feature", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    )
    return _sides(binned, thresholds, sizes, config)


def _sides(
    binned: DataFrame,
    thresholds: Mapping[tuple[str, str], Sequence[float]],
    sizes: Mapping[str, tuple[int, int]],
    config: DiscoveryConfig,
) -> DataFrame:
    """Both sides of every threshold, from counts per group, feature and bin."""
    spark = binned.sparkSession
    grid = spark.createDataFrame(
        [(g, f, b, t) for (g, f), cuts in thresholds.items() for b, t in enumerate([*cuts, None])],
        "g string, feature string, bin int, value double",
    )
    totals = spark.createDataFrame(
        [(g, n, pos, *support_bounds(n, config.min_support)) for g, (n, pos) in sizes.items()],
        "g string, rows long, positives long, low long, high long",
    )
    # Windows over group x feature x bin rows.
    whole = W.partitionBy("g", "feature")
    upto = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cumulative = (
        grid.join(binned, ["g", "feature", "bin"], "left")
        .fillna(0, ["n", "bad"])
        .select(
            "g",
            "feature",
            "value",
            F.sum("n").over(upto).alias("n_low"),
            F.sum("bad").over(upto).alias("bad_low"),
            F.sum("n").over(whole).alias("n_all"),
            F.sum("bad").over(whole).alias("bad_all"),
        )
        .filter(F.col("value").isNotNull())
    )
    sides = explode_structs(
        cumulative,
        [
            F.struct(F.lit("<=").alias("operator"), F.col("n_low").alias("hit"), F.col("bad_low").alias("hit_pos")),
            F.struct(
                F.lit(">").alias("operator"),
                (F.col("n_all") - F.col("n_low")).alias("hit"),
                (F.col("bad_all") - F.col("bad_low")).alias("hit_pos"),
            ),
        ],
        "g",
        "feature",
        "value",
    )
    sides = sides.join(F.broadcast(totals), "g").filter(F.col("hit").between(F.col("low"), F.col("high")))
    shaped = sides.select(
        "g",
        F.lit("discovery_single").alias("origin"),
        F.array(_condition(F.col("feature"), F.col("operator"), F.col("value"))).alias("conditions"),
        F.col("rows").alias("n"),
        F.col("positives").alias("pos"),
        "hit",
        "hit_pos",
    )
    return rule_metrics(with_identity(shaped))


def pair_beam(singles: DataFrame, width: int) -> DataFrame:
    """Best candidate of every feature first, then the second best, up to ``width``."""
    feature = F.col("conditions")[0]["feature"]
    place = F.row_number().over(W.partitionBy(feature).orderBy(*by_rank()))
    return (
        singles.withColumns({"place": place, "feature": feature})
        .orderBy("place", "feature")
        .limit(width)
    )


def pair_counts(df: DataFrame, beam: Sequence[Rule], target: str) -> DataFrame:
    """Support and bads of every pair of beam rules: ``i, j, hit, hit_pos`` with i < j.

    Each row becomes a bit pattern of the rules it hits; rows are counted per
    pattern, and the small pattern table is multiplied with itself bit by bit
    inside the tasks, so the number of pairs never multiplies the rows.
    """
    width = len(beam)
    words = [beam[s : s + _WORD] for s in range(0, width, _WORD)]
    names = sorted({c.feature for r in beam for c in r.conditions})
    clean = df.select(
        (F.col(target) == 1).cast("long").alias("_bad"), *[finite(c).alias(c) for c in names]
    )
    bits = [
        F.expr(
            " + ".join(
                f"CASE WHEN {quoted(r.conditions[0].feature)} {r.conditions[0].operator} "
                f"{number(r.conditions[0].value)} THEN {1 << i}L ELSE 0L END"
                for i, r in enumerate(word)
            )
        ).alias(f"w{k}")
        for k, word in enumerate(words)
    ]
    columns = [f"w{k}" for k in range(len(words))]
    patterns = (
        clean.select("_bad", *bits)
        .groupBy(*columns)
        .agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"))
    )

    def overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hit = np.zeros((width, width), dtype=np.int64)
        bad = np.zeros((width, width), dtype=np.int64)
        for pdf in batches:
            place = np.arange(width)
            word = pdf[columns].to_numpy(dtype=np.int64)[:, place // _WORD]
            on = (word >> (place % _WORD)) & 1
            hit += on.T @ (on * pdf["n"].to_numpy(dtype=np.int64)[:, None])
            bad += on.T @ (on * pdf["bad"].to_numpy(dtype=np.int64)[:, None])
        i, j = np.triu_indices(width, k=1)
        yield pd.DataFrame({"i": i, "j": j, "hit": hit[i, j], "hit_pos": bad[i, j]})

    return (
        patterns.mapInPandas(overlaps, "i long, j long, hit long, hit_pos long")
        .groupBy("i", "j")
        .agg(F.sum("hit").alias("hit"), F.sum("hit_pos").alias("hit_pos"))
    )


def pair_candidates(
    df: DataFrame,
    beam_rows: DataFrame,
    target: str,
    config: DiscoveryConfig,
    rows: int,
    positives: int,
) -> DataFrame | None:
    """Pairs of beam rules on different features; pairs equal to one of their sides are dropped."""
    collected = beam_rows.select("rule_id", "conditions", "hit").collect()
    beam = [
        Rule(r["rule_id"], tuple(Condition(c["feature"], c["operator"], c["value"]) for c in r["conditions"]))
        for r in collected
    ]
    if len(beam) < 2:
        return None
    low, _ = support_bounds(rows, config.min_support)
    spark = df.sparkSession
    side = spark.createDataFrame(
        [
            (i, r.conditions[0].feature, r.conditions[0].operator, float(r.conditions[0].value), c["hit"])
            for i, (r, c) in enumerate(zip(beam, collected))
        ],
        "k long, feature string, operator string, value double, side_hit long",
    )

    def named(prefix: str) -> DataFrame:
        return side.select(
            F.col("k").alias(f"{prefix}k"),
            _condition(F.col("feature"), F.col("operator"), F.col("value")).alias(f"{prefix}c"),
            F.col("side_hit").alias(f"{prefix}hit"),
        )

    counted = pair_counts(df, beam, target)
    joined = (
        counted.join(F.broadcast(named("l")), F.col("i") == F.col("lk"))
        .join(F.broadcast(named("r")), F.col("j") == F.col("rk"))
        .filter(F.col("lc.feature") != F.col("rc.feature"))
        .filter(
            (F.col("hit") >= low) & (F.col("hit") != F.col("lhit")) & (F.col("hit") != F.col("rhit"))
        )
    )
    shaped = joined.select(
        F.lit("discovery_pair").alias("origin"),
        F.sort_array(F.array("lc", "rc")).alias("conditions"),
        F.lit(rows).cast("long").alias("n"),
        F.lit(positives).cast("long").alias("pos"),
        "hit",
        "hit_pos",
    )
    return rule_metrics(with_identity(shaped))


def diverse_pairs(pairs: DataFrame, maximum: int) -> DataFrame:
    """The best pair of every feature pair first, then the remaining ones by rank."""
    both = F.array_sort(F.transform("conditions", lambda c: c["feature"]))
    first = F.row_number().over(W.partitionBy("_pair").orderBy(*by_rank()))
    return (
        pairs.withColumn("_pair", both)
        .withColumn("_first", first == 1)
        .orderBy(F.desc("_first"), *by_rank())
        .limit(maximum)
        .drop("_pair", "_first")
    )


# --- pairs of every group ----------------------------------------------------------------


def _group_pairs(
    df: DataFrame,
    beams: Mapping[str, Sequence],
    target: str,
    config: DiscoveryConfig,
    sizes: Mapping[str, tuple[int, int]],
    by: str,
) -> DataFrame:
    """:func:`pair_candidates` of every group: bit ``k`` of a row is rule ``k`` of its group's beam."""
    width = max(map(len, beams.values()))
    names = sorted({r["conditions"][0]["feature"] for beam in beams.values() for r in beam})
    clean = df.select(
        group_key(by), (F.col(target) == 1).cast("long").alias("_bad"), *[finite(c).alias(f"v_{c}") for c in names]
    )

    def bits(group: str, first: int) -> str:
        terms = []
        for k, r in enumerate(beams[group][first : first + _WORD]):
            c = r["conditions"][0]
            hit = f"{quoted('v_' + c['feature'])} {c['operator']} {number(c['value'])}"
            terms.append(f"CASE WHEN {hit} THEN {1 << k}L ELSE 0L END")
        return " + ".join(terms) or "0L"

    words = []
    for k, first in enumerate(range(0, width, _WORD)):
        cases = " ".join(f"WHEN {literal_sql(g)} THEN {bits(g, first)}" for g in beams)
        words.append(F.expr(f"CASE g {cases} END").alias(f"w{k}"))
    columns = [f"w{k}" for k in range(len(words))]
    patterns = (
        clean.filter(F.col("g").isin(list(beams)))
        .select("g", "_bad", *words)
        .groupBy("g", *columns)
        .agg(F.count("*").alias("n"), F.sum("_bad").alias("bad"))
    )

    def overlaps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        place = np.arange(width)
        for pdf in batches:
            for g, own in pdf.groupby("g"):
                word = own[columns].to_numpy(dtype=np.int64)[:, place // _WORD]
                on = (word >> (place % _WORD)) & 1
                both = [on.T @ (on * own[c].to_numpy(dtype=np.int64)[:, None]) for c in ("n", "bad")]
                counts[g] = counts.get(g, 0) + np.stack(both)
        i, j = np.triu_indices(width, k=1)
        for g, (hit, bad) in counts.items():
            yield pd.DataFrame({"g": g, "i": i, "j": j, "hit": hit[i, j], "hit_pos": bad[i, j]})

    counted = (
        patterns.mapInPandas(overlaps, "g string, i long, j long, hit long, hit_pos long")
        .groupBy("g", "i", "j")
        .agg(F.sum("hit").alias("hit"), F.sum("hit_pos").alias("hit_pos"))
    )
    spark = df.sparkSession
    side = spark.createDataFrame(
        [
            (g, k, r["conditions"][0]["feature"], r["conditions"][0]["operator"], r["conditions"][0]["value"], r["hit"])
            for g, beam in beams.items() for k, r in enumerate(beam)
        ],
        "g string, k long, feature string, operator string, value double, side_hit long",
    )

    def named(prefix: str, number_: str) -> DataFrame:
        return side.select(
            "g",
            F.col("k").alias(number_),
            _condition(F.col("feature"), F.col("operator"), F.col("value")).alias(f"{prefix}c"),
            F.col("side_hit").alias(f"{prefix}hit"),
        )

    totals = spark.createDataFrame(
        [(g, n, pos, support_bounds(n, config.min_support)[0]) for g, (n, pos) in sizes.items()],
        "g string, n long, pos long, low long",
    )
    joined = (
        counted.join(F.broadcast(named("l", "i")), ["g", "i"])
        .join(F.broadcast(named("r", "j")), ["g", "j"])
        .join(F.broadcast(totals), "g")
        .filter(F.col("lc.feature") != F.col("rc.feature"))
        .filter((F.col("hit") >= F.col("low")) & (F.col("hit") != F.col("lhit")) & (F.col("hit") != F.col("rhit")))
    )
    shaped = joined.select(
        "g",
        F.lit("discovery_pair").alias("origin"),
        F.sort_array(F.array("lc", "rc")).alias("conditions"),
        "n",
        "pos",
        "hit",
        "hit_pos",
    )
    return rule_metrics(with_identity(shaped))


def discover_groups(
    train: DataFrame,
    by: str,
    features: Sequence[str],
    target: str,
    config: DiscoveryConfig = DiscoveryConfig(),
) -> DataFrame:
    """:func:`discover` inside every group of ``by``: ``g`` and the columns of a discovery frame.

    The groups go through every step together, so the number of jobs does not depend on how many there are.
    The result has at most a few hundred rows per group; groups with one class have none.
    """
    require_columns(train, [*features, target, by], "feature")
    spark = train.sparkSession
    names = sorted(set(features))
    empty = spark.createDataFrame([], f"g string, {OUTPUT_SCHEMA}")
    with kept(train, target, by, *[n for n in names if n != by]) as rows:
        counts = rows.groupBy(group_key(by)).agg(
            F.count("*").alias("n"),
            F.count_if(F.col(target) == 1).alias("pos"),
            F.count_if(F.col(target).isNotNull() & (F.col(target) != 1)).alias("neg"),
        )
        sizes = {r["g"]: (r["n"], r["pos"]) for r in counts.collect() if r["pos"] and r["neg"]}
        if not sizes:
            return empty
        thresholds = group_thresholds(rows, names, target, config, {g: n for g, (n, _) in sizes.items()}, by)
        if not thresholds:
            return empty
        singles = group_candidates(rows, thresholds, target, config, sizes, by).persist()
        try:
            best = W.partitionBy("g").orderBy(*by_rank())
            place = F.row_number().over(best)
            chosen = singles.withColumn("_k", place).filter(F.col("_k") <= config.max_single_rules)
            chosen = chosen.select("g", *OUTPUT).orderBy("g", "_k").collect()
            picked = []
            if config.max_pair_rules:
                first = F.col("conditions")[0]["feature"]
                turn = F.row_number().over(W.partitionBy("g", first).orderBy(*by_rank()))
                beam_place = F.row_number().over(W.partitionBy("g").orderBy("_turn", first))
                beam = singles.withColumn("_turn", turn).withColumn("_k", beam_place)
                beams: dict[str, list] = {}
                for r in beam.filter(F.col("_k") <= config.beam_width).orderBy("g", "_k").collect():
                    beams.setdefault(r["g"], []).append(r)
                if beams:
                    pairs = _group_pairs(rows, beams, target, config, sizes, by)
                    both = F.array_sort(F.transform("conditions", lambda c: c["feature"]))
                    leads = F.row_number().over(W.partitionBy("g", both).orderBy(*by_rank())) == 1
                    order = W.partitionBy("g").orderBy(F.desc("_first"), *by_rank())
                    pairs = pairs.withColumn("_first", leads).withColumn("_k", F.row_number().over(order))
                    kept_pairs = pairs.filter(F.col("_k") <= config.max_pair_rules)
                    picked = kept_pairs.select("g", *OUTPUT).orderBy("g", *by_rank()).collect()
        finally:
            singles.unpersist()
    return spark.createDataFrame([*chosen, *picked], f"g string, {OUTPUT_SCHEMA}")


# --- the whole search ------------------------------------------------------------------


@dataclass(frozen=True)
class Discovery:
    """Selected rules with train metrics; at most a few hundred rows."""

    frame: DataFrame
    rules: tuple[Rule, ...]
    single_candidates: int
    singles_selected: int
    pair_candidates: int
    pairs_selected: int


OUTPUT = (
    "rule_id", "origin", "conditions", "expression", "n", "pos", "hit", "hit_pos",
    "support_count", "coverage", "base_bad_rate", "hit_bad_rate", "non_hit_bad_rate",
    "lift", "precision", "recall", "hit_good_rate", "ks_signed", "ks_stat",
)
OUTPUT_SCHEMA = (
    f"rule_id string, origin string, conditions {CONDITIONS}, expression string, n long, pos long, "
    "hit long, hit_pos long, support_count long, coverage double, base_bad_rate double, "
    "hit_bad_rate double, non_hit_bad_rate double, lift double, precision double, recall double, "
    "hit_good_rate double, ks_signed double, ks_stat double"
)


def discover(
    train: DataFrame, features: Sequence[str], target: str, config: DiscoveryConfig = DiscoveryConfig()
) -> Discovery:
    """Best single rules and diverse pairs on the training rows."""
    require_columns(train, [*features, target], "feature")
    spark = train.sparkSession
    names = sorted(set(features))
    # About eight passes read these columns.
    with kept(train, target, *names) as rows:
        return _discover(spark, rows, names, target, config)


def _discover(spark, train: DataFrame, features, target: str, config: DiscoveryConfig) -> Discovery:
    totals = train.agg(
        F.count("*").alias("n"),
        F.count_if(F.col(target) == 1).alias("pos"),
        F.count_if(F.col(target).isNotNull() & (F.col(target) != 1)).alias("neg"),
    ).first()
    n, pos = totals["n"], totals["pos"]
    empty = Discovery(spark.createDataFrame([], OUTPUT_SCHEMA), (), 0, 0, 0, 0)
    if not pos or not totals["neg"]:
        return empty
    thresholds = rule_thresholds(train, features, target, config, n)
    if not thresholds:
        return empty
    # Feature x threshold rows, read by the selection, the count and the beam.
    singles = single_candidates(train, thresholds, target, config, n, pos).persist()
    try:
        found = singles.count()
        top = singles.orderBy(*by_rank()).limit(config.max_single_rules)
        chosen = top.select(*OUTPUT).collect()
        n_pairs, picked = 0, []
        if config.max_pair_rules:
            pairs = pair_candidates(
                train, pair_beam(singles, config.beam_width), target, config, n, pos
            )
            if pairs is not None:
                pairs = pairs.persist()
                n_pairs = pairs.count()
                picked = diverse_pairs(pairs, config.max_pair_rules).select(*OUTPUT).collect()
                pairs.unpersist()
    finally:
        singles.unpersist()
    picked = sorted(
        picked, key=lambda r: (r["lift"], r["support_count"], r["expression"]), reverse=True
    )
    rows = [*chosen, *picked]
    rules = tuple(
        Rule(
            r["rule_id"],
            tuple(Condition(c["feature"], c["operator"], c["value"]) for c in r["conditions"]),
            r["origin"],
        )
        for r in rows
    )
    frame = spark.createDataFrame(rows, OUTPUT_SCHEMA)
    return Discovery(frame, rules, found, len(chosen), n_pairs, len(picked))
