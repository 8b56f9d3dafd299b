"""Quality rules: statistics of a text as Spark expressions and a decision list learned from labels.

A text fails the base rules if it has under 50 words, or if over half of its words lie in 3-word
windows found twice or more.  For the rest, sequential covering learns an ordered list of
conjunctions of thresholds: a rule grows by the condition with the most information gain on two
thirds of the labelled rows, is pruned on the other third, and stays if it is precise there; the rows
that it covers are set aside and the next rule grows.  The list is a `CASE` expression.

Everything is DataFrame expressions and grouped counts; only bin counts (features x bins) reach the
driver.

Cases: null text has no words and fails; without labels of both kinds the list is empty and only the
base rules decide; rows given twice are judged twice; a document with several label rows counts once,
by its lowest.  Extra columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import staged

BLANK = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What conditions may be about: name and expression over the statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, *keep: Column) -> DataFrame:
    """`doc_id` (or the columns of `keep`) and the counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = F.struct(*(keep or [F.col("doc_id")])).alias("kept_columns")

    def count(signs: str) -> Column:
        return (F.char_length(text) - F.char_length(F.translate(text, signs, ""))).cast("long")

    split = docs.select(
        kept,
        F.array_remove(F.split(text, BLANK), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0).alias("lines"),
        count("#*$%&|<>").alias("n_symbols"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        count("0123456789").alias("n_digits"),
        count(".,;:?!").alias("n_stops"),
    )
    hashed = split.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))").alias("h"),
    )
    placed = hashed.select(
        "*",
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.expr("cast(array() as array<struct<h: bigint, p: int>>)"))
        .otherwise(F.expr("array_sort(transform(h, (x, i) -> struct(x as h, i as p)))")).alias("s"),
    )
    repeated = placed.select(
        "*",
        F.expr(
            "array_sort(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h), x -> x.p))"
        ).alias("p"),
    )
    return repeated.select(
        "kept_columns.*",
        "n_words",
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        "n_capitals", "n_digits", "n_stops",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: A condition: feature, whether values above (or else up to) the threshold meet it, threshold.
Condition = tuple[str, bool, float]


def condition(c: Condition) -> Column:
    name, above, at = c
    value = F.expr(FEATURES[name]).cast("double")
    return value > at if above else value <= at


def conjunction(rule: list[Condition]) -> Column:
    out = condition(rule[0])
    for c in rule[1:]:
        out &= condition(c)
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """True for rows that no rule rejects; the first rule that holds decides."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(conjunction(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def _cuts(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Thresholds of each feature: quantiles of the rejected and of the accepted rows."""
    steps = [k / bins for k in range(1, bins)]
    exact = F.lit(10_000)
    wanted = [
        F.percentile_approx(F.when(F.col("bad") == v, F.expr(e).cast("double")), steps, exact).alias(f"{name}_{v}")
        for name, e in FEATURES.items()
        for v in (0, 1)
    ]
    found = rows.agg(*wanted).first()
    return {name: sorted({x for v in (0, 1) for x in found[f"{name}_{v}"] or []}) for name in FEATURES}


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Of each feature the (rejected, accepted) rows of each bin between its thresholds."""
    names = [n for n in cuts if cuts[n]]
    pairs = ", ".join(f"'{n}', cast({FEATURES[n]} as double)" for n in names)
    found = {n: [[0, 0] for _ in range(len(cuts[n]) + 1)] for n in names}
    if names:
        # One row per feature and row, counted by value bin.
        bins = F.when(F.lit(False), 0)
        for n in names:
            bins = bins.when(F.col("f") == n, F.size(F.filter(F.array(*[F.lit(c) for c in cuts[n]]), lambda c: F.col("x") > c)))
        long = rows.select("bad", F.expr(f"stack({len(names)}, {pairs}) as (f, x)"))
        for r in long.groupBy("f", bins.alias("bin"), "bad").count().collect():
            found[r["f"]][r["bin"]][1 - r["bad"]] = r["count"]
    return {n: [tuple(x) for x in v] for n, v in found.items()}


def _best(counts: dict[str, list[tuple[int, int]]], cuts: dict[str, list[float]], least: int) -> tuple[float, Condition | None, int, int]:
    """The condition of most gain over the counted rows, and what it covers."""
    best: tuple[float, Condition | None, int, int] = (0.0, None, 0, 0)
    for name, bins in counts.items():
        p0, n0 = sum(b[0] for b in bins), sum(b[1] for b in bins)
        if not p0:
            continue
        before = math.log2(p0 / (p0 + n0))
        p, n = 0, 0
        for (bp, bn), at in zip(bins, cuts[name]):
            p, n = p + bp, n + bn
            for above, cp, cn in ((False, p, n), (True, p0 - p, n0 - n)):
                if cp >= least:
                    gain = cp * (math.log2(cp / (cp + cn)) - before)
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, above, at), cp, cn)
    return best


def learn(
    stats: DataFrame, labels: DataFrame, bins: int = 40, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9
) -> list[list[Condition]]:
    """Rules that reject, in order, from all labelled rows that pass the base rules."""
    marks = labels.select("doc_id", F.col("quality").alias("q")).where("q in (0, 1)").groupBy("doc_id").agg((1 - F.min("q")).alias("bad"))
    rows = staged(
        stats.where(~base_failed()).join(marks, "doc_id").withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(3)) != 0), "marked"
    )
    cuts, rules = _cuts(rows, bins), []
    left, base = rows, rows.agg(F.sum("bad")).first()[0] or 0
    least = max(1, int(0.002 * base))
    while len(rules) < most_rules:
        grow, rule = left.where("grow"), []
        while len(rule) < most_conditions:
            gain, found, p, n = _best(_counts(grow, cuts), cuts, least)
            if found is None or gain < 0.5:
                break
            rule.append(found)
            grow = grow.where(condition(found))
            if not n:
                break
        if not rule:
            break
        sums = [
            F.sum(F.when(conjunction(rule[:k]) & (F.col("bad") == v), 1).otherwise(0)).alias(f"{'gp'[v]}{k}")
            for k in range(1, len(rule) + 1)
            for v in (0, 1)
        ]
        held = left.where("not grow").agg(*sums).first()
        worth = [((held[f"p{k}"] or 0) + 1, (held[f"g{k}"] or 0) + 1, k) for k in range(1, len(rule) + 1)]
        p, g, k = max(worth, key=lambda x: ((x[0] - x[1]) / (x[0] + x[1]), -x[2]))
        if p / (p + g) < precision and p < precision * (p + g - 1):
            break
        rules.append(rule[:k])
        left = left.where(~conjunction(rule[:k]))
    return rules


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that the base rules and the learned list keep.

    The counts are made once to learn from and once more next to the text, which is cheaper than
    to join them with it.
    """
    known = docs.select("doc_id", "text")
    learned = learn(staged(statistics(known), "statistics"), labels)
    row = F.struct(*docs.columns).alias("row")
    # The row number keeps the condition above the counts; pushed below, it would repeat them.
    counted = statistics(docs, row).withColumn("place", F.monotonically_increasing_id())
    return counted.where(verdict(learned) & (F.col("place") >= 0)).select("row.*")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of every row with `base_failed` and `kept`."""
    stats = staged(statistics(docs), "statistics")
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", verdict(learn(stats, labels)))
