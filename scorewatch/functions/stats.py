"""Statistics of 2x2 rule tables: metrics, exact tests, intervals, BH."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import ratio
from scorewatch.roles import SEED

# The metrics derived from the four counts of a rule.
METRICS = (
    "support_count",
    "coverage",
    "base_bad_rate",
    "hit_bad_rate",
    "non_hit_bad_rate",
    "lift",
    "precision",
    "recall",
    "hit_good_rate",
    "ks_signed",
    "ks_stat",
)


def rule_metrics(df: DataFrame, *, n="n", pos="pos", hit="hit", hit_pos="hit_pos") -> DataFrame:
    """Add the rule metrics derived from the counts of a 2x2 table.

    ``ks_signed`` is the hit bad rate minus the share of goods that are hit; it
    is null when there are no goods.  A table without positives has null lift
    and recall: the caller decides whether that is an error.
    """
    n, pos, hit, hit_pos = (F.col(c).cast("long") for c in (n, pos, hit, hit_pos))
    hit_bad = ratio(hit_pos, hit)
    base = ratio(pos, n)
    good = n - pos
    hit_good = ratio(hit - hit_pos, good)
    signed = F.when(good > 0, hit_bad - hit_good)
    return df.withColumns(
        {
            "support_count": hit,
            "coverage": ratio(hit, n),
            "base_bad_rate": base,
            "hit_bad_rate": hit_bad,
            "non_hit_bad_rate": ratio(pos - hit_pos, n - hit),
            "lift": F.when(pos > 0, hit_bad / F.when(pos > 0, base)),
            "precision": hit_bad,
            "recall": F.when(pos > 0, hit_pos / F.when(pos > 0, pos)),
            "hit_good_rate": hit_good,
            "ks_signed": signed,
            "ks_stat": F.abs(signed),
        }
    )


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _tail(start: int, stop: int, step: int, first: float, n: int, k: int, m: int) -> float:
    """Sum of hypergeometric terms from ``start`` towards ``stop``, until negligible.

    ``first`` is the log of the term at ``start``; further terms follow from the
    ratio of neighbours, in blocks, so huge tables need no factorials.
    """
    total, log_term, x = 0.0, first, start
    while True:
        size = min(4096, abs(stop - x) + 1)
        xs = x + step * np.arange(size, dtype=np.float64)
        if step > 0:
            up = (k - xs) * (m - xs) / ((xs + 1) * (n - k - m + xs + 1))
        else:
            up = xs * (n - k - m + xs) / ((k - xs + 1) * (m - xs + 1))
        with np.errstate(divide="ignore"):
            logs = log_term + np.concatenate(([0.0], np.cumsum(np.log(up))))
        terms = np.exp(logs[:size])
        total += float(terms.sum())
        x += step * size
        log_term = float(logs[-1])
        if (x - stop) * step > 0 or terms[-1] <= total * 1e-17:
            return total


def fisher_two_sided(hit_pos: int, hit_neg: int, miss_pos: int, miss_neg: int) -> float:
    """Two-sided Fisher exact p-value: all tables at most as likely as the one seen."""
    n = hit_pos + hit_neg + miss_pos + miss_neg
    k, m = hit_pos + miss_pos, hit_pos + hit_neg
    lo, hi = max(0, m - (n - k)), min(k, m)
    if lo == hi:
        return 1.0
    denominator = _log_choose(n, m)

    def log_pmf(x: int) -> float:
        return _log_choose(k, x) + _log_choose(n - k, m - x) - denominator

    seen = log_pmf(hit_pos)
    # Terms that differ by less than their rounding are as likely as the observed one.
    limit = seen + 1e-7 + 4e-16 * math.lgamma(n + 2)
    mode = min(hi, max(lo, ((k + 1) * (m + 1)) // (n + 2)))
    if hit_pos == mode:
        return 1.0
    if hit_pos < mode:
        p = _tail(hit_pos, lo, -1, seen, n, k, m)
        a, b = mode, hi + 1  # first x beyond the mode that is unlikely enough
        while a < b:
            mid = (a + b) // 2
            a, b = (a, mid) if log_pmf(mid) <= limit else (mid + 1, b)
        if a <= hi:
            p += _tail(a, hi, 1, log_pmf(a), n, k, m)
    else:
        p = _tail(hit_pos, hi, 1, seen, n, k, m)
        a, b = lo - 1, mode  # last x before the mode that is unlikely enough
        while a < b:
            mid = (a + b + 1) // 2
            a, b = (mid, b) if log_pmf(mid) <= limit else (a, mid - 1)
        if a >= lo:
            p += _tail(a, lo, -1, log_pmf(a), n, k, m)
    return min(1.0, p)


@F.pandas_udf(T.DoubleType())
def _fisher(hp: pd.Series, hn: pd.Series, mp: pd.Series, mn: pd.Series) -> pd.Series:
    return pd.Series(
        [fisher_two_sided(*(int(v) for v in row)) for row in zip(hp, hn, mp, mn)], dtype="float64"
    )


def fisher_p(n: str, pos: str, hit: str, hit_pos: str) -> Column:
    """Fisher p-value from the counts of a rule table (one row per rule, not per data row)."""
    n, pos, hit, hp = (F.col(c).cast("long") for c in (n, pos, hit, hit_pos))
    return _fisher(hp, hit - hp, pos - hp, n - pos - (hit - hp))


def lift_interval(
    n: str, pos: str, hit: str, hit_pos: str, *, rounds: int = 500, confidence: float = 0.95
) -> Column:
    """Stratified bootstrap interval of the lift, as ``struct<lower, upper>``.

    Positives and negatives are resampled separately, so a replicate depends on
    the rows only through two binomial counts; drawing those directly gives the
    same distribution as resampling rows, at no cost per data row.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    if not 0 < confidence < 1:
        raise ValueError("confidence must be between 0 and 1")
    tail = (1 - confidence) / 2

    @F.pandas_udf("lower double, upper double")
    def draw(n: pd.Series, pos: pd.Series, hit: pd.Series, hp: pd.Series) -> pd.DataFrame:
        out = []
        for n_, p_, h_, hp_ in zip(n, pos, hit, hp):
            if not p_:
                out.append((None, None))
                continue
            rng = np.random.default_rng(SEED)
            bad = rng.binomial(p_, hp_ / p_, size=rounds)
            neg = n_ - p_
            good = rng.binomial(neg, (h_ - hp_) / neg, size=rounds) if neg else 0 * bad
            support = bad + good
            rate = np.divide(bad, support, out=np.zeros(rounds), where=support > 0)
            out.append(tuple(np.quantile(rate / (p_ / n_), [tail, 1 - tail])))
        return pd.DataFrame(out, columns=["lower", "upper"])

    return draw(*(F.col(c).cast("long") for c in (n, pos, hit, hit_pos)))


def adjusted_p(p: str = "p_value", *, by: Sequence[str] = (), key: str = "rule_id") -> Column:
    """Benjamini-Hochberg adjusted p-values over a rule table (at most a few hundred rows)."""
    m = F.count("*").over(W.partitionBy(*by))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(p), F.col(key)))
    return F.struct((F.col(p) * m / rank).alias("raw"), rank.alias("rank"))


def with_adjusted_p(df: DataFrame, *, p: str = "p_value", by: Sequence[str] = (), key="rule_id"):
    """Add ``adjusted_p_value``: ``min`` over larger ranks of ``p * m / rank``, at most 1."""
    ranked = df.withColumn("_bh", adjusted_p(p, by=by, key=key))
    back = W.partitionBy(*by).orderBy(F.col("_bh.rank").desc())
    return ranked.withColumn(
        "adjusted_p_value",
        F.least(F.lit(1.0), F.min("_bh.raw").over(back.rowsBetween(W.unboundedPreceding, 0))),
    ).drop("_bh")


#: Up to this size of the larger sample the two-sample distribution is counted exactly.
KS_EXACT_LIMIT = 10_000


def ks_exact(statistic: float, bad: int, good: int) -> float:
    """Chance that two samples of one continuous distribution are at least this far apart.

    An ordering of both samples is a lattice path from (0, 0) to (bad, good), all equally likely.
    The paths move forward together, one step at a time; what leaves the band around the diagonal
    is added up, so small chances keep their digits.
    """
    common = math.gcd(bad, good)
    a, b = bad // common, good // common
    width = round(statistic * a * good)
    if width <= 0:
        return 1.0
    left = 0.0
    inside = np.zeros(bad + 1)
    inside[0] = 1.0
    i = np.arange(bad + 1, dtype=np.int64)
    for step in range(bad + good):
        rest = bad + good - step
        first = max(0, step - good)
        j = step - i
        up = inside * np.where(j >= 0, good - j, 0) / rest
        up[1:] += inside[:-1] * (bad - i[:-1]) / rest
        up[:first] = 0.0
        outside = np.abs(i * b - (step + 1 - i) * a) >= width
        left += up[outside].sum()
        up[outside] = 0.0
        inside = up
    return float(min(1.0, left))


@F.pandas_udf(T.DoubleType())
def _ks_exact(statistic: pd.Series, bad: pd.Series, good: pd.Series) -> pd.Series:
    found = [
        None if d is None or math.isnan(d) else ks_exact(float(d), int(m), int(n))
        for d, m, n in zip(statistic, bad, good)
    ]
    return pd.Series(found, dtype="float64")


def ks_p_value(statistic: Column, bad: Column, good: Column) -> Column:
    """Two-sided p-value of the two-sample KS statistic, for a table with a row per test.

    Exact while both samples have at most ``KS_EXACT_LIMIT`` rows, Kolmogorov's limit law beyond.
    """
    m, n = bad.cast("double"), good.cast("double")
    lam = F.sqrt(m * n / (m + n)) * statistic
    # The theta form converges fast for small lambda, the alternating form for large.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    limit = F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series))
    )
    small = F.greatest(bad, good) <= KS_EXACT_LIMIT
    exact = _ks_exact(F.when(small, statistic), F.when(small, bad), F.when(small, good))
    return F.when(small, exact).otherwise(limit)
