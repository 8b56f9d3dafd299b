"""Running totals and exact quantiles that never sort one group in one task.

Quantiles are selected by rounds of histograms: values are counted in ordered ranges, and only the
range that holds a wanted rank is looked at again, until it holds one distinct value.  Running totals
are a prefix sum over a range partitioning: every task adds up its own sorted rows, and the totals of
the partitions before it are added.  Both work alike at every size, on any distribution, and for all
groups and columns at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import batches, finite, number, quoted, union_all
from scorewatch.sources.scratch import staged

# --- running totals -------------------------------------------------------------------


def _prefix_sums(keys: int, by: Sequence[str], sums: Sequence[str], following: str | None):
    """A function over the sorted rows of a partition: sums so far within ``by``, next value."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: tuple | None = None
        carried = [0] * len(sums)
        waiting: pa.RecordBatch | None = None

        def finished(batch: pa.RecordBatch, starts: np.ndarray, after) -> pa.RecordBatch:
            if following is None:
                return batch
            values = batch.column(following)
            ahead = np.full(len(values), None, dtype=object)
            ahead[:-1] = values.to_pylist()[1:]
            ahead[np.maximum(starts - 1, 0)[starts > 0]] = None
            ahead[-1] = after
            return batch.append_column("_lead", pa.array(ahead.tolist(), values.type))

        for batch in found:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in by]
            new = np.zeros(batch.num_rows, dtype=bool)
            for values in columns:
                values = np.array(values, dtype=object)
                new[1:] |= values[1:] != values[:-1]
            key = tuple(values[0] for values in columns)
            same = last is not None and key == last
            starts = np.flatnonzero(new) if same else np.append(0, np.flatnonzero(new))
            made = batch.append_column("_part", pa.array(np.full(batch.num_rows, part, dtype=np.int32)))
            edges = np.unique(np.append(0, starts))
            group = np.repeat(np.arange(len(edges)), np.diff(np.append(edges, batch.num_rows)))
            for k, name in enumerate(sums):
                values = batch.column(name).to_numpy(zero_copy_only=False)
                total = np.cumsum(values)
                base = np.where(edges > 0, total[edges - 1], 0)
                run_sum = total - base[group]
                if same:
                    run_sum[group == 0] += carried[k]
                carried[k] = run_sum[-1]
                made = made.append_column(f"_l_{name}", pa.array(run_sum))
            if waiting is not None:
                after = batch.column(following)[0].as_py() if following is not None and same else None
                yield finished(waiting, waiting_starts, after)
            waiting, waiting_starts, last = made, starts, tuple(values[-1] for values in columns)
        if waiting is not None:
            yield finished(waiting, waiting_starts, None)

    return run


def running_totals(
    df: DataFrame,
    *,
    by: Sequence[str] = (),
    order: Sequence[str],
    sums: Sequence[str],
    following: str | None = None,
) -> DataFrame:
    """Add ``cum_<s>`` running sums over ``order`` within ``by``; the result is a stage table.

    ``following`` names an order column whose value in the next row is added as ``next_<column>``.  One
    shuffle deals the rows out by ranges of ``by`` and ``order``; however many rows a group has, it is
    spread over as many partitions.  What is joined back has one row per group and partition that the
    group reaches into.
    """
    keys = [*by, *order]
    kinds = {f.name: f.dataType for f in df.schema}
    fields = [*df.schema.fields, T.StructField("_part", T.IntegerType())]
    for s in sums:
        whole = isinstance(kinds[s], T.IntegralType)
        fields.append(T.StructField(f"_l_{s}", T.LongType() if whole else T.DoubleType()))
    if following is not None:
        fields.append(T.StructField("_lead", kinds[following]))
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = staged(ranged.mapInArrow(_prefix_sums(len(keys), by, sums, following), T.StructType(fields)), "prefix")
    firsts = [F.min(following).alias("_first")] if following else []
    one = F.lit(0).alias("_all")
    totals = local.groupBy(one, *by, "_part").agg(*[F.sum(s).alias(s) for s in sums], *firsts)
    parts = W.partitionBy("_all", *by).orderBy("_part")
    before = parts.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_b_{c}") for c in by],
        F.col("_part").alias("_at"),
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *([F.lead("_first").over(parts).alias("_next")] if following else []),
    )
    same = reduce(
        lambda a, c: a & F.col(c).eqNullSafe(F.col(f"_b_{c}")), by, F.col("_part") == F.col("_at")
    )
    return local.join(offsets, same).select(
        *df.columns,
        *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums],
        *([F.coalesce("_lead", "_next").alias(f"next_{following}")] if following else []),
    )


# --- quantiles ------------------------------------------------------------------------

#: Ranges of the first histogram for each doubling of the value.
RANGES_PER_DOUBLING = 64
#: Ranges into which every further round cuts a range that is still open.
RANGES_PER_ROUND = 512


class _Range(NamedTuple):
    """An ordered range of values: its group and column, least and largest value, rows below, rows in it."""

    group: str | None
    feature: str
    low: float
    high: float
    below: int
    rows: int


def range_place(v: Column) -> Column:
    """Number of the range of equal ratio that a finite value lies in; zero is a range by itself."""
    # The logarithm never falls when its argument rises, so ranges are ordered as values are.
    size = F.floor(F.log2(F.abs(v)) * RANGES_PER_DOUBLING) + 80_000
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def first_ranges(df: DataFrame, columns: Sequence[str], by: str | None) -> list[_Range]:
    """Rows of every column in ranges of equal ratio, zero by itself: one pass over the rows.

    The number of ranges depends on the spread of the values only (a double has 2,100 doublings).
    """
    place = range_place(F.col("v"))
    frames = []
    for names in batches(columns, 32):
        frames.append(_long(df, names, by, {}).groupBy("g", "feature", place.alias("place")))
    found = [f.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("rows")) for f in frames]
    rows: dict[tuple, list] = {}
    for part in found:
        for r in part.collect():
            rows.setdefault((r["g"], r["feature"]), []).append((r["place"], r["low"], r["high"], r["rows"]))
    out = []
    for (group, feature), ranges in rows.items():
        below = 0
        for _, low, high, n in sorted(ranges):
            out.append(_Range(group, feature, low, high, below, n))
            below += n
    return out


def _long(df: DataFrame, names: Sequence[str], by: str | None, only: Mapping[str, list[_Range]]) -> DataFrame:
    """``g, feature, v`` of finite values; with ``only``, of those in one of a column's ranges."""
    key = F.lit(None).cast("string") if by is None else F.col(by).cast("string")
    clean = df.select(key.alias("g"), *[finite(c).alias(f"v_{c}") for c in names])
    if only:
        picked = []
        for c in names:
            x = quoted(f"v_{c}")
            inside = " OR ".join(
                f"{x} BETWEEN {number(low)} AND {number(high)}" for low, high in sorted({(r.low, r.high) for r in only[c]})
            )
            picked.append(F.expr(f"CASE WHEN {inside} THEN {x} END").alias(f"v_{c}"))
        clean = clean.select("g", *picked)
    long = clean.unpivot(["g"], [f"v_{c}" for c in names], "feature", "v").filter(F.col("v").isNotNull())
    return long.withColumn("feature", F.expr("substring(feature, 3)"))


def _inside(long: DataFrame, open_ranges: Sequence[_Range]) -> DataFrame:
    """The rows of a long table that lie in an open range, with its number (``slot``)."""
    spark = long.sparkSession
    # One literal row per open range: columns x probabilities x groups at most.
    slots = spark.createDataFrame(
        [(k, r.group, r.feature, r.low, r.high) for k, r in enumerate(open_ranges)],
        "slot int, sg string, sf string, low double, high double",
    )
    met = F.col("g").eqNullSafe(F.col("sg")) & (F.col("feature") == F.col("sf")) & F.col("v").between(F.col("low"), F.col("high"))
    return long.join(F.broadcast(slots), met)


def _cut(inside: DataFrame, open_ranges: Sequence[_Range]) -> list[list[_Range]]:
    """Every open range in up to ``RANGES_PER_ROUND`` parts; least and largest value never share one."""
    last = RANGES_PER_ROUND - 1
    place = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * last)
    parts = inside.groupBy("slot", place.alias("place")).agg(
        F.min("v").alias("least"), F.max("v").alias("largest"), F.sum("n").alias("rows")
    )
    found: list[list] = [[] for _ in open_ranges]
    for r in parts.collect():
        found[r["slot"]].append((r["place"], r["least"], r["largest"], r["rows"]))
    out = []
    for r, ranges in zip(open_ranges, found):
        below, cut = r.below, []
        for _, low, high, n in sorted(ranges):
            cut.append(_Range(r.group, r.feature, low, high, below, n))
            below += n
        out.append(cut)
    return out


def _of_rank(ranges: Sequence[_Range], rank: int) -> _Range:
    return next(r for r in ranges if r.below <= rank < r.below + r.rows)


def few_values(
    df: DataFrame, columns: Sequence[str], most: int, first: Sequence[_Range] | None = None
) -> dict[str, list[float]]:
    """The sorted distinct finite values of the columns that have ``most`` of them at most.

    A column is given up as soon as its ranges prove more values, so none is ever listed in full.
    """
    held: dict[str, list[_Range]] = {}
    for r in first_ranges(df, columns, None) if first is None else first:
        held.setdefault(r.feature, []).append(r)
    while True:
        held = {c: ranges for c, ranges in held.items() if sum(1 + (r.low < r.high) for r in ranges) <= most}
        only = {c: [r for r in ranges if r.low < r.high] for c, ranges in held.items()}
        only = {c: ranges for c, ranges in only.items() if ranges}
        if not only:
            return {c: [r.low for r in ranges] for c, ranges in held.items()}
        open_ranges = [r for ranges in only.values() for r in ranges]
        rows = union_all([_long(df, names, None, only) for names in batches(sorted(only), 32)])
        cut = dict(zip(open_ranges, _cut(_inside(rows.withColumn("n", F.lit(1)), open_ranges), open_ranges)))
        held = {c: [x for r in ranges for x in cut.get(r, [r])] for c, ranges in held.items()}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: str | None = None,
    first: Sequence[_Range] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of the finite values of many columns, of every group of ``by``.

    Two passes read the rows: one counts them in ranges of equal ratio, one cuts the ranges that hold
    a wanted rank.  The few values in ranges that are open after that are written down, and further
    rounds read only these.  No values are sorted, and no round's result grows with the rows.
    Returns ``[by,] feature, n_finite, min_value, max_value, q`` (array, one per prob).
    """
    if not columns:
        raise ValueError("no columns")
    probs = [float(p) for p in probs]
    held: dict[tuple, list[_Range]] = {}
    for r in first_ranges(df, columns, by) if first is None else first:
        held.setdefault((r.group, r.feature), []).append(r)
    total = {k: sum(r.rows for r in ranges) for k, ranges in held.items()}

    def ranks(n: int) -> set[int]:
        return {r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}

    at = {(k, rank): _of_rank(ranges, rank) for k, ranges in held.items() for rank in ranks(total[k])}
    rest: DataFrame | None = None
    rounds = 0
    while open_ranges := sorted({r for r in at.values() if r.low < r.high}, key=repr):
        if rest is None:
            only: dict[str, list[_Range]] = {}
            for r in open_ranges:
                only.setdefault(r.feature, []).append(r)
            rows = union_all([_long(df, names, by, only) for names in batches(sorted(only), 32)])
            if rounds:
                rows = staged(rows.groupBy("g", "feature", "v").agg(F.count("*").alias("n")), "ranks")
                rest = rows
            else:
                rows = rows.withColumn("n", F.lit(1).cast("long"))
        else:
            rows = rest
        cut = dict(zip(open_ranges, _cut(_inside(rows, open_ranges), open_ranges)))
        at = {k: _of_rank(cut[r], k[1]) if r in cut else r for k, r in at.items()}
        rounds += 1
    rows_out = []
    for key, ranges in held.items():
        n, q = total[key], []
        for p in probs:
            place = (n - 1) * p
            a, b = at[key, math.floor(place)].low, at[key, math.ceil(place)].low
            q.append(a + (b - a) * (place - math.floor(place)))
        ends = (ranges[0].low, ranges[-1].high)
        rows_out.append((key[0], key[1], n, *ends, q))
    names = "feature string, n_finite long, min_value double, max_value double, q array<double>"
    out = df.sparkSession.createDataFrame(rows_out, f"{quoted(by) if by else '_g'} string, {names}")
    return out if by else out.drop("_g")


def quantile_lists(df: DataFrame) -> dict[str, dict]:
    """The model-sized result of :func:`quantiles` as Python values."""
    return {
        r["feature"]: {
            "n": r["n_finite"],
            "min": r["min_value"],
            "max": r["max_value"],
            "q": [float(v) for v in r["q"]],
        }
        for r in df.collect()
    }
