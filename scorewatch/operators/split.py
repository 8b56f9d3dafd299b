"""Train / test / holdout splits, samples and period splits.

Splits never move rows between tasks to rank them: a tiny count table decides
the boundary and every row is labelled where it is.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.functions.expr import day_of
from scorewatch.functions.ranks import running_totals
from scorewatch.roles import SEED
from scorewatch.sources.scratch import staged

TRAIN, TEST, HOLDOUT = "train", "test", "holdout"
FALLBACK_LIMITATION = (
    "Institution x target stratification unavailable; fell back to target-only stratification"
)
HASH_BUCKETS, HASH_LEVELS = 4096, 2
_COPY_CHUNK = 1000


# --- by time ----------------------------------------------------------------


def date_counts(df: DataFrame, snapshot: str) -> DataFrame:
    """Rows per snapshot date with running totals (one row per calendar date)."""
    day = day_of(snapshot, df.schema[snapshot].dataType)
    order = W.orderBy("day")
    return (
        df.groupBy(day.alias("day"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("day").isNotNull())
        .select(
            "day",
            "n",
            F.row_number().over(order).alias("i"),
            F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cum"),
            F.sum("n").over(W.partitionBy()).alias("total"),
            F.count("*").over(W.partitionBy()).alias("dates"),
        )
    )


def time_boundaries(df: DataFrame, snapshot: str) -> DataFrame:
    """One row: last train date, last test date, number of dates.

    The boundaries are the date ends closest to 60% and 80% of the rows, the
    earlier one on a tie, leaving at least one date for each part.
    """
    counts = date_counts(df, snapshot)

    def closest(tenths: int, condition: Column) -> Column:
        gap = F.abs(10 * F.col("cum") - tenths * F.col("total"))
        return F.min(F.when(condition, F.struct(gap.alias("gap"), F.col("i"), F.col("day"))))

    i, g = F.col("i"), F.col("dates")
    # The window covers the calendar dates only.
    train = closest(6, (g >= 3) & (i <= g - 2)).over(W.partitionBy())
    found = counts.withColumn("a", train).agg(
        closest(8, (i > F.col("a.i")) & (i <= g - 1)).alias("b"),
        F.max("a").alias("a"),
        F.min(F.when(g == 2, F.col("day"))).alias("first_day"),
        F.max("day").alias("last_day"),
        F.max("dates").alias("date_count"),
    )
    return found.select(
        F.coalesce("a.day", "first_day", "last_day").alias("train_end"),
        F.coalesce("b.day", "last_day").alias("test_end"),
        F.coalesce("date_count", F.lit(0)).alias("date_count"),
    )


def time_split(df: DataFrame, snapshot: str, name: str = "partition") -> DataFrame:
    """Add train / test / holdout by whole snapshot dates; null dates are dropped
    (``undated_rows`` counts them).

    The two boundary dates are read first, so the label is a literal comparison
    and needs neither a join nor a shuffle.
    """
    b = time_boundaries(df, snapshot).first()
    day = day_of(snapshot, df.schema[snapshot].dataType)
    if b["train_end"] is None:
        return df.limit(0).withColumn(name, F.lit(TRAIN))
    label = (
        F.when(day <= F.lit(b["train_end"]), TRAIN)
        .when(day <= F.lit(b["test_end"]), TEST)
        .otherwise(HOLDOUT)
    )
    return df.filter(day.isNotNull()).withColumn(name, label)


def undated_rows(df: DataFrame, snapshot: str) -> DataFrame:
    """One row: all rows, and those that a split by time leaves out for want of a readable date."""
    day = day_of(snapshot, df.schema[snapshot].dataType)
    return df.agg(F.count("*").alias("row_count"), F.count_if(day.isNull()).alias("excluded_rows"))


def period_boundary(df: DataFrame, snapshot: str) -> date | None:
    """Last reference date: the first 60% of the distinct dates, at least one left over."""
    cut = date_counts(df, snapshot).filter(
        F.col("i")
        == F.greatest(
            F.lit(1), F.least(F.col("dates") - 1, F.ceil(F.col("dates") * F.lit(0.6)))
        )
    )
    row = cut.filter(F.col("dates") >= 2).select("day").first()
    return row["day"] if row else None


def period_split(
    df: DataFrame,
    snapshot: str,
    *,
    time_enabled: bool = True,
    order_by: str | None = None,
    name: str = "period",
) -> DataFrame:
    """Add ``reference`` / ``current``: by dates, else the first 70% along ``order_by``.

    Spark rows have no order, so the fallback needs a numeric order column; of the
    rows that share the value at the boundary, the row hash decides which come first.
    """
    end = period_boundary(df, snapshot) if time_enabled else None
    if end is not None:
        day = day_of(snapshot, df.schema[snapshot].dataType)
        label = F.when(day <= F.lit(end), "reference").otherwise("current")
        return df.filter(day.isNotNull()).withColumn(name, label)
    if order_by is None:
        raise ValueError("a split without two dates needs order_by")
    n = df.count()
    keep = max(1, min(n - 1, n * 7 // 10))
    place = F.col(order_by).cast("double")
    counted = staged(df.groupBy(place.alias("_k")).agg(F.count("*").alias("n")), "order")
    ranked = running_totals(counted.filter(F.col("_k").isNotNull()), order=["_k"], sums=["n"])
    missing = counted.filter(F.col("_k").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Rows without an order value come first, as nulls do.
    edge = ranked.filter(F.col("cum_n") + missing > keep).agg(F.min(F.struct("_k", "cum_n", "n")).alias("e")).first()["e"]
    if edge is None or missing >= keep:
        at, need = F.col(order_by).cast("double").isNull(), keep
        before = F.lit(False)
    else:
        at, need = place == F.lit(edge["_k"]), keep - missing - (edge["cum_n"] - edge["n"])
        before = place.isNull() | (place < F.lit(edge["_k"]))
    at, before = F.coalesce(at, F.lit(False)), F.coalesce(before, F.lit(False))
    rest = df.filter(~at).withColumn(name, F.when(before, "reference").otherwise("current"))
    ties = df.filter(at).withColumn("_one", F.lit(1))
    quota = df.sparkSession.createDataFrame([(1, need)], "_one int, quota long")
    dealt = take_exact(ties, ["_one"], quota, name=name, inside="reference", outside="current")
    return rest.unionByName(dealt.drop("_one"))


# --- by stratum -------------------------------------------------------------


def class_quotas(df: DataFrame, target: str) -> DataFrame:
    """Train rows per class: floor(0.7 n) shared out by largest remainder."""
    return _class_quotas(df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("n")))


def _class_quotas(counts: DataFrame) -> DataFrame:
    """The same from the rows ``n`` of every ``target``."""
    all_classes = W.partitionBy()
    total = F.sum("n").over(all_classes)
    wanted = F.floor(F.lit(0.7) * total)
    exact = F.col("n") / total * wanted
    left = wanted - F.sum(F.floor("exact")).over(all_classes)
    turn = F.row_number().over(W.orderBy((F.col("exact") - F.floor("exact")).desc(), "target"))
    return counts.withColumn("exact", exact).withColumn("total", total).select(
        "target", "n", (F.floor("exact") + (turn <= left).cast("long")).alias("quota")
    )


def stratum_quotas(df: DataFrame, target: str, segment: str) -> DataFrame:
    """Train rows per segment x target stratum, both sides non-empty.

    The class quota is dealt out one row per stratum and turn, at most size - 1
    each.  That is a water level: every stratum gets ``min(size - 1, level)``
    and the first few strata in label order one more.  ``feasible`` is false
    where the whole split must fall back to classes only.
    """
    names = [F.col(segment).alias("segment"), F.col(target).alias("target")]
    return _stratum_quotas(df.groupBy(*names).agg(F.count("*").alias("size")))


def _class_shapes(strata: DataFrame) -> DataFrame:
    """A row per class: strata ``m``, ``quota``, sum of ``size - 1``, and whether the split is feasible."""
    # Counting needs no order, so this is the part that may run over one stratum per row.
    classes = strata.groupBy("target").agg(
        F.sum("size").alias("n"),
        F.count("*").alias("m"),
        F.sum(F.col("size") - 1).alias("cap_total"),
        F.min("size").alias("small"),
    )
    classes = staged(classes, "classes")
    quotas = _class_quotas(classes).select(F.col("target").alias("_t"), "quota")
    each = (F.col("quota") >= F.col("m")) & (F.col("quota") <= F.col("cap_total")) & (F.col("small") >= 2)
    feasible = F.min(each.cast("int")).over(W.partitionBy()) == 1
    return (
        classes.join(quotas, F.col("target").eqNullSafe(F.col("_t")))
        .withColumn("feasible", feasible)
        .select("target", "m", "quota", "feasible")
    )


def _stratum_quotas(strata: DataFrame) -> DataFrame:
    """The same from the rows ``size`` of every ``segment`` and ``target``.

    The water level comes from the strata counted by their size.  Sizes that differ add up to the
    rows at most, so n rows have fewer than sqrt(2 n) of them, however many strata there are.  The
    place in label order, which decides who gets one more, is a running total over ranges of labels.
    """
    strata = staged(strata.withColumn("cap", F.col("size") - 1), "strata")
    shapes = staged(_class_shapes(strata), "shapes").withColumnRenamed("target", "_t")
    whole = W.partitionBy("target")
    upward = whole.orderBy("cap").rowsBetween(W.unboundedPreceding, 0)
    sizes = (
        strata.groupBy("target", "cap")
        .agg(F.count("*").alias("c"))
        .withColumns(
            {
                "cap_sum": F.sum(F.col("cap") * F.col("c")).over(upward),
                "over": F.sum("c").over(whole) - F.sum("c").over(upward),
            }
        )
        .withColumn("filled", F.col("cap_sum") + F.col("over") * F.col("cap"))
        .join(F.broadcast(shapes), F.col("target").eqNullSafe(F.col("_t")))
    )
    # Strata that are full at the water level, and what is left for the others.
    full = F.col("filled") <= F.col("quota")
    levels = (
        sizes.groupBy("_t", "m", "quota", "feasible")
        .agg(
            F.coalesce(F.sum(F.when(full, F.col("c"))), F.lit(0)).alias("n_full"),
            F.coalesce(F.max(F.when(full, F.col("cap"))), F.lit(0)).alias("cap_full"),
            F.coalesce(F.max(F.when(full, F.col("filled"))), F.lit(0)).alias("fill_full"),
        )
        .withColumn("open", F.greatest(F.col("m") - F.col("n_full"), F.lit(1)))
        .withColumn("rest", F.col("quota") - F.col("fill_full"))
        .withColumn("level", F.col("cap_full") + F.floor(F.col("rest") / F.col("open")))
        .select("_t", "feasible", "level", (F.col("rest") % F.col("open")).alias("left"))
    )
    label = F.coalesce(F.concat(F.lit('"'), F.col("segment").cast("string"), F.lit('"')), F.lit("null"))
    joined = strata.join(F.broadcast(staged(levels, "levels")), F.col("target").eqNullSafe(F.col("_t")))
    placed = running_totals(
        joined.withColumns({"label": label, "above": (F.col("cap") > F.col("level")).cast("long")}),
        by=["target"], order=["label"], sums=["above"],
    )
    extra = ((F.col("above") == 1) & (F.col("cum_above") <= F.col("left"))).cast("long")
    return placed.select(
        "segment", "target", "size", (F.least(F.col("cap"), F.col("level")) + extra).alias("quota"), "feasible"
    )


def _hash_part(level: int) -> Column:
    return F.shiftrightunsigned("_h", 12 * level).bitwiseAND(F.lit(HASH_BUCKETS - 1))


def take_exact(
    df: DataFrame,
    strata: Sequence[str],
    quotas: DataFrame,
    *,
    seed: int = SEED,
    name: str = "partition",
    inside: str = TRAIN,
    outside: str = TEST,
) -> DataFrame:
    """Label exactly ``quota`` rows of every stratum ``inside``, chosen by row hash.

    Counting rows per hash bucket finds the bucket where the quota is used up;
    rows of other buckets are labelled in place.  The boundary bucket is cut once
    more by further bits of the hash, so what is ranked is one of 16 million
    parts of a stratum, and there equal rows are counted, not listed: a large
    group of copies is one row until it is written out again.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns))
    counts = hashed.groupBy(*strata, _hash_part(0).alias("_b")).agg(F.count("*").alias("_n"))
    return _take(hashed, strata, counts, quotas, name, inside, outside)


def _take(
    hashed: DataFrame, strata: Sequence[str], counts: DataFrame, quotas: DataFrame, name: str, inside: str, outside: str
) -> DataFrame:
    """``take_exact`` on rows with their hash ``_h``, from the rows ``_n`` of every first bucket ``_b``."""
    columns = [c for c in hashed.columns if c != "_h"]
    keys = [f"_k_{s}" for s in strata]
    wanted = quotas.select(
        *[F.col(s).alias(k) for s, k in zip(strata, keys)], F.col("quota").cast("long").alias("_q")
    )
    first = staged(_border(counts, strata, wanted), "border")
    edge = hashed.join(first, _same(hashed, strata)).filter(_hash_part(0) == F.col("_border"))
    again = edge.groupBy(*strata, _hash_part(1).alias("_b")).agg(F.count("*").alias("_n"))
    rest = first.select(*keys, (F.col("_q") - F.col("_before")).alias("_q"))
    second = _border(again, strata, rest).select(
        *[F.col(k).alias(f"_2{k}") for k in keys],
        F.col("_border").alias("_border2"),
        (F.col("_q") - F.col("_before")).alias("_left"),
    )
    both = F.lit(True)
    for k in keys:
        both = both & F.col(k).eqNullSafe(F.col(f"_2{k}"))
    marks = staged(
        first.join(second, both, "left").select(*keys, "_border", "_border2", "_left"), "marks"
    )
    placed = hashed.join(marks, _same(hashed, strata)).withColumn(
        "_side",
        F.when(_hash_part(0) < F.col("_border"), inside)
        .when(_hash_part(0) > F.col("_border"), outside)
        .when(_hash_part(1) < F.col("_border2"), inside)
        .when(_hash_part(1) > F.col("_border2"), outside),
    )
    settled = placed.filter(F.col("_side").isNotNull()).select(*columns, F.col("_side").alias(name))
    rank = W.partitionBy(*strata).orderBy("_h", *columns).rowsBetween(W.unboundedPreceding, 0)
    kept = (
        placed.filter(F.col("_side").isNull())
        .groupBy(*columns, "_h", "_left")
        .agg(F.count("*").alias("_m"))
        .withColumn("_cum", F.sum("_m").over(rank))
        .withColumn(
            "_in",
            F.greatest(F.lit(0), F.least(F.col("_m"), F.col("_left") - (F.col("_cum") - F.col("_m")))),
        )
        .select(
            *columns,
            F.explode(
                F.array(
                    F.struct(F.lit(inside).alias(name), F.col("_in").alias("_m")),
                    F.struct(F.lit(outside).alias(name), (F.col("_m") - F.col("_in")).alias("_m")),
                )
            ).alias("_s"),
        )
        .select(*columns, "_s.*")
    )
    return settled.unionByName(repeat_rows(kept, "_m"))


def _same(left: DataFrame, strata: Sequence[str]) -> Column:
    condition = F.lit(True)
    for s in strata:
        condition = condition & left[s].eqNullSafe(F.col(f"_k_{s}"))
    return condition


def _border(counts: DataFrame, strata: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Per stratum the bucket that the quota ends in, and the rows in the buckets before it."""
    order = W.partitionBy(*strata).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    running = counts.withColumn("_cum", F.sum("_n").over(order))
    return (
        running.join(wanted, _same(running, strata))
        .groupBy(*[f"_k_{s}" for s in strata], "_q")
        .agg(
            F.min(F.when(F.col("_cum") > F.col("_q"), F.col("_b"))).alias("_border"),
            F.coalesce(F.max(F.when(F.col("_cum") <= F.col("_q"), F.col("_cum"))), F.lit(0)).alias(
                "_before"
            ),
        )
        .withColumn("_border", F.coalesce("_border", F.lit(HASH_BUCKETS)))
    )


def repeat_rows(df: DataFrame, copies: str) -> DataFrame:
    """Write every row ``copies`` times, in chunks so that no array grows with the data."""
    chunks = df.filter(F.col(copies) > 0).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({copies} - 1) div {_COPY_CHUNK}")))
    )
    size = F.least(F.lit(_COPY_CHUNK).cast("long"), F.col(copies) - F.col("_c") * _COPY_CHUNK)
    return chunks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size))).drop(
        "_c", "_i", copies
    )


def stratified_split(
    df: DataFrame, target: str, segment: str, *, seed: int = SEED
) -> tuple[DataFrame, list[str]]:
    """70/30 split with every segment x target stratum on both sides.

    Falls back to classes only, with a limitation text, when some stratum has a
    single row or the class quota cannot be dealt out.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), *df.columns))
    # One count of the rows gives the strata, the classes and the hash buckets.
    counted = staged(
        hashed.groupBy(segment, target, _hash_part(0).alias("_b")).agg(F.count("*").alias("_n")), "buckets"
    )
    strata = counted.groupBy(F.col(segment).alias("segment"), F.col(target).alias("target")).agg(
        F.sum("_n").alias("size")
    )
    strata = staged(strata, "sizes")
    # Whether the strata can be served at all is known from the classes, before any is put in order.
    if _class_shapes(strata).agg(F.min(F.col("feasible").cast("int"))).first()[0] == 1:
        quotas = staged(_stratum_quotas(strata), "quotas")
        named = quotas.select(F.col("segment").alias(segment), F.col("target").alias(target), "quota")
        return _take(hashed, [segment, target], counted, named, "partition", TRAIN, TEST), []
    classes = counted.groupBy(target, "_b").agg(F.sum("_n").alias("_n"))
    sizes = strata.groupBy("target").agg(F.sum("size").alias("n"))
    named = _class_quotas(sizes).select(F.col("target").alias(target), "quota")
    return _take(hashed, [target], classes, named, "partition", TRAIN, TEST), [FALLBACK_LIMITATION]


def discovery_sample(df: DataFrame, rows: int, *, seed: int = SEED) -> DataFrame:
    """A fixed-size random sample: the ``rows`` rows of lowest hash, found as :func:`take_exact` does.

    Counting hash buckets finds the bucket in which the sample ends; rows are neither sorted nor sent
    to one task.  A table of fewer rows is returned whole.
    """
    quota = df.sparkSession.createDataFrame([(1, rows)], "_one int, quota long")
    drawn = take_exact(df.withColumn("_one", F.lit(1)), ["_one"], quota, seed=seed, name="_side", inside="in", outside="out")
    return drawn.filter(F.col("_side") == "in").drop("_one", "_side")


def segment_subset(df: DataFrame, segment: str, value: str) -> DataFrame:
    return df.filter(F.col(segment).cast("string") == value)


def partition_gates(df: DataFrame, target: str, partition: str = "partition") -> DataFrame:
    """Which partitions can be used: rows, positives and the blocking reason."""
    expected = df.sparkSession.createDataFrame([(p,) for p in (TRAIN, TEST, HOLDOUT)], "name string")
    counts = df.groupBy(F.col(partition).alias("name")).agg(
        F.count("*").alias("row_count"), F.sum(F.col(target).cast("long")).alias("positives")
    )
    n, p = F.coalesce("row_count", F.lit(0)), F.coalesce("positives", F.lit(0))
    hold = F.col("name") == HOLDOUT
    reason = (
        F.when(hold & (n == 0), "Holdout partition is empty; validation unavailable")
        .when(
            hold & ((p == 0) | (p == n)),
            "Holdout partition has a single target class; validation unavailable",
        )
        .when(
            ~hold & (p == 0),
            F.concat(
                F.initcap("name"),
                F.lit(" partition has no positive target; validation unavailable"),
            ),
        )
    )
    return expected.join(counts, "name", "left").select(
        F.col("name").alias("partition"), n.alias("row_count"), p.alias("positives"),
        reason.alias("limitation"), reason.isNull().alias("usable"),
    )
