"""Predicates, binning and batching written as plain Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.roles import Condition, Rule

# Whole-stage code generation stops at 100 fields, so wide aggregates are cut
# into batches that stay below it.
AGG_BATCH = 64


def number(v: float) -> str:
    """SQL text of a double literal."""
    return f"{float(v)!r}D"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(name: str) -> Column:
    """Not null, not NaN, not infinite (never null itself).

    NaN sorts above infinity, so one comparison excludes both.
    """
    return F.expr(f"coalesce(abs(CAST({quoted(name)} AS DOUBLE)) < double('Infinity'), false)")


def finite(name: str) -> Column:
    """The column as double, or null when it is null, NaN or infinite."""
    x = f"CAST({quoted(name)} AS DOUBLE)"
    return F.expr(f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END")


def literal_sql(value: object) -> str:
    """SQL text of a condition value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        return number(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def condition_sql(condition: Condition, schema: T.StructType | None = None) -> str:
    """One comparison; null gives null, NaN in a float column never matches."""
    column = quoted(condition.feature)
    if condition.operator == "is_null":
        return f"{column} IS NULL"
    operator = {"==": "=", "!=": "<>"}.get(condition.operator, condition.operator)
    hit = f"{column} {operator} {literal_sql(condition.value)}"
    floating = schema is None or isinstance(
        schema[condition.feature].dataType, (T.FloatType, T.DoubleType)
    )
    if floating and not isinstance(condition.value, str):
        hit = f"{hit} AND NOT isnan({column})"
    return f"({hit})"


def condition_column(condition: Condition, schema: T.StructType | None = None) -> Column:
    return F.expr(condition_sql(condition, schema))


def rule_sql(rule: Rule, schema: T.StructType | None = None) -> str:
    """AND of all conditions; an empty rule matches every row, null is false."""
    if not rule.conditions:
        return "true"
    return f"coalesce({' AND '.join(condition_sql(c, schema) for c in rule.conditions)}, false)"


def rule_column(rule: Rule, schema: T.StructType | None = None) -> Column:
    return F.expr(rule_sql(rule, schema))


def bucket_sql(name: str, cuts: Sequence[float], *, closed: str = "left") -> str:
    """SQL text of the bucket number of a non-null column, as a balanced CASE tree."""
    below = "<" if closed == "left" else "<="
    x = quoted(name)

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return (
            f"CASE WHEN {x} {below} {number(cuts[mid])} THEN {tree(lo, mid)} "
            f"ELSE {tree(mid + 1, hi)} END"
        )

    return tree(0, len(cuts))


def bucket_of(name: str, cuts: Sequence[float], *, closed: str = "left") -> Column:
    """Bucket number of a finite column between literal sorted cuts.

    ``closed='left'`` counts cuts ``<= x`` (histogram bins), ``closed='right'``
    counts cuts ``< x`` (binning with left-open, right-closed bins).  The tree
    is O(log k) per row and stays inside generated code; it is written as SQL
    text because hundreds of literal comparisons are slow to build one by one.
    """
    return F.expr(f"CASE WHEN {quoted(name)} IS NOT NULL THEN {bucket_sql(name, cuts, closed=closed)} END")


def bucket_by_feature(
    feature: str, value: str, cuts: Mapping[str, Sequence[float]], *, closed: str = "left"
) -> Column:
    """Bucket number in a long table, with other literal cuts for every feature name."""
    cases = " ".join(
        "WHEN '{}' THEN {}".format(
            f.replace("\\", "\\\\").replace("'", "\\'"), bucket_sql(value, c, closed=closed)
        )
        for f, c in cuts.items()
    )
    return F.expr(f"CASE {quoted(feature)} {cases} END") if cases else F.lit(None).cast("int")


def long_bins(
    df: DataFrame,
    cuts: Mapping[str, Sequence[float]],
    *keep: str,
    closed: str = "left",
) -> DataFrame:
    """Unpivot finite values to ``keep..., feature, bin`` on literal cuts.

    The cleaned value is projected before the bucket trees use it: repeated in
    every branch it would make generated methods too large for the JIT.
    """
    nan = F.lit(float("nan"))
    frames = []
    for names in batches(cuts, 32):
        clean = df.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)],
            *[F.coalesce(finite(c), nan).alias(c) for c in names],
        )
        binned = clean.select(
            *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)],
            *[
                F.when(~F.isnan(c), bucket_of(c, cuts[c], closed=closed)).alias(f"_b_{c}")
                for c in names
            ],
        )
        long = binned.unpivot(
            list(keep), [f"_b_{c}" for c in names], "feature", "bin"
        ).filter(F.col("bin").isNotNull())
        frames.append(long.withColumn("feature", F.expr("substring(feature, 4)")))
    return union_all(frames)


def month_of(x: Column | str) -> Column:
    return F.date_format(as_col(x), "yyyy-MM")


def day_of(x: Column | str, dtype: T.DataType) -> Column:
    """Date of a date, timestamp or text column; unparsable text gives null."""
    if isinstance(dtype, T.DateType):
        return as_col(x)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return as_col(x).cast("date")
    return F.try_to_date(as_col(x).cast("string"), "yyyy-MM-dd")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where the denominator is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def batches(items: Iterable, size: int = AGG_BATCH) -> Iterator[list]:
    items = list(items)
    for start in range(0, len(items), size):
        yield items[start : start + size]


def explode_structs(df: DataFrame, structs: Sequence[Column], *keep: str) -> DataFrame:
    """One output row per struct, with the struct's fields as columns."""
    return df.select(*keep, F.explode(F.array(*structs)).alias("_s")).select(*keep, "_s.*")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


@contextmanager
def kept(df: DataFrame, *columns: str) -> Iterator[DataFrame]:
    """The given columns, held for several passes and released afterwards.

    Blocks that do not fit go to disk; blocks lost with an executor are
    computed again from the source.
    """
    held = df.select(*columns).persist()
    try:
        yield held
    finally:
        held.unpersist()


def small_table(df: DataFrame) -> DataFrame:
    """A model-sized result (alerts, causes, cards) as a literal table.

    Several later steps read it; without this each would compute it again.
    """
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, for stable comparison of results."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )
