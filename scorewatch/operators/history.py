"""Entity-level features from history tables, several windows in one pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.sources.tables import history_tables

ENTITY = "SK_ID_CURR"
SNAPSHOT_TEXT = "public_relative_reference"


@dataclass(frozen=True)
class Window:
    """Rows whose age column is at least ``-length``; ``suffix`` ends the feature names."""

    age: str
    length: int
    suffix: str

    @property
    def inside(self) -> Column:
        return F.col(self.age) >= -self.length


Aggregate = Callable[[Column], Column]


def total(value: str) -> Aggregate:
    """Sum of non-null values, 0 when all are null."""
    return lambda inside: F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0))


def mean(value: Column | str) -> Aggregate:
    v = F.col(value) if isinstance(value, str) else value
    return lambda inside: F.avg(F.when(inside, v.cast("double")))


def largest(value: str) -> Aggregate:
    return lambda inside: F.max(F.when(inside, F.col(value)))


def rows() -> Aggregate:
    return lambda inside: F.count_if(inside)


def count_where(condition: Column) -> Aggregate:
    return lambda inside: F.count_if(inside & condition)


def distinct(value: str) -> Aggregate:
    """Distinct values, null counted as a value."""

    def aggregate(inside: Column) -> Column:
        nulls = F.coalesce(F.max(F.when(inside, F.col(value).isNull().cast("long"))), F.lit(0))
        return F.count_distinct(F.when(inside, F.col(value))) + nulls

    return aggregate


def sum_ratio(above: str, below: str) -> Aggregate:
    """Sum over sum where the lower sum is positive, else null."""

    def aggregate(inside: Column) -> Column:
        low = F.sum(F.when(inside, F.col(below)))
        high = F.coalesce(F.sum(F.when(inside, F.col(above))), F.lit(0))
        return F.when(low > 0, high / F.when(low > 0, low))

    return aggregate


def window_features(
    history: DataFrame,
    entity: str,
    windows: Sequence[Window],
    features: Mapping[str, Aggregate],
    overall: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All features of all windows with one grouped aggregate.

    An entity without a row inside a window gets null for that window, as if
    the window had been aggregated on its own and joined back.
    """
    aggs = []
    for w in windows:
        for name, aggregate in features.items():
            value = F.when(F.count_if(w.inside) > 0, aggregate(w.inside))
            aggs.append(value.alias(f"{name}_{w.suffix}"))
    aggs += [column.alias(name) for name, column in (overall or {}).items()]
    return history.groupBy(F.col(entity).alias("entity_id")).agg(*aggs)


def days(age: str, *lengths: int) -> list[Window]:
    return [Window(age, n, f"{n}d") for n in lengths]


def months(age: str, *lengths: int) -> list[Window]:
    return [Window(age, n, f"{n}m") for n in lengths]


def previous_applications(history: DataFrame) -> DataFrame:
    refused = F.avg((F.col("NAME_CONTRACT_STATUS") == "Refused").cast("double"))
    return window_features(
        history,
        ENTITY,
        days("DAYS_DECISION", 30, 90, 365),
        {
            "prev_application_cnt": rows(),
            "prev_application_amt": total("AMT_APPLICATION"),
            "prev_credit_amt": total("AMT_CREDIT"),
        },
        {"prev_refused_rate_all": refused},
    )


def installments(history: DataFrame) -> DataFrame:
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    overdue = F.when(late.isNotNull(), F.greatest(late, F.lit(0)))
    return window_features(
        history,
        ENTITY,
        days("DAYS_INSTALMENT", 30, 90, 365),
        {
            "inst_record_cnt": rows(),
            "inst_overdue_days_mean": mean(overdue),
            "inst_underpayment_rate": mean(F.col("AMT_PAYMENT") < F.col("AMT_INSTALMENT")),
        },
    )


def pos_balances(history: DataFrame) -> DataFrame:
    return window_features(
        history,
        ENTITY,
        months("MONTHS_BALANCE", 3, 6, 12),
        {
            "pos_active_month_cnt": distinct("MONTHS_BALANCE"),
            "pos_dpd_mean": mean("SK_DPD"),
            "pos_dpd_max": largest("SK_DPD"),
        },
    )


def credit_cards(history: DataFrame) -> DataFrame:
    return window_features(
        history,
        ENTITY,
        months("MONTHS_BALANCE", 3, 6, 12),
        {
            "cc_balance_mean": mean("AMT_BALANCE"),
            "cc_payment_balance_ratio": sum_ratio("AMT_PAYMENT_CURRENT", "AMT_BALANCE"),
            "cc_dpd_max": largest("SK_DPD"),
        },
    )


def bureau_records(history: DataFrame) -> DataFrame:
    return window_features(
        history,
        ENTITY,
        days("DAYS_CREDIT", 90, 365),
        {
            "bureau_query_cnt": rows(),
            "bureau_active_credit_cnt": count_where(F.col("CREDIT_ACTIVE") == "Active"),
            "bureau_debt_credit_ratio": sum_ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"),
        },
    )


AGGREGATES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "previous_application": previous_applications,
    "installments_payments": installments,
    "POS_CASH_balance": pos_balances,
    "credit_card_balance": credit_cards,
    "bureau": bureau_records,
}


def prepare_history(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Base rows with the features of every history table, left joined on the entity.

    Each side is already one row per entity; the physical join is left to the
    optimizer, which broadcasts a side only when its size allows it.
    """
    known = history_tables(tables)
    prepared = known["application_train"].select(
        F.col(ENTITY).alias("entity_id"),
        F.col("TARGET").alias("target"),
        F.col("NAME_INCOME_TYPE").alias("customer_segment"),
        F.lit(SNAPSHOT_TEXT).alias("snapshot_date"),
    )
    for name, aggregate in AGGREGATES.items():
        if name in known:
            prepared = prepared.join(aggregate(known[name]), "entity_id", "left")
    return prepared
