"""Reading and writing tables: Parquet, whitelisted CSV, rules and evidence."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.expr import rule_column
from scorewatch.functions.tokens import redaction_code
from scorewatch.roles import GRADES, ContractError, Rule

CONDITIONS_TYPE = "array<struct<feature:string,operator:string,value:double>>"

# The columns read from each history table and their types.
HISTORY_SCHEMAS = {
    "application_train": (
        "SK_ID_CURR long, TARGET int, NAME_INCOME_TYPE string, DAYS_BIRTH int, "
        "AMT_INCOME_TOTAL double"
    ),
    "previous_application": (
        "SK_ID_CURR long, DAYS_DECISION int, AMT_APPLICATION double, AMT_CREDIT double, "
        "NAME_CONTRACT_STATUS string"
    ),
    "installments_payments": (
        "SK_ID_CURR long, DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, "
        "AMT_INSTALMENT double, AMT_PAYMENT double"
    ),
    "POS_CASH_balance": "SK_ID_CURR long, MONTHS_BALANCE int, SK_DPD int, SK_DPD_DEF int",
    "credit_card_balance": (
        "SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, AMT_PAYMENT_CURRENT double, "
        "SK_DPD int"
    ),
    "bureau": (
        "SK_ID_CURR long, DAYS_CREDIT int, AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, "
        "CREDIT_ACTIVE string"
    ),
}


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of the given columns in the given order."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    if len(set(columns)) != len(columns):
        raise ContractError("column names must be unique")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def read_history_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """CSV scan limited to the whitelisted columns of one history table.

    The header is matched by name; only the wanted columns are converted, with
    declared types, so no inference pass over the data is needed.  A cell that is
    not of its type is null; :func:`unreadable_cells` counts these.
    """
    wanted, header = _history_cells(spark, path, table)
    return header.select(
        *[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in wanted]
    )


def _history_cells(spark: SparkSession, path: str, table: str) -> tuple[T.StructType, DataFrame]:
    wanted = T.StructType.fromDDL(HISTORY_SCHEMAS[table])
    header = spark.read.csv(path, header=True)
    missing = [f.name for f in wanted if f.name not in header.columns]
    if missing:
        raise ContractError(f"missing columns in {table}: {', '.join(missing)}")
    return wanted, header


def unreadable_cells(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Per wanted column of a history file its rows and the cells whose text is not of the column's type."""
    wanted, header = _history_cells(spark, path, table)
    bad = [
        F.count_if(F.expr(f"`{f.name}` IS NOT NULL AND try_cast(`{f.name}` AS {f.dataType.simpleString()}) IS NULL")).alias(f.name)
        for f in wanted
    ]
    counted = header.agg(F.count("*").alias("_rows"), *bad)
    return counted.unpivot(["_rows"], [f.name for f in wanted], "column", "unreadable").withColumnRenamed("_rows", "row_count")


def history_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The base table and the history tables present; one of each is required."""
    if "application_train" not in tables:
        raise ContractError("history input must include application_train")
    known = {name: tables[name] for name in HISTORY_SCHEMAS if name in tables}
    if len(known) < 2:
        raise ContractError("history input must include at least one history table")
    return known


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd compression (column statistics are always written)."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count, xor and sum of row hashes; one row."""
    h = F.xxhash64(*df.columns)
    return df.agg(
        F.count("*").alias("row_count"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """The same for texts and whole numbers, by SHA-256 of the row's text, which any engine repeats."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")
    # 48-bit numbers: a sum of longs would overflow from about 65,000 rows on.
    total = F.sum(head.cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("row_count"), total.alias("digest_sum"))


# --- rules -------------------------------------------------------------------


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows with a conditions array (a few hundred rows at most)."""
    rows = [
        (r.rule_id, r.origin, [(c.feature, c.operator, _number(c.value)) for c in r.conditions])
        for r in rules
    ]
    return spark.createDataFrame(
        rows, f"rule_id string, origin string, conditions {CONDITIONS_TYPE}"
    )


def _number(value: object) -> float | None:
    return None if value is None else float(value)


def rules_to_json(rules: DataFrame) -> DataFrame:
    """Sink form ``rule_id, origin, conditions_json``, sorted by id."""
    return rules.select(
        "rule_id",
        "origin",
        F.to_json("conditions", {"ignoreNullFields": "false"}).alias("conditions_json"),
    ).orderBy("rule_id")


def rules_from_json(stored: DataFrame) -> DataFrame:
    """Read stored rules back; text that is no list of conditions is an error."""
    if stored.columns != ["rule_id", "origin", "conditions_json"]:
        raise ContractError("stored rule columns are invalid")
    parsed = F.from_json("conditions_json", CONDITIONS_TYPE, {"mode": "PERMISSIVE"})
    valid = parsed.isNotNull() & ~F.exists(
        parsed, lambda c: c.isNull() | c["feature"].isNull() | c["operator"].isNull()
    )
    return stored.select(
        "rule_id",
        "origin",
        F.when(valid, parsed)
        .otherwise(F.raise_error(F.lit("stored rules are invalid")).cast(CONDITIONS_TYPE))
        .alias("conditions"),
    )


def rules_matching(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add one boolean column per rule, named ``rule_<id>``."""
    return df.withColumns({f"rule_{r.rule_id}": rule_column(r, df.schema) for r in rules})


# --- evidence ----------------------------------------------------------------


def grade_rank(grade: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GRADES]), grade) - 1


def evidence_output(
    evidence: DataFrame, slices: DataFrame, *, time_enabled: bool = True
) -> DataFrame:
    """Evidence sink: cards in report order with nested, redacted slices.

    Segment labels are replaced by codes; without time validation the time
    slices and the decay are left out.
    """
    kept = slices if time_enabled else slices.filter(F.col("slice_type") != "time")
    order = F.array_position(F.array(F.lit("dataset"), F.lit("segment"), F.lit("time")), F.col("slice_type"))
    value = F.when(F.col("slice_type") == "segment", redaction_code("slice_value")).otherwise(
        F.col("slice_value")
    )
    nested = kept.groupBy("rule_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    order.alias("order"),
                    value.alias("slice_value"),
                    "slice_type",
                    "support_count",
                    "lift",
                )
            )
        ).alias("slices")
    )
    cards = evidence if time_enabled else evidence.drop("max_time_decay")
    return cards.join(nested, "rule_id", "left").orderBy(
        grade_rank(F.col("grade")), F.col("lift").desc(), "rule_id"
    )
