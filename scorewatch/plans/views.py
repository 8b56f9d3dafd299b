"""The labelled views over the provided tables that the registered queries read.

The tables carry no label and no missing values, so both are planted with
integer arithmetic on the keys, which any SQL engine repeats exactly.  The
``*_SQL`` texts state the same views for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.roles import Features, Roles
from scorewatch.sources.scratch import staged

ROLES = Roles("entity_id", "snapshot_date", "segment", "target")
FEATURES = Features({"order": ("ord_",), "customer": ("cust_",)})
FEATURE_NAMES = ["cust_bal", "ord_disc", "ord_price", "ord_qty", "ord_tax", "ord_total"]
ROW_KEY = ["entity_id", "line_no", "part_id", "supplier_id"]
REFERENCE_END = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flag(condition) -> F.Column:
    return F.when(condition, 1).otherwise(0)


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: roles, six features and a planted 0/1 target."""
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    # Orders meet their customer first: so the lines, by far the most rows, are shuffled once.
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = line.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    u = (
        F.col("l_orderkey") * 7919
        + F.col("l_partkey") * 104729
        + F.col("l_suppkey") * 1299709
        + F.col("l_linenumber").cast("long") * 15485863
    ) % 1000
    chance = (
        F.lit(100)
        + 300 * flag(F.col("l_discount") > 0.07)
        + 250 * flag((F.col("l_quantity") > 30) & (F.col("c_acctbal") < 2000))
    )
    return joined.select(
        F.col("l_orderkey").cast("string").alias("entity_id"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date"),
        F.col("c_mktsegment").alias("segment"),
        flag(u < chance).alias("target"),
        F.col("c_acctbal").alias("cust_bal"),
        F.col("l_discount").alias("ord_disc"),
        F.col("l_extendedprice").alias("ord_price"),
        F.col("l_quantity").alias("ord_qty"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_tax")).alias("ord_tax"),
        F.col("o_totalprice").alias("ord_total"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supplier_id"),
    )


RISK_SQL = """risk AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS entity_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot_date,
         c_mktsegment AS segment,
         CASE WHEN (l_orderkey*7919 + l_partkey*104729 + l_suppkey*1299709 + l_linenumber*15485863) % 1000
              < 100 + 300*(CASE WHEN l_discount > 0.07::DOUBLE THEN 1 ELSE 0 END)
                    + 250*(CASE WHEN l_quantity > 30 AND c_acctbal < 2000 THEN 1 ELSE 0 END)
              THEN 1 ELSE 0 END AS target,
         c_acctbal AS cust_bal, l_discount AS ord_disc, l_extendedprice AS ord_price,
         l_quantity AS ord_qty, CASE WHEN l_partkey % 17 <> 0 THEN l_tax END AS ord_tax,
         o_totalprice AS ord_total,
         CAST(l_linenumber AS BIGINT) AS line_no, l_partkey AS part_id, l_suppkey AS supplier_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def stored(spark: SparkSession, sf_dir: str, *without: str) -> DataFrame:
    """The risk view as a stage table, for jobs that read it several times.

    Its joins run once; every further pass reads only the columns that it needs from files.
    """
    return staged(risk(spark, sf_dir).drop(*without), "risk")


def dirty(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """The risk view with planted nulls, NaN, infinities and a constant column."""
    return (risk(spark, sf_dir) if rows is None else rows).select(
        "entity_id",
        F.when(F.col("part_id") % 97 != 0, F.col("snapshot_date")).alias("snapshot_date"),
        "segment",
        F.when(F.col("part_id") % 89 != 0, F.col("target")).alias("target"),
        F.when(F.col("part_id") % 3 != 0, F.col("cust_bal")).alias("cust_bal"),
        F.when(F.col("part_id") % 101 == 0, F.lit(float("nan")))
        .when(F.col("part_id") % 103 == 0, F.lit(float("inf")))
        .otherwise(F.col("ord_price"))
        .alias("ord_price"),
        F.col("ord_qty"),
        F.when(F.col("part_id") % 7 != 0, F.lit(5.0)).alias("ord_flat"),
        "part_id",
    )


DIRTY_SQL = (
    RISK_SQL
    + """, dirty AS (
  SELECT entity_id, CASE WHEN part_id % 97 <> 0 THEN snapshot_date END AS snapshot_date, segment,
         CASE WHEN part_id % 89 <> 0 THEN target END AS target,
         CASE WHEN part_id % 3 <> 0 THEN cust_bal END AS cust_bal,
         CASE WHEN part_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN part_id % 103 = 0 THEN 'Infinity'::DOUBLE
              ELSE ord_price END AS ord_price,
         ord_qty, CASE WHEN part_id % 7 <> 0 THEN 5.0::DOUBLE END AS ord_flat, part_id
  FROM risk)"""
)


def reference(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Snapshots before 1999: the frozen reference period."""
    rows = risk(spark, sf_dir) if rows is None else rows
    return rows.filter(F.col("snapshot_date") < F.lit(REFERENCE_END).cast("date"))


def current(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Snapshots from 1999 on, with planted drift: prices of two segments, missing
    values, a label shift, a vanished and a new segment."""
    rows = risk(spark, sf_dir) if rows is None else rows
    late = rows.filter(F.col("snapshot_date") >= F.lit(REFERENCE_END).cast("date"))
    building = F.col("segment") == "BUILDING"
    return late.withColumns(
        {
            "ord_price": F.when(
                F.col("segment").isin("BUILDING", "FURNITURE"), F.col("ord_price") * 6.0
            ).otherwise(F.col("ord_price")),
            "ord_qty": F.when(F.col("part_id") % 4 != 0, F.col("ord_qty")),
            "ord_total": F.when(
                ~(building & (F.col("part_id") % 2 == 0)), F.col("ord_total")
            ),
            "target": F.when(F.col("part_id") % 20 == 0, 1).otherwise(F.col("target")),
            "segment": F.when(F.col("segment") == "MACHINERY", "MARINE").otherwise(F.col("segment")),
        }
    )


REF_CUR_SQL = (
    RISK_SQL
    + """, reference AS (SELECT * FROM risk WHERE snapshot_date < DATE '1999-01-01'),
current_ AS (
  SELECT entity_id, snapshot_date,
         CASE WHEN segment = 'MACHINERY' THEN 'MARINE' ELSE segment END AS segment,
         CASE WHEN part_id % 20 = 0 THEN 1 ELSE target END AS target,
         cust_bal, ord_disc,
         CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN ord_price * 6.0::DOUBLE ELSE ord_price END AS ord_price,
         CASE WHEN part_id % 4 <> 0 THEN ord_qty END AS ord_qty,
         ord_tax,
         CASE WHEN NOT (segment = 'BUILDING' AND part_id % 2 = 0) THEN ord_total END AS ord_total,
         line_no, part_id, supplier_id
  FROM risk WHERE snapshot_date >= DATE '1999-01-01')"""
)


def r6(expression: str) -> str:
    """SQL text of the rounding used on both sides of a comparison."""
    return f"(round(CAST({expression} AS DOUBLE), 6) + 0.0::DOUBLE)"


def sql_list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)
