"""What the text operators share: tables, stage tables and connected groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of a session in one JVM that has none set.
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in `spark.checkpoint.dir`.  Only a session in one JVM, as in tests, may
    go without; it gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="scorewatch-llm-"))
    return _OWN[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    What follows starts from files, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identity() -> Column:
    """The id of a document, or for one without it a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def total(df: DataFrame, *sums) -> tuple:
    """One row of aggregates of `df`."""
    return tuple(df.agg(*sums).first())


def connected(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Smallest member of the connected group of every node that has an edge.

    `edges` holds pairs of longs in two columns.  Large-star and small-star steps alternate
    until the edges form stars; every step is a grouped minimum and a join, so no group is ever
    gathered in one task, and each round is written down.  Returns `node`, `root`, roots included.
    """
    pairs = edges.select(
        F.greatest(left, right).alias("big"), F.least(left, right).alias("small")
    ).where("big > small").distinct()
    pairs = staged(pairs, "edges")
    state = None
    while True:
        found = total(pairs, F.count("*"), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)")))
        if found == state or not found[0]:
            break
        state = found
        both = pairs.selectExpr("big u", "small v").unionAll(pairs.selectExpr("small u", "big v"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) m")
        large = both.join(lowest, "u").where("v > u").selectExpr("v big", "m small")
        lowest = large.groupBy("big").agg(F.min("small").alias("m"))
        small = large.join(lowest, "big").where("small > m").selectExpr("small big", "m small")
        pairs = staged(small.unionAll(lowest.selectExpr("big", "m small")).distinct(), "edges")
    return pairs.selectExpr("big node", "small root").unionAll(
        pairs.selectExpr("small node", "small root").distinct()
    )
