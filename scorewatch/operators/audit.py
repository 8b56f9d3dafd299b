"""Verification of hash-chained record tables.

Each row is checked against its predecessor by a join on the sequence number,
so a run may hold any share of the rows without meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the hash before the first record.
ROOT_HASH = "0" * 64


def chain_hash(evidence_id: Column, previous: Column, run: Column, sequence: Column) -> Column:
    """Hash of a link: canonical JSON of its four fields, in alphabetical order."""
    link = F.struct(
        evidence_id.alias("evidence_id"),
        previous.alias("previous_hash"),
        run.alias("run_id"),
        sequence.cast("long").alias("sequence"),
    )
    return F.sha2(F.to_json(link), 256)


def event_hash(sequence: Column, previous: Column, event_json: Column) -> Column:
    return F.sha2(F.concat_ws("\n", sequence.cast("string"), previous, event_json), 256)


def _single(name: str) -> Column:
    """The value of a column when a group holds only one, else null."""
    return F.when(F.min(name) == F.max(name), F.min(name))


def link_problems(records: DataFrame) -> DataFrame:
    """Records with ``problems``: wrong predecessor, content, link hash or parents.

    ``records``: run_id, sequence, content_json, evidence_id, previous_hash,
    chain_hash, parent_ids (array).
    """
    # One row per key, so that copies of a record cannot multiply in the join;
    # different hashes under one key are no valid predecessor.
    before = records.groupBy("run_id", (F.col("sequence") + 1).alias("sequence")).agg(
        _single("chain_hash").alias("_before")
    )
    linked = records.join(before, ["run_id", "sequence"], "left")
    parents = records.select("run_id", "sequence", F.explode("parent_ids").alias("evidence_id"))
    known = records.groupBy("run_id", "evidence_id").agg(F.min("sequence").alias("_at"))
    orphans = (
        parents.distinct()
        .join(known, ["run_id", "evidence_id"], "left")
        .filter(~F.coalesce(F.col("_at") < F.col("sequence"), F.lit(False)))
        .select("run_id", "sequence")
        .distinct()
        .withColumn("_orphan", F.lit(True))
    )
    expected = F.when(F.col("sequence") == 1, F.lit(ROOT_HASH)).otherwise(F.col("_before"))
    checks = {
        "previous_hash": ~F.col("previous_hash").eqNullSafe(expected),
        "evidence_id": F.col("evidence_id") != F.sha2("content_json", 256),
        "chain_hash": F.col("chain_hash")
        != chain_hash(
            F.col("evidence_id"), F.col("previous_hash"), F.col("run_id"), F.col("sequence")
        ),
        "parent_ids": F.col("_orphan").isNotNull(),
    }
    problems = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return (
        linked.join(orphans, ["run_id", "sequence"], "left")
        .withColumn("problems", problems)
        .drop("_before", "_orphan")
    )


def verify_chains(records: DataFrame) -> DataFrame:
    """Every run at once: record count, validity and the first broken sequence number."""
    broken = F.size("problems") > 0
    runs = link_problems(records).groupBy("run_id").agg(
        F.count("*").alias("record_count"),
        F.min("sequence").alias("lo"),
        F.max("sequence").alias("hi"),
        F.count_if(broken).alias("broken_records"),
        F.min(F.when(broken, F.col("sequence"))).alias("first_broken"),
    )
    # Each sequence number once, without gaps: a repeated one breaks a link as well.
    whole = (F.col("lo") == 1) & (F.col("hi") == F.col("record_count"))
    return runs.select(
        "run_id",
        "record_count",
        "broken_records",
        "first_broken",
        (whole & (F.col("broken_records") == 0)).alias("valid"),
    )


def verify_log(events: DataFrame, expected_count: int, expected_head: str) -> DataFrame:
    """One global event log: gaps, broken links, broken hashes, count and head; one row.

    ``events``: sequence, event_json, previous_hash, event_hash.
    """
    before = events.groupBy((F.col("sequence") + 1).alias("sequence")).agg(
        _single("event_hash").alias("_before")
    )
    linked = events.join(before, "sequence", "left")
    expected = F.when(F.col("sequence") == 1, F.lit(ROOT_HASH)).otherwise(F.col("_before"))
    row = linked.agg(
        F.count("*").alias("event_count"),
        F.count_if((F.col("sequence") != 1) & F.col("_before").isNull()).alias("gaps"),
        F.count_if(~F.col("previous_hash").eqNullSafe(expected)).alias("broken_links"),
        F.count_if(
            F.col("event_hash")
            != event_hash(F.col("sequence"), F.col("previous_hash"), F.col("event_json"))
        ).alias("broken_hashes"),
        F.max(F.struct("sequence", "event_hash")).alias("head"),
    )
    head = F.coalesce(F.col("head.event_hash"), F.lit(ROOT_HASH))
    sound = (F.col("broken_links") == 0) & (F.col("broken_hashes") == 0) & (F.col("gaps") == 0)
    complete = (F.col("event_count") == expected_count) & (head == expected_head)
    dense = F.coalesce(F.col("head.sequence"), F.lit(0)) == F.col("event_count")
    return row.select(
        "event_count", "gaps", "broken_links", "broken_hashes", (sound & complete & dense).alias("valid")
    )
