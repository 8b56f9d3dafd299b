"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm import (
    chunks,
    compression,
    embeddings,
    idfiles,
    langid,
    packing,
    pieces,
    rules,
    search,
    simhash,
    suffix,
    toxicity,
    whitening,
)
from scorewatch.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 ids in as few sequences as possible."""
    rows = packing.pieces(table(spark, sf_dir, "documents"), "word_bpe_49k.json", ids=False)
    return packing.place(rows).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles, linked at 4 or fewer differing bits."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"), words=4, distance=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def held_out(modulus: int, value: int):
    """Whether a row's id leaves this remainder of its checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == value, F.lit(False))


@query
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, groups and survivors of all vectors at a cosine of 0.93 within their label."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)


@query
def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; models learn from four fifths of the rows."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = table(spark, sf_dir, "documents")
    found = langid.languages(docs, learn=crc >= 2, check=crc == 1)
    return found.withColumn("held_out", held_out(5, 0)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by compression; labels of two thirds of the rows."""
    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, table(spark, sf_dir, "labels"), held_out(3, 1))
    found = compression.scored(docs, model).withColumn("held_out", held_out(3, 1))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text after restoring its words; labels of two thirds of the rows."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held_out(3, 1))
    found = toxicity.scored(docs, model).withColumn("held_out", held_out(3, 1))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repeat counts of every whole text and the verdict of the learned list."""
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *rules.BASE, "base_failed", "kept")


@query
def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk deduplication removes from every whole text, and a digest of what it leaves."""
    found = chunks.deduplicated(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_repeated", "n_removed", "n_spans",
        F.sha2(F.coalesce(F.col("kept"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of the ids of every whole text, and whether they decode to it."""
    return pieces.encoded(table(spark, sf_dir, "documents"), "piece_bpe_32k.model", ids=False)


@query
def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text outside strings of 400 bytes that start anywhere else too."""
    found = suffix.without_repeats(table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each benchmark item."""
    found = search.index(table(spark, sf_dir, "documents"))
    return search.ranked(found, table(spark, sf_dir, "benchmark"), "item_id", "text", k=20)


ORACLES["op11_search"] = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of all embeddings, with their certificates."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), count=32)


@query
def op13_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids in grammar-compressed files, read back from them."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    idfiles.written(table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json")
    return idfiles.read(spark, path, ids=False)
