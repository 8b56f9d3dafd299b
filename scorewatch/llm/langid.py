"""Language identification by interpolated Kneser-Ney character models.

One model per learned language, fitted on every text that may be learned from; a text goes to the
language whose model gives it the lowest cross-entropy per symbol.  How far the second language is
behind, over the whole text, becomes a score: on texts kept back from the models, Spark counts how
often the choice was right at each distance, and a monotone curve through these shares is the score.
Choices with a score under `reject` are marked.

Cases: null texts and texts without a letter are `und` with score 0; rows whose language is null
teach nothing and are still predicted; without anything to learn from all rows are `und`.  Rows given
twice are predicted twice.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm import charlm
from scorewatch.llm.common import staged

#: Distances are counted in this many steps of a quarter of a power of two.
STEPS = 64
_READY: dict[str, charlm.Scorer] = {}


def entropies(docs: DataFrame, model: charlm.Model) -> DataFrame:
    """`doc_id`, `lang`, number of symbols, best language (null if none) and distance to the second in nats."""
    import uuid

    name = uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:  # a worker serves many tasks
            _READY.clear()
            _READY[name] = model.ready()
        scorer, width = _READY[name], len(model.languages)
        names = np.array([*model.languages, None], dtype=object)
        for batch in batches:
            sums, sizes = np.zeros((batch.num_rows, max(width, 1))), np.zeros(batch.num_rows, dtype=np.int64)
            for places, parts in charlm.in_chunks(t.as_py() for t in batch.column("text")) if width else ():
                logs = scorer.log_probability(np.concatenate(parts))
                ends = np.cumsum([len(p) for p in parts])
                for place, part, end in zip(places, parts, ends.tolist()):
                    sums[place] += logs[end - len(part) : end].sum(axis=0, dtype=np.float64)
                    sizes[place] += len(part)
            order = np.argsort(-sums, axis=1, kind="stable")
            best = np.where(sizes > 0, order[:, 0], width)
            top = np.take_along_axis(sums, order[:, :2], axis=1)
            gap = top[:, 0] - top[:, -1] if width > 1 else -sums[:, 0]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("lang"),
                    pa.array(sizes),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(gap, pa.float64()),
                    pa.array(-sums.max(axis=1) / np.maximum(sizes, 1), pa.float64()),
                ],
                ["doc_id", "lang", "symbols", "best", "gap", "cross_entropy"],
            )

    schema = "doc_id long, lang string, symbols long, best string, gap double, cross_entropy double"
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(rows, schema)


def _step(gap: Column) -> Column:
    return F.least(F.lit(STEPS - 1), F.floor(4 * F.log2(1 + F.greatest(gap, F.lit(0.0))))).cast("int")


def monotone(right: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Non-decreasing shares closest to right / seen, each step helped by two rows, one of them right."""
    blocks: list[list[float]] = []
    for r, n in zip(right + 1.0, seen + 2.0):
        blocks.append([r, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            r2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), r / n) for r, n, k in blocks])


def languages(docs: DataFrame, learn: Column, check: Column, reject: float = 0.5, hash_bits: int = 22) -> DataFrame:
    """`doc_id`, `lang_pred`, `score`, `rejected`, `cross_entropy` of every row.

    Models learn from the rows where `learn` holds, the score from those where `check` holds; both
    are conditions on the columns of `docs`.
    """
    known = docs.where(F.col("lang").isNotNull())
    counts = staged(charlm.gram_counts(known.where(learn), "lang"), "grams")
    model = charlm.fit(counts, hash_bits)
    found = staged(entropies(docs.withColumn("lang", F.when(check, F.col("lang"))), model), "entropies")
    steps = found.where("lang is not null and best is not null").groupBy(_step(F.col("gap")).alias("step")).agg(
        F.count("*").alias("seen"), F.sum((F.col("lang") == F.col("best")).cast("long")).alias("right")
    )
    seen, right = np.zeros(STEPS), np.zeros(STEPS)
    for row in steps.collect():
        seen[row["step"]], right[row["step"]] = row["seen"], row["right"]
    curve = F.array(*[F.lit(float(x)) for x in monotone(right, seen)])
    named = F.col("best").isNotNull()
    score = F.when(named, F.element_at(curve, _step(F.col("gap")) + 1)).otherwise(0.0)
    return found.select(
        "doc_id", F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"),
        (score < reject).alias("rejected"), "cross_entropy",
    )
