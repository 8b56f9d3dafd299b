"""Ranked lexical search with hashed max-sketches.

A term of a document has an impact that grows with its occurrences and falls with the document's
length.  The sketch of a document folds its terms into `width` coordinates and keeps in each the
largest number of occurrences; as the impact grows with that number, the largest impact follows from
it once the corpus counts are known.  A block of queries is looked up in all sketches at once: weights
times folded impacts bound every score from above, and they are exact where no two terms meet.

Documents are then scored from their whole texts in rounds of descending bound.  A histogram of the
bounds says where a round ends; the search of a query is over when no document left has a bound that
reaches its last rank, or only equals it with a later id.  Nothing is pruned by any other test, so
the ranks are those of scoring every document.

Only a block of queries, its term weights and its current ranks are held by the driver.

Cases: null text has no terms, and a query or document without terms gets no rank; equal rows are
documents of their own and rank side by side; a null `doc_id` ranks after the others of its score;
queries given twice are answered twice; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import staged, total

#: Bytes of terms as they are, but for A-Z; all others are blanks.
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_MEMO = 300_000
#: Candidate rows up to which the texts are filtered by a broadcast join; about 4 MB.
_BROADCAST_ROWS = 100_000
#: Bins of the bound histogram for each doubling of the bound.
_BINS = 16
_RESULT = "item_id long, rank int, doc_id long, score long"


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order, repeats included."""
    return text.translate(_TERMS).split() if text else []


def coordinate(term: bytes, width: int) -> int:
    """The coordinate a term is folded into."""
    return xxhash.xxh32_intdigest(term, seed=11) % width


def impact(tf, m):
    """Impact of `tf` occurrences in a document of length norm `m`, in millionths."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_norm(n, count: int, length: int):
    """100 for a document of the mean length, 75 and more for any."""
    return 75 + (25 * n * count) // max(length, 1)


class Index(NamedTuple):
    """`sketches` (uid, doc_id, n, sketch), `counts` (term, df; several rows a term), corpus counts."""

    docs: DataFrame
    sketches: DataFrame
    counts: DataFrame
    documents: int
    length: int
    width: int


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.xxhash64("doc_id", "text").alias("uid"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )


def index(docs: DataFrame, width: int = 4096) -> Index:
    """Sketches and term counts of all documents, from one pass over their texts."""
    names = ["uid", "doc_id", "n", "sketch", "term", "df"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    class Places(dict):
        def __missing__(self, term: bytes) -> int:
            if len(self) > _MEMO:
                self.clear()
            self[term] = found = coordinate(term, width)
            return found

    def counted(df: Counter) -> pa.RecordBatch:
        gap = [None] * len(df)
        columns = (gap, gap, gap, gap, list(df), list(df.values()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, df = Places(), Counter()
        for batch in batches:
            lengths, sketches = [], []
            for text in batch.column("text").to_pylist():
                found = Counter(terms(text))
                df.update(found.keys())
                lengths.append(found.total())
                at = np.fromiter(map(places.__getitem__, found), dtype=np.int64, count=len(found))
                tf = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                order = np.lexsort((tf, at))
                at, tf = at[order], tf[order]
                last = np.append(at[1:] != at[:-1], True)[: len(at)]
                sketches.append(at[last].astype("<u2").tobytes() + tf[last].astype("<u4").tobytes())
            gap = [None] * batch.num_rows
            made = (batch.column("uid"), batch.column("doc_id"), lengths, sketches, gap, gap)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(made, kinds)], names
            )
            if len(df) > _MEMO:
                yield counted(df)
                df = Counter()
        yield counted(df)

    if not 0 < width <= 1 << 16:
        raise ValueError("a sketch has at most 65536 coordinates")
    schema = "uid long, doc_id long, n long, sketch binary, term binary, df long"
    found = staged(_named(docs).mapInArrow(rows, schema), "sketches")
    sketches = found.where("term is null").select("uid", "doc_id", "n", "sketch")
    count, length = total(sketches.where("n > 0"), F.count("*"), F.coalesce(F.sum("n"), F.lit(0)))
    return Index(docs, sketches, found.where("term is not null").select("term", "df"), count, length, width)


class _Block(NamedTuple):
    """Queries as occurrences of terms, weights of the terms, and the matrix for the look-up."""

    items: list
    queries: list[dict[bytes, int]]
    weights: dict[bytes, int]
    column: np.ndarray
    matrix: np.ndarray


def _block(found: Index, items: list, texts: list[bytes | None]) -> _Block:
    spark = found.sketches.sparkSession
    queries = [Counter(terms(t)) for t in texts]
    asked = spark.createDataFrame([(t,) for t in {t for q in queries for t in q}], "term binary")
    rows = found.counts.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()
    n = found.documents
    weights = {bytes(r["term"]): math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in rows}
    queries = [{t: weights[t] * times for t, times in q.items() if t in weights} for q in queries]
    used = sorted({coordinate(t, found.width) for t in weights})
    column = np.full(found.width, -1, dtype=np.int64)
    column[used] = np.arange(len(used))
    matrix = np.zeros((len(used), len(queries)))
    for k, q in enumerate(queries):
        for t, w in q.items():
            matrix[column[coordinate(t, found.width)], k] += w
    return _Block(items, queries, weights, column, matrix)


def _bounds(batch: pa.RecordBatch, column: np.ndarray, matrix: np.ndarray, count: int, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and bounds (documents x queries) of parts of a batch; whole numbers, exact below 2^53."""
    sketches, n = batch.column("sketch").to_pylist(), np.array(batch.column("n").to_pylist(), dtype=np.int64)
    norms = length_norm(n, count, length)
    step = max(1, (1 << 22) // max(1, matrix.shape[0]))
    for first in range(0, len(sketches), step):
        part = sketches[first : first + step]
        folded = np.zeros((len(part), matrix.shape[0]))
        for k, sketch in enumerate(part):
            size = len(sketch) // 6
            at = column[np.frombuffer(sketch, dtype="<u2", count=size)]
            tf = np.frombuffer(sketch, dtype="<u4", count=size, offset=2 * size).astype(np.int64)
            known = at >= 0
            folded[k, at[known]] = impact(tf[known], norms[first + k])
        yield first, folded @ matrix


def _bin(bounds: np.ndarray) -> np.ndarray:
    return np.floor(_BINS * np.log2(np.maximum(bounds, 1))).astype(np.int64)


def _histogram(found: Index, block: _Block) -> dict[int, list[tuple[int, int]]]:
    """Per query the number of documents by bin of their bound, highest bin first."""
    column, matrix, count, length = block.column, block.matrix, found.documents, found.length
    queries = len(block.items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = 64 * _BINS
        counts = np.zeros(queries * bins, dtype=np.int64)
        for batch in batches:
            for _, bounds in _bounds(batch, column, matrix, count, length):
                d, q = np.nonzero(bounds)
                counts += np.bincount(q * bins + _bin(bounds[d, q]), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some // bins), pa.array(some % bins), pa.array(counts[some])], ["query", "bin", "docs"]
        )

    summed = found.sketches.mapInArrow(rows, "query long, bin long, docs long").groupBy("query", "bin")
    out: dict[int, list[tuple[int, int]]] = {}
    for r in summed.agg(F.sum("docs").alias("docs")).collect():
        out.setdefault(r["query"], []).append((r["bin"], r["docs"]))
    return {q: sorted(x, reverse=True) for q, x in out.items()}


def _candidates(found: Index, block: _Block, low: np.ndarray, high: np.ndarray, least: np.ndarray, tie: np.ndarray) -> DataFrame:
    """Documents and the queries to score them for.

    Their bound has a bin from `low` to under `high` and is over `least`, or equal to it with an id
    below `tie`.
    """
    column, matrix, count, length = block.column, block.matrix, found.documents, found.length

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            ids = np.where(np.isnan(ids), np.inf, ids) if ids.dtype.kind == "f" else ids
            uids = batch.column("uid").to_numpy()
            for first, bounds in _bounds(batch, column, matrix, count, length):
                bins, own = _bin(bounds), ids[first : first + len(bounds), None]
                wanted = (bins >= low) & (bins < high) & (bounds > 0)
                wanted &= (bounds > least) | ((bounds == least) & (own < tie))
                d, q = np.nonzero(wanted)
                if len(d):
                    at, edges = np.unique(d, return_index=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(edges, len(d)), pa.int32()), pa.array(q, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(uids[first + at]), lists], ["uid", "queries"])

    return staged(found.sketches.mapInArrow(rows, "uid long, queries array<int>"), "candidates")


def _scored(found: Index, block: _Block, wanted: DataFrame, k: int) -> DataFrame:
    """The `k` best of the wanted documents of each query: `query`, `score`, `doc_id`."""
    queries, count, length = block.queries, found.documents, found.length
    distinct = wanted.dropDuplicates(["uid"])
    if total(distinct, F.count("*"))[0] <= _BROADCAST_ROWS:
        distinct = F.broadcast(distinct)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "queries"))
            for doc_id, text, asked in zip(*columns):
                held = Counter(terms(text))
                m = length_norm(held.total(), count, length)
                for q in asked:
                    score = sum(w * impact(held[t], m) for t, w in queries[q].items() if t in held)
                    if score:
                        row = (score, doc_id is not None, -(doc_id or 0), doc_id)
                        ranks = best.setdefault(q, [])
                        heapq.heappush(ranks, row) if len(ranks) < k else heapq.heappushpop(ranks, row)
        flat = [(q, row[0], row[3]) for q, ranks in best.items() for row in ranks]
        out = zip(*flat) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query", "score", "doc_id"])

    found_rows = _named(found.docs).join(distinct, "uid").select("doc_id", "text", "queries")
    scored = found_rows.mapInArrow(rows, "query long, score long, doc_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def _ranked(found: Index, block: _Block, k: int, growth: int) -> list[tuple]:
    """(item, rank, doc_id, score) of the `k` best documents of each query of a block."""
    if not block.weights:
        return []
    histogram = _histogram(found, block)
    queries = len(block.items)
    best: list[list] = [[] for _ in range(queries)]
    high, low = np.full(queries, 1 << 30), np.zeros(queries, dtype=np.int64)
    share = growth * k
    while True:
        least, tie = np.zeros(queries), np.full(queries, np.inf)
        for q in range(queries):
            if len(best[q]) == k:
                least[q], tie[q] = best[q][-1][0], np.inf if best[q][-1][1] is None else best[q][-1][1]
            left = [(b, n) for b, n in histogram.get(q, []) if b < high[q] and b >= int(_bin(least[q : q + 1])[0])]
            low[q], held = high[q], 0
            for b, n in left:
                low[q], held = b, held + n
                if held >= share:
                    break
        if (low == high).all():
            break
        wanted = _candidates(found, block, low, high, least, tie)
        for r in _scored(found, block, wanted, k).collect():
            best[r["query"]].append((r["score"], r["doc_id"]))
        for ranks in best:
            ranks.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            del ranks[k:]
        high, share = low.copy(), share * growth
    return [
        (block.items[q], place, doc_id, score)
        for q in range(queries) for place, (score, doc_id) in enumerate(best[q], 1)
    ]


def ranked(found: Index, queries: DataFrame, item_id: str, text: str, k: int = 20, block: int = 256, growth: int = 4) -> DataFrame:
    """The `k` best documents of each query: `item_id`, `rank`, `doc_id`, `score`.

    Queries are answered in blocks, each written to the shared folder.  The first round scores the
    `growth` x `k` documents of highest bound, every further one `growth` times as many.
    """
    spark = found.sketches.sparkSession
    rows = queries.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).toLocalIterator()
    out = spark.createDataFrame([], _RESULT)
    while part := list(islice(rows, block)):
        asked = _block(found, [r[0] for r in part], [None if r[1] is None else bytes(r[1]) for r in part])
        answers = spark.createDataFrame(_ranked(found, asked, k, growth), _RESULT)
        out = out.unionAll(staged(answers, "ranks"))
    return out
