"""Quality from compression: which labelled text helps to compress a document more.

Two zstandard dictionaries are built from labelled text, one from good and one from bad documents.
A text is compressed once with each; the difference of the sizes, as a share of the text, and how
far the text shrinks at all go through a logistic curve that labelled rows calibrate.

A bounded sample of labelled documents (`sample` of each class, drawn by hash) fits the two dictionaries
and the curve.  For the dictionaries at most `parts` pieces of 4 KB of each class, drawn by hash from the
whole texts, reach the driver; for the curve the sizes of whole texts do.  Every text is scored whole.

Cases: null and empty texts are scored as the empty text; without labelled rows of both classes
every score is the share of good labels (0.5 without any).  Rows given twice are scored twice.  Extra
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import staged

#: Bytes of a piece of text that a dictionary is trained on.
PIECE = 4096


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    base: float


class Sizes:
    """The two compressed sizes of a text as a few numbers."""

    def __init__(self, good: bytes, bad: bytes, level: int = 1):
        import zstandard

        options = dict(level=level, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(good), **options)
        self.bad = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(bad), **options)

    def __call__(self, text: str | None) -> tuple[float, ...]:
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad, n = len(self.good.compress(data)), len(self.bad.compress(data)), len(data) + 1
        return 100 * (bad - good) / n, (good + bad) / (2 * n), np.log(n) / 5


def _train(parts: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-size:] or b"\x00" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(curve, x.T @ (y - p) - 1e-2 * w)
    return w


def training_marks(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """`doc_id` and `mark` (0/1) of labelled documents that are not held out; the lower of several marks."""
    marks = labels.select("doc_id", F.col(label).alias("mark")).where(F.col("mark").isin(0, 1) & ~held_out)
    return marks.groupBy("doc_id").agg(F.min("mark").alias("mark"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int) -> DataFrame:
    """At most `per_class` labelled documents of each class that are not held out, drawn by hash.

    `mark` 0/1, whole `text` and the row's place in the draw (`at`).  A document with several label rows counts once.
    """
    marks, drawn = training_marks(labels, label, held_out), None
    for value in (0, 1):
        some = marks.where(F.col("mark") == value).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionAll(some)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").where("text is not null").select(
        "mark", F.xxhash64("doc_id", F.lit(11)).alias("at"), "doc_id", "text"
    )


def _pieces(rows: DataFrame, parts: int) -> list[bytes]:
    """At most `parts` pieces of the whole texts, drawn by hash."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in zip(batch.column("at"), batch.column("text")):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for low in range(0, len(data), PIECE << 8):  # very long texts, piece by piece
                    places = list(range(low, min(len(data), low + (PIECE << 8)), PIECE))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at.as_py()] * len(places), pa.int64()), pa.array(places, pa.int64()),
                         pa.array([data[k : k + PIECE] for k in places], pa.binary())], ["at", "place", "piece"]
                    )

    found = rows.select("at", "text").mapInArrow(cut, "at long, place long, piece binary")
    drawn = found.orderBy(F.xxhash64("at", "place"), "at", "place", "piece").limit(parts)
    return [bytes(r["piece"]) for r in drawn.select("at", "place", "piece").collect()]


def _sizes(rows: DataFrame, good: bytes, bad: bytes) -> np.ndarray:
    """The inputs of the curve, from whole texts, in the order of the draw."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(good, bad)
        for batch in batches:
            x = np.array([sizes(t.as_py()) for t in batch.column("text")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), *(pa.array(x[:, k], pa.float64()) for k in range(3))], ["at", "x0", "x1", "x2"]
            )

    found = rows.select("at", "text").mapInArrow(measured, "at long, x0 double, x1 double, x2 double").toPandas()
    found = found.sort_values(["at", "x0", "x1", "x2"])
    return np.insert(found[["x0", "x1", "x2"]].to_numpy(dtype=float), 0, 1.0, axis=1)


def fit(
    docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 3000, size: int = 32_768, parts: int = 6000
) -> Model:
    """The two dictionaries and the curve, from at most `sample` labelled documents of each class.

    Half of them build the dictionaries (at most `parts` pieces of 4 KB of each class, from anywhere
    in their texts), the other half calibrate by their whole texts.
    """
    rows = staged(training_rows(docs, labels, "quality", held_out, sample), "labelled")
    drawn = sorted({tuple(r) for r in rows.select("mark", "at", "doc_id").collect()})
    counts = {r["mark"]: r["count"] for r in training_marks(labels, "quality", held_out).groupBy("mark").count().collect()}
    known = sum(counts.values())
    base = counts.get(1, 0) / known if known else 0.5
    places = {v: [at for mark, at, _ in drawn if mark == v] for v in (0, 1)}
    if not places[0] or not places[1]:
        return Model(b"", b"", [], base)

    def some(v: int, first: int) -> DataFrame:
        chosen = [(at,) for at in places[v][first::2] or places[v]]
        ids = rows.sparkSession.createDataFrame(chosen, "at long")
        return rows.where(F.col("mark") == v).join(F.broadcast(ids), "at", "left_semi")

    good, bad = (_train(_pieces(some(v, 0), parts), size) for v in (1, 0))
    x = [_sizes(some(v, 1), good, bad) for v in (0, 1)]
    y = np.repeat([0.0, 1.0], [len(x[0]), len(x[1])])
    weights = _logistic(np.concatenate(x), y)
    # The sample may hold the classes in other shares than the labels do.
    weights[0] += np.log(counts[1] / counts[0]) - np.log(len(x[1]) / len(x[0]))
    return Model(good, bad, weights.tolist(), base)


def _scores(model: Model, sizes: Sizes | None, texts: pa.Array) -> np.ndarray:
    if sizes is None:
        return np.full(len(texts), model.base)
    x = np.array([(1.0, *sizes(t.as_py())) for t in texts]).reshape(-1, len(model.weights))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id` and `score` (0 to 1, higher is better) of every row, from its whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.weights else None
        for batch in batches:
            scores = _scores(model, sizes, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"]
            )

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")


def filtered(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is at least `least`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.weights else None
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, sizes, batch.column("text")) >= least))

    return docs.mapInArrow(rows, docs.schema)
