"""Repeated passages by content-defined chunks.

A rolling gear hash over the last 16 bytes ends a chunk where its value is small, so a cut depends
only on the bytes around it: text inserted ahead shifts the chunks but does not change them.  Chunks
are deduplicated by digest: of equal chunks the one in the smallest document id, earliest in it, is
the first, the others are copies.  Copies side by side that add up to `least_run` bytes are removed;
shorter ones are everyday phrases and stay.

A document sends each of its digests once to be counted, as smallest and largest id per digest, so a
chunk that a third of all documents share is one row per task; only repeated digests come back.

Cases: null text is empty and has no chunks; rows with the same id and text are one document, given
several times; rows with the same id and other texts are documents of their own, ordered by a hash of
the text; a null id takes part under a hash of its text.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import identity, staged

WINDOW = 16
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)
BUFFER = 1 << 20


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: twice the one before plus the byte's value."""
    h = GEAR[data]
    for span in (1, 2, 4, 8):
        h[span:] = h[span:] + (h[:-span] << np.uint16(span))
    return h


def boundaries(data: bytes, average: int, apart: int = 8, most: int = 4096) -> np.ndarray:
    """Places after which a chunk ends, the end of the text included.

    A cut is a place with a small hash, a full window, none of the `apart` places before it small,
    and the start of a character after it; chunks over `most` bytes are cut there.
    """
    n = len(data)
    ends = [np.zeros(1, dtype=np.int64)]
    for at in range(0, n, BUFFER):
        begin = max(0, at - WINDOW - apart)
        part = np.frombuffer(data[begin : at + BUFFER + 1], dtype=np.uint8)
        small = gear_hashes(part) < (1 << 16) // average
        small[: max(0, WINDOW - 1 - begin)] = False
        if begin:
            small[: WINDOW - 1] = False
        near = small.copy()
        for k in range(1, apart + 1):
            near[k:] &= ~small[:-k]
        next_byte = np.append(part[1:], 0)
        near &= (next_byte & 0xC0) != 0x80
        found = np.flatnonzero(near) + begin + 1
        ends.append(found[(found > at) & (found <= at + BUFFER)])
    cuts = np.append(np.concatenate(ends), n)
    wide = np.flatnonzero(np.diff(cuts) > most)
    if len(wide):
        more = []
        for k in wide.tolist():
            place = int(cuts[k]) + most
            while place < cuts[k + 1]:
                stop = place
                while stop > place - 4 and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                more.append(stop)
                place = stop + most
        cuts = np.sort(np.append(cuts, more))
    cuts = cuts[1:]
    return cuts[(cuts > 0) & np.concatenate([[True], cuts[1:] != cuts[:-1]])]


def chunks(docs: DataFrame, average: int = 32) -> DataFrame:
    """Chunks of every text: `oid`, `version`, `digest`, `start`, `size`, and whether the digest came before in the text (`again`)."""
    names = ["oid", "version", "digest", "start", "size", "again"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for oid, version, text in zip(*(batch.column(c).to_pylist() for c in ("oid", "version")), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                ends = boundaries(data, average)
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                found = [digest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                seen: set[int] = set()
                again = [x in seen or seen.add(x) is not None for x in found]
                out[0].append(np.full(len(ends), oid, dtype=np.int64))
                out[1].append(np.full(len(ends), version, dtype=np.int64))
                out[2] += found
                out[3].append(starts)
                out[4].append(ends - starts)
                out[5] += again
                if len(out[2]) > BUFFER:
                    yield made(out)
                    out = [[] for _ in names]
            yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        columns = [
            pa.array(join(out[0], np.int64)),
            pa.array(join(out[1], np.int64)),
            pa.array(np.array(out[2], dtype=np.uint64).view(np.int64)),
            pa.array(join(out[3], np.int64)),
            pa.array(join(out[4], np.int32)),
            pa.array(out[5], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*_names(), "text").mapInArrow(
        rows, "oid long, version long, digest long, start long, size int, again boolean"
    )


def _names() -> list[Column]:
    """What tells documents apart: the id, and a hash of the text for rows that share one."""
    return [identity().alias("oid"), F.xxhash64("text").alias("version")]


def repeats(docs: DataFrame, average: int = 32) -> DataFrame:
    """Per document the chunks that are also elsewhere: `oid`, `version`, `found` of (`start`, `size`, `first`).

    Ids that stand for several texts are few, as a rule none: their chunks alone are also counted by
    version, so that one of the texts is the first.
    """
    all_chunks = chunks(docs, average)
    counted = all_chunks.groupBy("digest").agg(
        F.min("oid").alias("low"), F.max("oid").alias("high"), F.max("again").alias("twice")
    )
    versions = docs.select(*_names()).groupBy("oid").agg(F.min("version").alias("one"), F.max("version").alias("other"))
    several = staged(versions.where("one <> other").select("oid"), "several")
    same_id = docs.withColumn("oid", identity()).join(several, "oid", "left_semi").select("doc_id", "text")
    by_version = chunks(same_id, average).groupBy("digest", F.col("oid").alias("low")).agg(
        F.min("version").alias("low_version"), F.max("version").alias("high_version")
    )
    counted = counted.join(staged(by_version, "versions"), ["digest", "low"], "left")
    # From a table, so that the join may split a digest that very many documents have.
    shared = counted.where("low < high or twice or low_version < high_version")
    shared = staged(shared.select("digest", "low", "low_version"), "shared")
    first = (F.col("oid") == F.col("low")) & ~F.col("again") & (F.col("version") == F.coalesce("low_version", "version"))
    met = all_chunks.join(shared, "digest").select(
        "oid", "version", F.struct("start", "size", first.alias("first")).alias("c")
    )
    return met.groupBy("oid", "version").agg(F.collect_list("c").alias("found"))


def _runs(found: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Sorted (start, end) pieces joined where they touch; only those of `least` bytes."""
    out: list[list[int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def deduplicated(docs: DataFrame, average: int = 32, least_run: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row with `kept` (its text without copies), `n_bytes`, `n_repeated`, `n_removed`, `n_spans`.

    `n_repeated` counts the bytes in runs of repeated chunks, first ones included; `keep` names
    further columns of `docs` to carry along.
    """
    own = docs.select(*_names(), "doc_id", "text", F.struct(*[F.col(c) for c in keep] or [F.lit(0)]).alias("more"))
    joined = own.join(repeats(docs, average), ["oid", "version"], "left").select("doc_id", "more", "text", "found")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                pieces = sorted({(c["start"], c["start"] + c["size"], c["first"]) for c in found or ()})
                near = _runs([(a, b) for a, b, _ in pieces], least_run)
                gone = _runs([(a, b) for a, b, first in pieces if not first], least_run)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                values = (
                    None if text.as_py() is None else kept.decode("utf-8", "surrogatepass"),
                    len(data), sum(b - a for a, b in near), sum(b - a for a, b in gone), len(gone),
                )
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("more"), *(pa.array(x, k) for x, k in zip(out, kinds))],
                ["doc_id", "more", "kept", "n_bytes", "n_repeated", "n_removed", "n_spans"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = f"doc_id {kinds['doc_id']}, more {kinds['more']}, kept string, n_bytes long, n_repeated long, n_removed long, n_spans long"
    return joined.mapInArrow(rows, schema)
