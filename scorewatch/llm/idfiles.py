"""Token ids in binary files, compressed by a grammar (Re-Pair) and readable at any place.

Documents are put in ascending order of `doc_id` by a range partitioning, encoded, each followed by an
end id, and cut into shards of whole documents.  In a shard, frequent pairs of neighbouring symbols
are replaced by new symbols (nonterminals), round after round, until hardly any pair repeats: in each round
a pair is taken where it is more frequent than the pairs it overlaps, so all replacements of a round
are made at once.  A shard stores its rules, the number of ids that each rule stands for, the last
sequence of symbols, and where its documents begin; the lengths say which symbols cover a range of
ids, so any document is decoded without those before it.

The file format is a folder of Parquet files with one row per shard: `part` and `shard` give the
order, `before` the ids of the part before it, `n_ids` its own, `data` the shard.  Spark commits the files, so a lost task leaves
nothing behind, and every store that Spark writes to will do.  Data is a header of little-endian 64-bit numbers
(format, vocabulary size, documents, rules, symbols) and then, little-endian, per document its id (64 bits)
and number of ids (64), per rule left and right symbol (32 each) and number of ids (64), and the symbols (32).

Cases: null text is an empty document (its end id alone); rows given twice are written twice; a null
`doc_id` comes before all others and is read back as null; texts of one id are ordered by a hash; a
document longer than a shard gets a shard of its own; an empty table gives files without rows.  Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.words import ByteEncoder, gathered, kept_encoder, vocabulary_path

FORMAT = 1
#: Ids of a shard; its arrays take about 40 bytes an id while it is compressed.
SHARD_IDS = 1 << 20
#: Slots in which pairs are counted; pairs of one slot share their count, which only guides the choice.
_SLOT_BITS = 18
#: Documents that are encoded together.
_DOCS = 2000
_NO_ID = -(1 << 63)
def compress(ids: np.ndarray, base: int, least: int = 4, gain: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (left, right) and ids per rule; symbol `base + k` is rule k.

    A pair becomes a rule when it is replaced `least` times in a round; a round that shortens the
    sequence by less than `gain` of it is the last.  Pairs are counted in slots of a hash that changes
    from round to round; of two pairs in one slot, one waits for a later round.
    """
    symbols, rules = ids.astype(np.uint32), []
    lengths = np.zeros(0, dtype=np.int64)
    turn = 0
    while len(symbols) > least:
        left, right = symbols[:-1], symbols[1:]
        slot = (left * np.uint32(0x9E3779B1 + 2 * turn) ^ right * np.uint32(0x85EBCA6B + 4 * turn)) >> np.uint32(32 - _SLOT_BITS)
        count = np.minimum(np.bincount(slot, minlength=1 << _SLOT_BITS), 4095).astype(np.uint32)
        often = count >= least
        # Of overlapping pairs the more frequent one wins; among equals the slot decides, and then
        # the first of a run of one and the same pair.
        rank = ((count << np.uint32(_SLOT_BITS)) | np.arange(1 << _SLOT_BITS, dtype=np.uint32)) * often
        rank = rank[slot]
        wins = rank > 0
        wins[1:] &= rank[1:] > rank[:-1]
        wins[:-1] &= rank[:-1] >= rank[1:]
        at = np.flatnonzero(wins)
        own = slot[at]
        pairs = left[at].astype(np.uint64) << np.uint64(32) | right[at]
        taken = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        taken[own] = pairs
        same = taken[own] == pairs
        at, own = at[same], own[same]
        good = np.bincount(own, minlength=1 << _SLOT_BITS) >= least
        fits = good[own]
        at, own = at[fits], own[fits]
        if len(at) < gain * len(symbols):
            break
        number = (np.cumsum(good) + (len(lengths) + base - 1)).astype(np.uint32)
        rules.append(np.stack([taken[good] >> np.uint64(32), taken[good] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        known = np.append(np.ones(base, dtype=np.int64), lengths)
        lengths = np.append(lengths, known[rules[-1]].sum(axis=1))
        symbols = symbols.copy()
        symbols[at] = number[own]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        turn += 1
    return symbols.astype(np.int64), np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64), lengths


class Shard(NamedTuple):
    """A shard as it is stored."""

    base: int
    doc_ids: np.ndarray
    doc_sizes: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def data(self) -> bytes:
        """The shard in the file format."""
        head = np.array([FORMAT, self.base, len(self.doc_ids), len(self.rules), len(self.symbols)], dtype="<i8")
        columns = (
            (self.doc_ids, "<i8"), (self.doc_sizes, "<i8"), (self.rules, "<u4"), (self.lengths, "<i8"), (self.symbols, "<u4")
        )
        return head.tobytes() + b"".join(np.ascontiguousarray(c).astype(kind).tobytes() for c, kind in columns)

    @classmethod
    def read(cls, data: bytes) -> Shard:
        """A shard from its data."""
        kind, base, docs, rules, symbols = np.frombuffer(data, dtype="<i8", count=5).tolist()
        if kind != FORMAT:
            raise ValueError(f"format {kind} is not known")
        at, out = 40, []
        for count, dtype, width in ((docs, "<i8", 8), (docs, "<i8", 8), (2 * rules, "<u4", 4), (rules, "<i8", 8), (symbols, "<u4", 4)):
            out.append(np.frombuffer(data, dtype=dtype, count=count, offset=at).astype(np.int64))
            at += count * width
        if at != len(data):
            raise ValueError("a shard does not end where its header says")
        return cls(base, out[0], out[1], out[2].reshape(-1, 2), out[3], out[4])

    def ids(self, first: int = 0, after: int | None = None) -> np.ndarray:
        """Ids from place `first` to before `after`; only symbols that cover them are expanded."""
        sizes = np.where(self.symbols < self.base, 1, 0)
        rule = self.symbols >= self.base
        sizes[rule] = self.lengths[self.symbols[rule] - self.base]
        ends = np.cumsum(sizes)
        after = int(ends[-1]) if after is None and len(ends) else after or 0
        if after <= first:
            return np.zeros(0, dtype="<u4")
        a, b = int(np.searchsorted(ends, first, side="right")), int(np.searchsorted(ends, after))
        skipped = int(ends[a] - sizes[a])
        found = self.symbols[a : b + 1]
        if len(found) > len(self.rules):
            # Every rule is expanded once, and its ids are copied to where it stands.
            rule = found >= self.base
            code = np.where(rule, found - self.base, len(self.rules) + np.cumsum(~rule) - 1)
            table = np.append(self._expanded(np.arange(len(self.rules)) + self.base), found[~rule])
            sizes = np.append(self.lengths, np.ones(int((~rule).sum()), dtype=np.int64))
            out, _ = gathered(table, sizes, code)
        else:
            out = self._expanded(found)
        return out[first - skipped : after - skipped].astype("<u4")

    def _expanded(self, found: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for, one level of rules after another."""
        while (rule := found >= self.base).any():
            at = np.arange(len(found)) + np.cumsum(rule) - rule
            out = np.empty(len(found) + int(rule.sum()), dtype=np.int64)
            pairs = self.rules[found[rule] - self.base]
            out[at] = found
            out[at[rule]], out[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
            found = out
        return found


_SHARDS = "part int, shard int, before long, n_docs long, n_ids long, n_symbols long, n_rules long, data binary"


def written(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of all documents, in ascending order of `doc_id`, to files in the folder `path`."""
    names = [f.split()[0] for f in _SHARDS.split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = kept_encoder(ByteEncoder, vocabulary_path(vocabulary)), np.array([end_id], dtype="<u4").tobytes()
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        base = max(encode.size, end_id + 1)
        doc_ids: list[int] = []
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            symbols, rules, lengths = compress(ids, base)
            sizes = np.array([len(h) // 4 for h in held])
            data = Shard(base, np.array(doc_ids), sizes, rules, lengths, symbols).data()
            row = (part, shard, before, len(held), len(ids), len(symbols), len(rules), data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in (b.slice(k, _DOCS) for b in batches for k in range(0, b.num_rows, _DOCS)):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text"))):
                found += end
                if held and size + len(found) // 4 > shard_ids:
                    yield closed()
                    before += size
                    doc_ids, held, size, shard = [], [], 0, shard + 1
                doc_ids.append(_NO_ID if doc_id is None else doc_id)
                held.append(found)
                size += len(found) // 4
        if held:
            yield closed()

    # The hash parts rows of one id; the row number parts equal rows, however many there are.
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "text").mapInArrow(rows, _SHARDS).write.parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a folder with `start`, the number of ids in all shards before."""
    files = spark.read.schema(_SHARDS).parquet(path)
    # One number for each partition of the writer comes to the driver.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect()
    at, bases = 0, []
    for part, ids in totals:
        bases.append((part, at))
        at += ids
    return files.join(spark.createDataFrame(bases, "part int, base long"), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Every document of a folder: `doc_id`, `start`, `n_tokens`, `ids_crc32`, `ids` if asked for."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                shard = Shard.read(data)
                found, ends = shard.ids().tobytes(), np.cumsum(shard.doc_sizes)
                parts = [found[4 * a : 4 * b] for a, b in zip((ends - shard.doc_sizes).tolist(), ends.tolist())]
                columns = [
                    pa.array(shard.doc_ids, mask=shard.doc_ids == _NO_ID),
                    pa.array(start + ends - shard.doc_sizes),
                    pa.array(shard.doc_sizes),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(p, dtype="<i4") for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return shards(spark, path).select("start", "data").mapInArrow(rows, schema)


def ranges(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """Ids of some ranges (first, after) of the whole sequence: `first`, `after`, `ids`.

    Only shards that a range touches are read, and in them only the symbols that cover it are expanded.
    """
    asked = sorted(set(wanted))
    touches = F.lit(False)
    for a, b in asked:
        touches = touches | ((F.col("start") < b) & (F.col("start") + F.col("n_ids") > a))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n_ids, data in zip(*(batch.column(c).to_pylist() for c in ("start", "n_ids", "data"))):
                met = [(a, b) for a, b in asked if a < start + n_ids and b > start]
                if met:
                    shard = Shard.read(data)
                    parts = [shard.ids(max(a - start, 0), min(b - start, n_ids)).astype("<i4") for a, b in met]
                    columns = [pa.array([start] * len(met)), *(pa.array(c) for c in zip(*met)), pa.array(parts, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["start", "first", "after", "ids"])

    found = shards(spark, path).where(touches).select("start", "n_ids", "data")
    parts = found.mapInArrow(rows, "start long, first long, after long, ids array<int>").groupBy("first", "after")
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("parts"))
    return joined.select("first", "after", F.flatten("parts.ids").alias("ids"))
