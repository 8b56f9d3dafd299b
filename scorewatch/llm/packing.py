"""Best-fit packing with certified bin counts.

Documents become token ids, an end id after each; only longer ones are cut.  Pieces are dealt to
partitions of bounded size by hash, every partition is packed best-fit decreasing, and
dual-feasible functions give a lower bound that certifies its bin count.  Partitions that need no more
bins than their bound are closed; those with a gap open their least filled bins and exchange the
documents in them, which are packed anew until the bound is met or several rounds save nothing; at last
all partitions do so where the bound of what they open shows a gap.

Cases: null text is an empty document (its end id alone); rows given twice are packed twice; an
empty table packs to no rows.  Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import staged, total
from scorewatch.llm.words import WordEncoder, kept_encoder, vocabulary_path

#: Documents that are encoded together.
_DOCS = 2000


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, ids: bool = True) -> DataFrame:
    """Pieces of at most `size` ids: `doc_id`, `piece`, `start`, `length`, `ids_crc32`, `ids` if asked for."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = kept_encoder(WordEncoder, vocabulary_path(vocabulary)), np.array([end_id], dtype="<u4").tobytes()
        for batch in (b.slice(k, _DOCS) for b in batches for k in range(0, b.num_rows, _DOCS)):
            out: list[list] = [[] for _ in names]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encode.batch(batch.column("text"))):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    found = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, found):
                        column.append(value)
                    if ids:
                        out[-1].append(np.frombuffer(part, dtype="<i4"))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, longest first into the fullest bin that holds it; number of bins."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, count = 0, 0  # bit r of rooms: a bin with r free places is there
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, count = size, count, count + 1
        bins[i], offsets[i] = b, size - room
        left = room - length
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Most bins that a dual-feasible function proves to be needed."""
    return histogram_bound(np.bincount(lengths, minlength=size + 1), size)


def histogram_bound(counts: np.ndarray, size: int) -> int:
    """:func:`lower_bound` from the number of pieces of every length from 0 to `size`.

    For every limit l up to half a bin, lengths over size - l count whole, those under l nothing, the
    others their share; for a step k, lengths count as rounded shares of k + 1.
    """
    length = np.arange(size + 1, dtype=np.int64)
    number, filled = np.cumsum(counts), np.cumsum(length * counts)
    if not number[-1]:
        return 0
    limit = np.arange(1, size // 2 + 1)
    whole = size * (number[-1] - number[size - limit]) + filled[size - limit] - filled[limit - 1]
    best = -(-int(max(filled[-1], whole.max(initial=0))) // size)
    for k in range(1, 21):
        share = (k + 1) * length
        weight = np.where(share % size == 0, k * length, (share // size) * size)
        best = max(best, -(-int((weight * counts).sum()) // (k * size)))
    return best


_PLACED = "bin long, offset long, emptier double, bins long, bound long"


def _packed(rows: DataFrame, size: int, partitions: int, salt: int) -> DataFrame:
    """Pack each of `partitions` hash partitions.

    `emptier` is the share of its partition's bins that are filled less than the row's, 1 for full bins.
    """
    named = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "start"), F.lit(partitions)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema) + ", " + _PLACED

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bins, offsets, count = best_fit(lengths, size)
        filled = np.bincount(bins, weights=lengths, minlength=count)
        emptier = np.empty(count)
        emptier[np.argsort(filled, kind="stable")] = np.arange(count) / count
        emptier[filled >= size] = 1.0
        return group.assign(bin=bins, offset=offsets, emptier=emptier[bins], bins=count, bound=lower_bound(lengths, size))

    return named.groupBy("part").applyInPandas(pack, schema)


def _bound_of(rows: DataFrame, size: int) -> tuple[int, int]:
    """Number of rows and bound of all their lengths together; there are `size` different ones at most."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, count in rows.groupBy("length").agg(F.count("*")).collect():
        counts[length] = count
    return int(counts.sum()), histogram_bound(counts, size)


def place(
    rows: DataFrame, size: int = 2048, per_partition: int = 20_000, opened: float = 0.125, patience: int = 3
) -> DataFrame:
    """`rows` (with `doc_id`, `piece`, `start`, `length`) plus `sequence_id`, `offset`, `bins`, `bound`.

    `bins` and `bound` are the bin count of the partition that placed the row and its certificate.
    Partitions with a gap between the two open the `opened` share of their bins that is filled least;
    the documents in them are dealt out anew and packed again, which mixes those of different
    partitions.  When they have nothing more to gain, all partitions open bins in the same way, as long as the bound of
    the opened documents is below the number of their bins.  A round that saves bins is kept; one that
    hardly does (under a thousandth) doubles the share, and after `patience` of these, or once the bins
    equal the bound of all documents, the packing is done.
    """
    columns = rows.columns
    waiting = staged(rows, "pieces")
    count, needed = _bound_of(waiting, size)
    turn = 0

    def packed(found: DataFrame, count: int) -> tuple[DataFrame, int]:
        now = staged(_packed(found.select(*columns), size, max(1, -(-count // per_partition)), turn), "placed")
        used = now.select("part", "bins").distinct().agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
        numbered = F.lit(turn << 24) + F.col("part")
        return now.withColumn("sequence_id", numbered * (1 << 32) + F.col("bin")), used

    now, used = packed(waiting, count)
    parts, failures, share, everywhere = [now], 0, opened, False

    def chosen(found: DataFrame) -> DataFrame:
        emptiest = F.col("emptier") < share
        return found.where(emptiest if everywhere else emptiest & (F.col("bins") > F.col("bound")))

    def others(found: DataFrame) -> DataFrame:
        emptiest = F.col("emptier") < share
        return found.where(~emptiest if everywhere else ~emptiest | (F.col("bins") <= F.col("bound")))

    while used > needed:
        held = staged(reduce(DataFrame.unionAll, [chosen(p) for p in parts]), "opened")
        held_bins = total(held, F.count_distinct("sequence_id"))[0]
        count, bound = _bound_of(held, size)
        saved = 0
        if held_bins > bound:
            turn += 1
            again, again_bins = packed(held, count)
            saved = held_bins - again_bins
            if saved > 0:
                used, parts = used - saved, [*[others(p) for p in parts], again]
        if saved * 1000 < max(1, held_bins):
            failures, share = failures + 1, min(1.0, 2 * share)
            if failures == patience or not held_bins:
                if everywhere:
                    break
                everywhere, failures, share = True, 0, opened
    out = reduce(DataFrame.unionAll, parts)
    return out.select(*columns, "sequence_id", "offset", "bins", "bound")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed ids themselves: `sequence_id`, `ids`, `doc_ids`; `placed` must carry `ids`."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("inside")
    return placed.groupBy("sequence_id").agg(inside).select(
        "sequence_id", F.flatten("inside.ids").alias("ids"), F.col("inside.doc_id").alias("doc_ids")
    )
