"""Near copies by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into fewer segments than the allowed differing bits need for an equal
one: with s segments of which one differs in at most one bit, d <= 2s - 1 bits can be allowed.  A
segment that is equal meets under its own value, one that differs in bit i under its value with
bit i deleted; there only the side with a zero meets the side with a one, so equal segments do not
come up again.  The join checks the full distance itself, so only links leave it.

Cases: null and blank texts have fingerprint zero and form one group; rows given twice count twice;
a null id never names a group.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import connected, identity, staged

BITS = 64


def shingles_of(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text; of the whole text where it has no more words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, 42)] if tokens else []
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = (ends - [len(t) for t in tokens])[: len(tokens) - words + 1].tolist()
        hashes = [digest(joined[a:z], 42) for a, z in zip(starts, ends[words - 1 :].tolist())]
    return np.array(hashes, dtype="<u8")


def _prints(plain: np.ndarray, several: int) -> list[int]:
    if not len(plain):
        return [0] * several
    found = []
    for k in range(several):
        mixed = plain
        if k:
            mixed = (plain + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
        rows = mixed.view(np.uint8).reshape(-1, 8)
        ones = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(rows), 1 << 14):  # very long texts, piece by piece
            ones += np.unpackbits(rows[at : at + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.uint16)
        found.append(int(np.packbits(2 * ones > len(rows), bitorder="little").view("<i8")[0]))
    return found


def fingerprint_of(text: str | None, words: int, several: int = 1) -> list[int]:
    """Signed SimHashes of the word shingles of a text; ties of a bit give zero.

    The first is of the shingles' XXH64, `several` more are of that value mixed with their number.
    """
    return _prints(shingles_of(text, words), several)


def fingerprints(docs: DataFrame, words: int = 5, several: int = 1) -> DataFrame:
    """`doc_id` and signed 64-bit `fp` of every row, with more than one `fp`, `fp1`, ..."""
    names = ["fp", *(f"fp{k}" for k in range(1, several))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t, words, several) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(several)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{n} long" for n in ["doc_id", *names]))


def _index(prints: DataFrame, segments: int, side: int) -> DataFrame:
    """One row per segment (its value) and per bit of it that has the value `side` (deleted)."""
    keys = []
    for k, (low, high) in enumerate(_ranges(segments)):
        width = high - low
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        slot = lambda i: F.lit(((k << 7) | i) << 32)  # noqa: B023, E731
        keys.append(value + slot(0))
        for i in range(width):
            bit = F.lit(1 << i)
            keys.append(
                F.when(value.bitwiseAND(bit) == (bit if side else F.lit(0)), value.bitwiseAND(F.lit(~(1 << i))) + slot(i + 1))
            )
    return prints.select("fp", F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("key"))


def _ranges(segments: int) -> list[tuple[int, int]]:
    return [(BITS * k // segments, BITS * (k + 1) // segments) for k in range(segments)]


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs `a` < `b` of different fingerprints (`fp`, distinct) within `distance` bits, each once.

    A pair may meet in several segments; the first of those that differ in at most one bit reports it.
    Spark sizes an exploded side as its source, so that the sides would be broadcast while the
    fingerprints alone are small enough; sides of some 35 rows each are always dealt out.
    """
    segments = max(2, (distance + 2) // 2)
    zeros = _index(prints, segments, 0).withColumnRenamed("fp", "a")
    ones = _index(prints, segments, 1).withColumnRenamed("fp", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    deleted = F.shiftright(zeros["key"], 32).bitwiseAND(F.lit(127)) != 0
    segment = F.shiftright(zeros["key"], 39)
    first = F.lit(True)
    for k, (low, high) in enumerate(_ranges(segments)[:-1]):
        mask = ((1 << high) - 1) ^ ((1 << low) - 1)
        first &= (segment <= k) | (F.bit_count(differing.bitwiseAND(F.lit(mask))) > 1)
    near = F.bit_count(differing) <= distance
    met = zeros.hint("merge").join(ones, (zeros["key"] == ones["key"]) & (deleted | (F.col("a") < F.col("b"))) & near & first)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def grouped(rows: DataFrame, distance: int) -> DataFrame:
    """`rows` (`doc_id`, `fp`) with `component_id`, the smallest id reachable over links.

    Equal fingerprints are grouped before anything is compared, so copies cost one row.
    """
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = connected(links(prints.select("fp"), distance), "a", "b")
    known = prints.join(groups, prints["fp"] == groups["node"]).select("fp", "root", "first_id")
    lowest = known.groupBy("root").agg(F.min("first_id").alias("lowest"))
    moved = known.join(lowest, "root").select("fp", "lowest")
    names = prints.join(moved, "fp", "left").select("fp", F.coalesce("lowest", "first_id").alias("component_id"))
    # From a table, so that the join below may split a fingerprint that very many rows have.
    return rows.join(staged(names, "groups"), "fp")


def near_copies(docs: DataFrame, words: int = 5, distance: int = 3) -> DataFrame:
    """`doc_id`, `fp` and `component_id`, the smallest id reachable over links, of every row."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    return grouped(rows, distance).select("doc_id", "fp", "component_id")


#: Least Jaccard similarity of near copies: this many fifths of the distinct shingles of both.
FIFTHS = 4
#: Fingerprints of a document, and bits of each of the bands they are cut into.
SEVERAL, BAND = 4, 16
#: Bits of the first two fingerprints that may differ; near copies at 0.8 differ in 19 of 128, with a deviation of 4.
DIFFERING = 40
#: Distinct sets of fewer than five shingles share less than 0.8 with any other, but one of four with one of five.
COMPARED = "n >= 4"
#: Documents whose sets are held together.
_SETS = 500
#: Longs of the parity sketch of a shingle set; its columns in rows that are compared.
PARITY = 4
PARITIES = [f"parity{k}" for k in range(PARITY)]


def _copy_key() -> Column:
    """What rows of equal texts share, besides their identity."""
    return F.xxhash64("text")


def parity_of(kinds: np.ndarray) -> list[int]:
    """Of each of 256 cells whether an odd number of the distinct hashes `kinds` falls in it.

    A hash that is in both of two sets changes neither side, so at most as many cells differ as
    hashes are in one set only.
    """
    cells = ((kinds >> np.uint64(20)) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = (np.bincount(cells, minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def _missing(n: Column | int) -> Column | int:
    """Of `n` distinct shingles, how many a near copy can lack at most."""
    whole = F.floor if isinstance(n, Column) else int
    return whole(n * (5 - FIFTHS) / 5)


def _extra(n: Column | int) -> Column | int:
    """How many more of the least hashes of `n` are kept than a near copy can lack."""
    whole = F.floor if isinstance(n, Column) else int
    return whole(n / 10) + 1


def _sets(known: DataFrame, words: int) -> DataFrame:
    """`doc_id`, `copy`, `n` distinct shingles, `node` (a hash of their set), `fps`, `parity` and `least` of every row.

    `least` holds the least hashes of the set, in their order and some more than a near copy can lack.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, _SETS) for b in batches for k in range(0, b.num_rows, _SETS)):
            sizes, nodes, prints, parities, least = [], [], [], [], []
            for text in batch.column("text"):
                plain = shingles_of(text.as_py(), words)
                kinds = np.unique(plain)
                sizes.append(len(kinds))
                nodes.append(xxhash.xxh64_intdigest(kinds.tobytes(), 7) - (1 << 63))
                prints.append(_prints(kinds, SEVERAL))
                parities.append(parity_of(kinds))
                least.append(kinds[: _missing(len(kinds)) + _extra(len(kinds))].astype("<i8"))
            lists = pa.list_(pa.int64())
            columns = [pa.array(x, pa.int64()) for x in (sizes, nodes)] + [pa.array(x, lists) for x in (prints, parities, least)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), *columns],
                ["doc_id", "copy", "n", "node", "fps", "parity", "least"],
            )

    lists = "fps array<long>, parity array<long>, least array<long>"
    return known.mapInArrow(rows, f"doc_id long, copy long, n long, node long, {lists}")


def _bands(nodes: DataFrame) -> DataFrame:
    """One row per node and band of its fingerprints: its number and bits (`key`)."""
    keys = [
        F.shiftrightunsigned(F.col("fps")[k], low).bitwiseAND(F.lit((1 << BAND) - 1)) + F.lit((k * BITS + low) << BAND)
        for k in range(SEVERAL)
        for low in range(0, BITS, BAND)
    ]
    some = nodes.where(COMPARED).select(
        "node", "n", F.col("fps")[0].alias("fp"), F.col("fps")[1].alias("fp1"), *_parities(), F.array(*keys).alias("keys")
    )
    return some.select("node", "n", "fp", "fp1", *PARITIES, F.explode("keys").alias("key"))


def _parities() -> list[Column]:
    return [F.col("parity")[k].alias(name) for k, name in enumerate(PARITIES)]


def _differing(a: DataFrame, b: DataFrame, *names: str) -> Column:
    return reduce(add, [F.bit_count(a[c].bitwiseXOR(b[f"other_{c}"])) for c in names])


def _may_be_near(a: DataFrame, b: DataFrame) -> Column:
    """What surely holds for every pair at the least similarity: the shares of sizes and of odd cells.

    Two sets that share four fifths of their union have at most a ninth of their sizes in one of them only.
    """
    sizes = 5 * F.least(a["n"], b["other_n"]) >= FIFTHS * F.greatest(a["n"], b["other_n"])
    return sizes & ((5 + FIFTHS) * _differing(a, b, *PARITIES) <= (5 - FIFTHS) * (a["n"] + b["other_n"]))


def _shared_least(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of the `marked` nodes and those of their least hashes (`key`) under which any near copies meet.

    The k-th least of the hashes that two near copies share stands at most as many places after k in
    either as that one has hashes which the other lacks: a fifth.  So both keep the first ones, as many as
    the smaller keeps beyond its fifth (`_extra`).  Nodes of which fewer kept hashes are kept by any other
    node have no near copy and are left aside.
    """
    keys = rows.where(COMPARED).select("node", "n", F.explode("least").alias("key"))
    several = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("key")
    found = staged(keys.hint("merge").join(staged(several, "repeated"), "key"), "hits")
    # Rows of one node are alike, so its hits are counted as often as it has rows.
    enough = marked.join(found.groupBy("node").agg(F.count("*").alias("hits")), "node")
    enough = enough.where(F.col("hits") >= F.col("copies") * _extra(F.col("n") - _missing(F.col("n")))).select("node", "own", "linked", *_parities())
    return staged(found.distinct().join(enough, "node"), "index")


def _renamed(bands: DataFrame) -> DataFrame:
    return bands.select(*[F.col(c).alias(c if c == "key" else f"other_{c}") for c in bands.columns])


def _verified(pairs: DataFrame, nodes: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """The `pairs` (`a`, `b`) whose distinct shingles have a Jaccard similarity of 0.8 at least, from their texts."""
    pairs = staged(pairs.distinct(), "pairs")
    needed = pairs.selectExpr("explode(array(a, b)) node").distinct()
    named = nodes.select("node", "first.doc_id", "first.copy").join(needed, "node", "left_semi")
    texts = known.join(named, ["doc_id", "copy"]).dropDuplicates(["node"]).select("node", "text")
    texts = staged(texts, "texts")
    both = pairs.join(texts.selectExpr("node a", "text left_text"), "a").join(texts.selectExpr("node b", "text right_text"), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, np.ndarray] = {}

        def kinds(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in memo:
                if len(memo) >= 256:
                    memo.clear()
                memo[node] = np.unique(shingles_of(text.as_py(), words))
            return memo[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["left_text"], batch["right_text"]):
                one, other = kinds(a, x), kinds(b, y)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(5 * shared >= FIFTHS * (len(one) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.select("a", "b", "left_text", "right_text").mapInArrow(rows, "a long, b long"), "links")


def survivors(docs: DataFrame, words: int = 5) -> DataFrame:
    """`doc_id` and `copy` (a hash of the text) of the one document that stays of each group of near copies.

    A document without an id is known by a hash of its text; rows of one id with other texts are
    other documents.  The smallest id stays.  Groups are joined by links of all fingerprints, and a
    link is a pair whose distinct shingles have a Jaccard similarity of 0.8 at least, counted from
    their texts.  Equal sets of shingles are one node.

    So that a large group does not make all of its pairs, every node is first compared with the
    smallest one of each value of 16 bands of 16 bits of its fingerprints.  Then two nodes meet where they share
    enough of their least hashes, which all pairs at 0.8 do: under each such hash all pairs of different groups are
    counted, and those of its commonest group among themselves need not be.  Sizes and a parity sketch are compared inside these
    joins, so of a group whose members resemble each other without being near copies few pairs reach their texts.
    """
    known = docs.select(identity().alias("doc_id"), _copy_key().alias("copy"), "text")
    rows = staged(_sets(known, words), "sets")
    nodes = staged(
        rows.groupBy("node").agg(
            F.min(F.struct("doc_id", "copy")).alias("first"),
            F.count("*").alias("copies"),
            *[F.first(c).alias(c) for c in ("n", "fps", "parity")],
        ),
        "nodes",
    )
    bands = _bands(nodes)
    lead = bands.groupBy("key").agg(F.min(F.struct("node", "n", "fp", "fp1", *PARITIES)).alias("lead"), F.count("*").alias("many"))
    lead = _renamed(staged(lead.where("many > 1").select("key", "lead.*"), "leads"))
    close = _may_be_near(bands, lead) & (_differing(bands, lead, "fp", "fp1") <= DIFFERING)
    met = bands.hint("merge").join(lead, (bands["key"] == lead["key"]) & (bands["node"] > lead["other_node"]) & close)
    found = _verified(met.select(F.col("other_node").alias("a"), F.col("node").alias("b")), nodes, known, words)

    groups = connected(found, "a", "b")
    marked = nodes.join(groups, "node", "left").withColumn("own", F.coalesce("root", "node"))
    index = _shared_least(rows, marked.withColumn("linked", F.col("root").isNotNull()))
    counts = index.where("linked").groupBy("key", "own").count()
    chief = staged(counts.groupBy("key").agg(F.max(F.struct("count", "own"))["own"].alias("chief")), "chiefs")
    index = index.join(chief, "key", "left")
    minor, every = index.where("chief is null or own <> chief"), _renamed(index)
    once = F.coalesce(every["other_own"] == every["other_chief"], F.lit(False)) | (minor["node"] < every["other_node"])
    met = minor.hint("merge").join(
        every, (minor["key"] == every["key"]) & (minor["own"] != every["other_own"]) & once & _may_be_near(minor, every)
    )
    ends = F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")
    shared = met.groupBy(*ends, F.least("n", "other_n").alias("n")).count()
    met = shared.where(F.col("count") >= _extra(F.col("n"))).select("a", "b")
    found = found.unionAll(_verified(met, nodes, known, words))

    groups = connected(found, "a", "b")
    grouped_nodes = nodes.select("node", "first").join(groups, "node", "left").withColumn("own", F.coalesce("root", "node"))
    return grouped_nodes.groupBy("own").agg(F.min("first").alias("first")).select("first.*")
