"""Near copies of embeddings by collision-counting projections.

Unit vectors are projected on many random lines.  On every line the values are sorted, and a window
around each query value tells which vectors collide with it there.  Two vectors at the smallest
allowed cosine collide on a line with a known chance, so the number of lines on which they collide is
binomial; pairs with fewer collisions than a pair at the limit reaches with probability `recall` are
passed over, all others are checked by their exact cosine.

Equal vectors are one class and are compared once.  A label with many classes is cut into blocks of
bounded size, and every pair of blocks is one small group, so no label meets in one task; a group
returns link counts and the stars of its local groups, never its pairs.

Cases: rows whose label or vector is null, or whose vector is empty, zero or holds a null or a
non-finite number, have no links and are kept; vectors of different lengths never link; a null id
never names a group and is not kept.  Extra columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import connected, staged

BLOCK = 2048
STRIP = 256


def collision_rule(cosine: float, lines: int, recall: float, share: float = 0.5) -> tuple[float, int]:
    """Half width of the window and the count that a pair at the limit reaches with `recall`."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    chance = math.erf(share / math.sqrt(2))
    tail, count = 1.0, 0
    while count < lines:
        tail -= math.comb(lines, count) * chance**count * (1 - chance) ** (lines - count)
        if tail < recall:
            break
        count += 1
    return share * limit + 1e-9, count


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def candidates(left: np.ndarray, right: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `left` and `right` (projected values, a line in each column) that collide `least` times."""
    counts = np.zeros(len(left) * len(right), dtype=np.int32)
    base = np.arange(len(left)) * len(right)
    for line in range(left.shape[1]):
        order = np.argsort(right[:, line], kind="stable")
        values = right[order, line]
        first = np.searchsorted(values, left[:, line] - width, "left")
        size = np.searchsorted(values, left[:, line] + width, "right") - first
        ends = np.cumsum(size)
        inside = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)
        counts[np.repeat(base, size) + order[inside]] += 1  # a window meets a row once, so no index repeats
    found = np.flatnonzero(counts >= least)
    return found // max(1, len(right)), found % max(1, len(right))


def linked_pairs(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, lines: int, recall: float, seed: int):
    """Index pairs (left, right) of unit `vectors` with at least this cosine, in strips of `left`."""
    width, least = collision_rule(cosine, lines, recall)
    axes = np.random.default_rng(seed).standard_normal((vectors.shape[1], lines))
    values = vectors @ axes
    for at in range(0, len(left), STRIP):
        strip = left[at : at + STRIP]
        a, b = candidates(values[strip], values[right], width, least)
        a, b = strip[a], right[b]
        for part in range(0, len(a), 1 << 16):
            x, y = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
            sure = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= cosine
            yield x[sure], y[sure]


def near_vectors(
    rows: DataFrame, cosine: float = 0.93, lines: int = 64, recall: float = 0.999, block: int = BLOCK, seed: int = 7
) -> DataFrame:
    """`vec_id`, `n_links`, `component_id`, `kept` of every row of (`vec_id`, `embedding`, `label`)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    strange = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & ~strange & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = staged(
        rows.where("usable").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("lowest"))
        .withColumn("uid", F.monotonically_increasing_id()),
        "vectors",
    )
    sized = classes.withColumn("width", F.size("embedding"))
    blocks = sized.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    paired = (
        sized.join(blocks, ["label", "width"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("label", "width", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "uid", "copies", "embedding")
    )

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        vectors = unit(np.stack(group["embedding"].to_numpy()).astype(np.float64))
        uid, copies = group["uid"].to_numpy(), group["copies"].to_numpy()
        i, j, side = group["i"].iloc[0], group["j"].iloc[0], group["mine"].to_numpy()
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        n_links, root = np.zeros(len(uid), dtype=np.int64), list(range(len(uid)))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in linked_pairs(vectors, left, right, cosine, lines, recall, seed):
            if i == j:
                a, b = a[a < b], b[a < b]
            np.add.at(n_links, a, copies[b])
            np.add.at(n_links, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = top(x), top(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        found = np.flatnonzero(n_links)
        return pd.DataFrame({"uid": uid[found], "links": n_links[found], "hub": uid[[top(k) for k in found.tolist()]]})

    found = staged(paired.groupBy("label", "width", "i", "j").applyInPandas(pairs, "uid long, links long, hub long"), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    groups = connected(found.select("uid", "hub"), "uid", "hub").withColumnRenamed("node", "uid")
    named = classes.drop("label", "embedding").join(groups, "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = named.join(lowest, "root").join(links, "uid", "left").select(
        "uid", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    known = classes.select("label", "embedding", "uid").join(named, "uid").drop("uid")
    linked = rows.where("usable").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
