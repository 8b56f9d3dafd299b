"""Exact repeats by suffix arrays: every byte in a string of `length` bytes that also starts elsewhere.

Two equal strings choose the same gram inside them: the one with the least hash, leftmost.  So the
starts of all strings of a text fall into runs that share their gram, and only runs with an equal
gram can hold equal strings.  Runs with equal bytes all the way are repeats of each other; where a
gram has several kinds of runs, one of each kind goes to a shard, chosen by the gram, and the shard's
suffix array tells which of their strings start more than once.  A gram with very many kinds is
never gathered: its runs are cut anew by longer grams, at last by the whole string.

A shard is sorted by induction: suffixes are classified, the leftmost smaller (LMS) substrings are
named by one induced pass and ranked recursively, each round on twice as many names, then all other
suffixes are induced bucket by bucket, which takes linear time.  Common prefixes with the preceding
suffix are computed in text order; they are compared byte for byte only where they are irreducible.

Cases: null text is empty; texts under `length` bytes have no repeats; rows given twice repeat each
other; a null id is a document like any other.  Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import staged, total

BUFFER = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(BUFFER, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the `gram` bytes from each place; `data` has at most BUFFER bytes."""
    power, inverse = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    x = (sums[gram:] - sums[:n]) * inverse[:n]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash, leftmost among equals, of each `width` neighbours."""
    shift = np.uint64(20)
    low = (hashes >> shift << shift) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64)


def runs_of(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of string starts that share their gram: text number, first start, last start, gram hash."""
    todo, size = [], 0
    parts = [
        (k, at, t[at : at + BUFFER])
        for k, t in enumerate(texts)
        for at in range(0, max(1, len(t) - length + 1), BUFFER - length + 1)
        if len(t) >= length
    ]
    for k, (number, at, part) in enumerate(parts):
        todo.append((number, at, part))
        size += len(part)
        if k + 1 == len(parts) or size + len(parts[k + 1][2]) > BUFFER:
            data = np.frombuffer(b"".join(p for _, _, p in todo), dtype=np.uint8)
            hashes = gram_hashes(data, gram)
            place = least_places(hashes, length - gram + 1)
            sizes = np.array([len(p) for _, _, p in todo])
            begin = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(todo)), sizes)[: len(place)]
            starts = np.arange(len(place))
            inside = starts + length <= (begin + sizes)[owner]
            new = inside.copy()
            new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
            last = inside.copy()
            last[:-1] &= new[1:] | ~inside[1:]
            first, last = np.flatnonzero(new), np.flatnonzero(last)
            who = owner[first]
            numbers = np.array([n for n, _, _ in todo])[who]
            offset = np.array([a for _, a, _ in todo])[who] - begin[who]
            yield numbers, first + offset, last + offset, hashes[place[first]].view(np.int64)
            todo, size = [], 0


def _stable_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and the number of equal keys before each in that order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return order, np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def _induce(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order from the order `lms` of the leftmost smaller suffixes; `ends` are bucket ends."""
    sa = np.full(len(t), -1, dtype=np.int64)
    order, nth = _stable_groups(t[lms][::-1])
    sa[ends[t[lms[::-1][order]]] - 1 - nth] = lms[::-1][order]
    heads = np.concatenate([[0], ends[:-1]])
    filled = heads.copy()
    symbols = np.flatnonzero(ends > heads)

    def spread(found: np.ndarray, larger: bool, at: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before] != larger]
        if len(before):
            keys = t[before]
            order, nth = _stable_groups(keys)
            keys = keys[order]
            sa[at[keys] + nth if larger else at[keys] - 1 - nth] = before[order]
            counts = np.bincount(keys, minlength=len(at))
            at += counts if larger else -counts

    for c in symbols:  # larger suffixes, from the left
        done = heads[c]
        while done < filled[c]:
            done, wave = filled[c], sa[done : filled[c]]
            spread(wave, True, filled)
        rest = sa[filled[c] : ends[c]]
        spread(rest[rest >= 0], True, filled)
    left = ends.copy()
    for c in symbols[::-1]:  # smaller suffixes, from the right; the places of the LMS ones are filled anew
        done = ends[c]
        while done > left[c]:
            done, wave = left[c], sa[left[c] : done][::-1]
            spread(wave, False, left)
        spread(sa[heads[c] : filled[c]][::-1], False, left)
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `t` in order; the last symbol must be the only 0."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    change = np.flatnonzero(t[:-1] != t[1:])
    to = change[np.minimum(np.searchsorted(change, np.arange(n - 1)), len(change) - 1)]
    smaller = np.ones(n, dtype=bool)  # the suffix is smaller than the next one
    smaller[:-1] = t[to] < t[to + 1]
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(t))
    first = _induce(t, smaller, lms, ends)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]  # LMS substrings in order
    number = np.zeros(n, dtype=np.int64)
    number[lms] = np.arange(len(lms))
    stop = np.append(lms[1:] + 1, n)
    size = (stop - lms)[number[ranked]]
    same = np.zeros(len(ranked), dtype=bool)
    like = np.flatnonzero(size[1:] == size[:-1]) + 1
    step = 0
    while len(like):  # equal neighbours, one symbol more at a time
        over = step >= size[like]
        same[like[over]] = True
        like = like[~over]
        like = like[t[ranked[like] + step] == t[ranked[like - 1] + step]]
        step += 1
    names = np.zeros(len(lms), dtype=np.int64)
    names[number[ranked]] = np.cumsum(~same) - 1
    span = 1
    while names.max() + 1 < len(names):  # rank by twice as many names in each round
        follow = np.zeros(len(names), dtype=np.int64)
        follow[:-span] = names[span:] + 1 if span < len(names) else 0
        names = np.unique(names * (len(names) + 1) + follow, return_inverse=True)[1]
        span *= 2
    sorted_lms = np.empty(len(lms), dtype=np.int64)
    sorted_lms[names] = lms
    return _induce(t, smaller, sorted_lms, ends)


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """In text order, the length that each suffix has in common with the one before it in `sa`.

    Where the symbols ahead of both are equal, the value is one less than that of the text position
    before; only the others are compared, whose lengths add up to little.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, dtype=bool)
    own[1:] = (before[1:] < 1) | (t[:-1] != t[before[1:] - 1])
    places = np.flatnonzero(own)
    value = np.zeros(len(places), dtype=np.int64)
    padded = np.concatenate([t, np.zeros(8, dtype=t.dtype)])
    active = np.flatnonzero(before[places] >= 0)
    while len(active):
        a, b = places[active] + value[active], before[places[active]] + value[active]
        equal = np.stack([padded[a + k] == padded[b + k] for k in range(8)])
        grown = np.where(equal.all(axis=0), 8, equal.argmin(axis=0))
        value[active] += grown
        active = active[grown == 8]
    origin = np.cumsum(own) - 1
    return np.maximum(value[origin] - (np.arange(n) - places[origin]), 0)


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """Of each part, which of its strings of `length` bytes start in the parts more than once."""
    sizes = np.array([len(p) + 1 for p in parts])
    t = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8).astype(np.int16) + np.int16(2)
    ends = np.cumsum(sizes) - 1
    t[ends] = 1
    t = np.append(t, np.int16(0))
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa)
    with_before = prefix >= length
    repeated = with_before.copy()
    order_before = np.full(len(t), -1, dtype=np.int64)
    order_before[sa[1:]] = sa[:-1]
    repeated[order_before[with_before]] = True
    return [repeated[e - s + 1 : max(e - s + 1, e - length + 1)] for s, e in zip(sizes, ends)]


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """`seed`, digest `ctx` of all bytes of the run, `uid`, `base`, first and last start `a`, `b`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.as_py() or b"" for x in batch.column("data")]
            uid, base = batch.column("uid").to_numpy(), batch.column("base").to_numpy()
            for number, a, b, seed in runs_of(data, length, gram):
                digest = xxhash.xxh3_128_digest
                ctx = [digest(data[k][x : y + length]) for k, x, y in zip(number.tolist(), a.tolist(), b.tolist())]
                own = base[number]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(ctx, pa.binary()), pa.array(uid[number]), pa.array(own), pa.array(a + own), pa.array(b + own)],
                    ["seed", "ctx", "uid", "base", "a", "b"],
                )

    return texts.select("uid", "base", "data").mapInArrow(rows, "seed long, ctx binary, uid long, base long, a long, b long")


def repeated_runs(
    texts: DataFrame, length: int = 400, grams: tuple[int, ...] = (128, 256, 336), kinds: int = 2000, shard_bytes: int = 1 << 21
) -> DataFrame:
    """`uid`, `a`, `b`: the strings that start at a..b of this text also start elsewhere.

    `texts` has `uid`, `base` (its place in the document) and `data`.  A gram with over `kinds`
    kinds of runs goes on with the next of `grams`, and after the last with the whole string.
    """
    out = None
    for gram in (*(g for g in grams if g < length), length):
        runs = staged(_runs(texts, length, gram), "runs")
        equal = runs.groupBy("seed", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("uid", "base", "a", "b")).alias("one"))
        several = equal.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1")
        known = equal.join(several, "seed", "left").where("n > 1 or kinds is not null")
        known = staged(known.select("seed", "ctx", "n", "kinds", "one.uid", "one.base", "one.a", "one.b"), "known")
        # From a table, so that the join may split a run that very many texts share.
        copies = known.where("n > 1").select("seed", "ctx")
        found = runs.join(copies, ["seed", "ctx"], "left_semi").select("uid", "a", "b")
        out = found if out is None else out.unionAll(found)
        if gram == length:
            break
        wanted = known.where("kinds is not null").drop("ctx")
        cut = F.expr(f"substring(data, int(a - base + 1), int(b - a + {length}))")
        parts = staged(wanted.join(texts, ["uid", "base"]).select("seed", "kinds", "n", "uid", "a", cut.alias("data")), "parts")
        size, most = total(parts, F.coalesce(F.sum(F.length("data")), F.lit(0)), F.coalesce(F.max("kinds"), F.lit(0)))
        shards = max(1, -(-size // shard_bytes))

        def sort(group: pd.DataFrame) -> pd.DataFrame:
            flags = repeated_starts(group["data"].tolist(), length)
            uid, a, b = [], [], []
            for u, start, n, own in zip(group["uid"], group["a"], group["n"], flags):
                first, last = _spans(own) if n == 1 else ((), ())
                uid += [u] * len(first)
                a += [start + x for x in first]
                b += [start + x for x in last]
            return pd.DataFrame({"uid": uid, "a": a, "b": b}, dtype="int64")

        sharded = parts.where(F.col("kinds") <= kinds).withColumn("shard", F.pmod(F.xxhash64("seed"), F.lit(shards)))
        out = out.unionAll(sharded.groupBy("shard").applyInPandas(sort, "uid long, a long, b long"))
        if most <= kinds:
            break
        hot = parts.where(F.col("kinds") > kinds)
        texts = hot.select("uid", F.col("a").alias("base"), "data")
    return out


def without_repeats(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    """`doc_id`, `n_bytes`, removed `spans` (first byte, byte after the last) and `kept` bytes of every row."""
    data = F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("data")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), data)
    found = staged(repeated_runs(texts.select("uid", F.lit(0).cast("long").alias("base"), "data"), length, **options), "repeats")
    by_text = found.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for data, found in zip(batch.column("data"), batch.column("found").to_pylist()):
                data, spans = data.as_py(), []
                for a, b in sorted((x["a"], x["b"] + length) for x in found or ()):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                edges = [0, *(x for s in spans for x in s), len(data)]
                out[0].append(len(data))
                out[1].append([{"first": a, "after": b} for a, b in spans])
                out[2].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_bytes", "spans", "kept"]
            )

    schema = "doc_id long, n_bytes long, spans array<struct<first: long, after: long>>, kept binary"
    return texts.join(by_text, "uid", "left").select("doc_id", "data", "found").mapInArrow(rows, schema)

