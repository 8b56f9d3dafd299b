"""Character n-gram language models with interpolated Kneser-Ney smoothing.

Letters are lower-cased, every run of other characters is one break, and n symbols of 16 bits are
packed into one number.  Models are hash arrays: per order the sorted hashes (`hash_bits` bits) of
known grams with one log probability per language, and of known contexts with one weight for what
is not known.  The hash width is a parameter and bounds what a model can hold, whatever the corpus.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
CHUNK = 1 << 20
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Symbol of every code point of the first plane: the lower-case letter, or 0."""
    if not _FOLD:
        fold = np.zeros(1 << 16, dtype=np.uint16)
        for c in range(1 << 16):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                fold[c] = ord(low[0]) if ord(low[0]) < 1 << 16 else c
        _FOLD.append(fold)
    return _FOLD[0]


def symbols(text: str) -> np.ndarray:
    """Symbols of a text, breaks as single zeros; starts and ends with a break unless it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if codes.size and codes.max() >= 1 << 16:
        high = np.unique(codes[codes >= 1 << 16])
        letters = high[[unicodedata.category(chr(c))[0] == "L" for c in high.tolist()]]
        # Letters beyond the first plane share the symbols of its private area.
        folded = fold_table()[np.minimum(codes, 0xFFFF)]
        folded = np.where(np.isin(codes, letters), (0xE000 + codes % 0x1900).astype(np.uint16), folded)
    else:
        folded = fold_table()[codes]
    full = np.zeros(len(folded) + 2, dtype=np.uint16)
    full[1:-1] = folded
    out = full[np.concatenate([[True], (full[1:] != 0) | (full[:-1] != 0)])]
    return out if out.any() else out[:0]


def grams(symbol: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed gram that ends at every symbol but the first break; missing ones before it are breaks."""
    packed = np.zeros(max(0, len(symbol) - 1), dtype=np.uint64)
    padded = np.concatenate([np.zeros(order - 2, dtype=np.uint64), symbol.astype(np.uint64)]) if order > 1 else symbol[1:].astype(np.uint64)
    for k in range(order):
        packed = (packed << np.uint64(16)) | padded[k : k + len(packed)]
    return packed


def in_chunks(texts: Iterator[str | None], limit: int = CHUNK) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Grams of consecutive texts, about `limit` at once: (places of the texts, their grams).

    A text of more grams comes in several chunks.
    """
    places, parts, size = [], [], 0
    for place, text in enumerate(texts):
        found = grams(symbols(text or ""))
        for at in range(0, max(1, len(found)), limit):
            part = found[at : at + limit]
            places.append(place)
            parts.append(part)
            size += len(part)
            if size >= limit:
                yield places, parts
                places, parts, size = [], [], 0
    if places:
        yield places, parts


def gram_counts(docs: DataFrame, group: str) -> DataFrame:
    """How often each gram follows its context in all texts of each `group`: `grp`, `gram`, `n`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(key: str) -> pa.RecordBatch:
            keys, counts = held.pop(key)
            return pa.RecordBatch.from_arrays(
                [pa.array([key] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["grp", "gram", "n"]
            )

        for batch in batches:
            names = np.array(batch.column("grp").to_pylist(), dtype=object)
            for key in dict.fromkeys(names.tolist()):
                texts = batch.column("text").filter(pa.array(names == key))
                for _, parts in in_chunks(t.as_py() for t in texts):
                    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                    if key in held:
                        both, at = np.unique(np.concatenate([held[key][0], keys]), return_inverse=True)
                        counts = np.bincount(at, weights=np.concatenate([held[key][1], counts])).astype(np.int64)
                        keys = both
                    held[key] = keys, counts.astype(np.int64)
                    if len(keys) > 2 * CHUNK:
                        yield out(key)
        for key in list(held):
            yield out(key)

    some = docs.select(F.col(group).cast("string").alias("grp"), "text").where("grp is not null and text is not null")
    return some.mapInArrow(rows, "grp string, gram long, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def hashed(packed: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The low `order` symbols of packed grams as hashes of `bits` bits."""
    x = packed & np.uint64((1 << (16 * order)) - 1) if order < 4 else packed.copy()
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """Per order 1..ORDER: sorted hashes, log probabilities by language; the same of contexts with log weights."""

    languages: list[str]
    bits: int
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def ready(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with direct entries into its sorted arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.slots = [self._slots(k) for k in model.keys]
        self.context_slots = [self._slots(k) for k in model.contexts]

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.full(1 << self.model.bits, -1, dtype=np.int32)
        slots[keys] = np.arange(len(keys), dtype=np.int32)
        return slots

    def log_probability(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Natural logs, a row for each gram and a column for each language."""
        m = self.model
        if order == 0:
            return np.full((len(packed), len(m.languages)), m.weights[0][0, 0], dtype=np.float32)
        row = self.slots[order - 1][hashed(packed, order, m.bits)]
        out = m.logs[order - 1][np.maximum(row, 0)]
        new = np.flatnonzero(row < 0)
        if len(new):
            rest = packed[new]
            below = self.log_probability(rest, order - 1)
            context = self.context_slots[order - 1][hashed(rest >> np.uint64(16), order - 1, m.bits)] if order > 1 else np.zeros(len(rest), dtype=np.int32)
            weight = m.weights[order][np.maximum(context, 0)]
            out[new] = below + np.where(context[:, None] >= 0, weight, 0)
        return out


def fit(counts: DataFrame, hash_bits: int = 22, discount: float = 0.75) -> Model:
    """The model of counted grams (`gram_counts`), a language for each group.

    Lower orders count the different symbols before a gram, from the grams of the next order.
    """
    levels = {ORDER: counts.select("grp", "gram", "n")}
    for order in range(ORDER - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram")
        levels[order] = levels[order + 1].select("grp", low).groupBy("grp", "gram").agg(F.count("*").alias("n"))
    tables = {order: _bounded(levels[order], order, hash_bits) for order in levels}
    names = sorted(set().union(*(set(t[0].tolist()) for t in tables.values())))
    index = {name: k for k, name in enumerate(names)}
    model = Model(names, hash_bits, [], [], [], [])
    if not names:
        return model
    vocabulary = max(2, len(np.unique(tables[1][1] & np.int64(0xFFFF))) + 1)
    model.weights.append(np.full((1, 1), -np.log(vocabulary), dtype=np.float32))
    below = np.full((1, len(names)), 1 / vocabulary)
    for order in range(1, ORDER + 1):
        group, gram, n = tables[order]
        packed = gram.view(np.uint64)
        lang = np.array([index[g] for g in group.tolist()], dtype=np.int64)
        key = hashed(packed, order, hash_bits)
        keys, first, row = np.unique(key, return_index=True, return_inverse=True)
        mass = np.zeros((len(keys), len(names)))
        np.add.at(mass, (row, lang), n)
        context = hashed(packed >> np.uint64(16), order - 1, hash_bits) if order > 1 else np.zeros(len(packed), dtype=np.int64)
        contexts, at = np.unique(context, return_inverse=True)
        sums, types = np.zeros((len(contexts), len(names))), np.zeros((len(contexts), len(names)))
        np.add.at(sums, (at, lang), n)
        np.add.at(types, (at, lang), 1)
        weight = np.where(sums > 0, discount * types / np.maximum(sums, 1), 1.0)
        lower = below[0] if order == 1 else below[np.searchsorted(model.keys[-1], hashed(packed[first], order - 1, hash_bits))]
        own = sums[at[first]]
        below = np.maximum(mass - discount, 0) / np.maximum(own, 1) + weight[at[first]] * lower
        model.keys.append(keys)
        model.logs.append(np.log(below).astype(np.float32))
        model.contexts.append(contexts)
        model.weights.append(np.log(weight).astype(np.float32))
    return model


def _bounded(level: DataFrame, order: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups, grams and counts of one order; grams that share a hash are one, so 2 ** bits per group at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("gram").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashed(packed, order, bits))], ["grp", "gram", "n", "h"])

    one = level.mapInArrow(rows, "grp string, gram long, n long, h long").groupBy("grp", "h").agg(F.min("gram").alias("gram"), F.sum("n").alias("n"))
    found = one.select("grp", "gram", "n").toArrow()
    return tuple(found.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "gram", "n"))
