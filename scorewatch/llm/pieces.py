"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi search.

The search goes through a text once.  Every place keeps the best way to cut the text up to there: its
last piece, and with it a pointer back.  Only the last `longest` places can still be extended, so
only they are held; as soon as the ways of all of them go back to one place, the ids up to that place
are settled and given out.

A vocabulary of merges scores no single piece: a cut is the one that merging leaves.  That holds
exactly if every two neighbouring pieces are what merging leaves of their joint text, so among the
pieces that end at a place the one is kept that its predecessor's last piece allows.  Unigram
vocabularies keep the highest sum of scores.  Signs without a piece become byte pieces.

No piece holds a space mark after another sign, so all ways meet where a space mark follows one; the
texts between such places are short, come up again and again, and are remembered.

Cases: null and empty texts have no ids; a text with the space mark itself decodes to a space there.
Rows given twice are encoded twice.  Extra columns of the input are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from scorewatch.llm.words import gathered, strings, sums, vocabulary_path

MARK = "▁"
#: Documents that are encoded together.
_DOCS = 2000
MEMO = 500_000
_PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def ending_lengths(pieces: Iterable[str], signs: int = 2) -> dict[str, tuple[int, ...]]:
    """By its last signs, the lengths that a piece of as many or more can have, longest first.

    Shorter pieces at the same end follow; 1 is always the last.
    """
    pieces = set(pieces)
    lengths: dict[str, set[int]] = {}
    for piece in pieces:
        if len(piece) >= signs:
            lengths.setdefault(piece[-signs:], {1}).add(len(piece))
    for end, found in lengths.items():
        found.update(k for k in range(2, signs) if end[-k:] in pieces)
    return {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.merges = model.trainer_spec.model_type == 2
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        self.longest = max(map(len, self.ids))
        self.lengths = ending_lengths(self.ids)
        self.endings = [ending_lengths(self.ids, k) for k in (4, 3)]
        self.pairs = {p: (2, 1) for p in self.ids if len(p) == 2}
        #: Neighbours inside any piece; between two signs that are none, every cut of a text has a border.
        self.neighbours = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.allowed: dict[int, bool] = {}

    @cached_property
    def raw(self) -> list[bytes]:
        """What every id decodes to."""
        names = {k: bytes([b]) for b, k in self.bytes.items()}
        return [names.get(k) or t.replace(MARK, " ").encode("utf-8") for k, t in enumerate(self.texts)]

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best-scored neighbours first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.ids.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def allows(self, before: int, piece: int) -> bool:
        """Whether merging leaves these two pieces of their joint text."""
        if len(self.allowed) > MEMO:
            self.allowed.clear()
        a, b = self.texts[before], self.texts[piece]
        found = self.allowed[before << 32 | piece] = self.merged(a + b) == [a, b]
        return found


class Viterbi:
    """Pieces of a stream of text, given out as soon as they are settled; -1 is a sign without a piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the first place that is not settled
        self.sizes, self.last, self.scores = [0], [-1], [0.0]  # of each place: its last piece, score so far
        self.widest = 0

    def feed(self, text: str) -> Iterator[tuple[str, int]]:
        """Take more text; pieces (text, id) that no further text can change."""
        block = 4 * self.v.longest
        for at in range(0, len(text), block):
            self._extend(text[at : at + block])
            self.widest = max(self.widest, len(self.sizes))
            if len(self.sizes) > block:
                yield from self._settle(len(self.text) - self.v.longest + 1)

    def _extend(self, more: str) -> None:
        v, begin = self.v, len(self.text)
        self.text = text = self.text + more
        ids, allowed, sizes, last = v.ids, v.allowed, self.sizes, self.last
        if not v.merges:
            return self._extend_scored(begin)
        (four, three), pairs, single = v.endings, v.pairs, (1,)
        for end in range(begin + 1, len(text) + 1):
            some = (
                end > 3 and four.get(text[end - 4 : end])
                or end > 2 and three.get(text[end - 3 : end])
                or end > 1 and pairs.get(text[end - 2 : end])
                or single
            )
            for size in some:
                if size > end:
                    continue
                piece = ids.get(text[end - size : end], -1)
                if piece < 0 and size > 1:
                    continue
                before = last[end - size]
                if before >= 0 and piece >= 0:
                    found = allowed.get(before << 32 | piece)
                    if not (v.allows(before, piece) if found is None else found):
                        continue
                sizes.append(size)
                last.append(piece)
                break
        return None

    def _extend_scored(self, begin: int) -> None:
        v, text = self.v, self.text
        for end in range(begin + 1, len(text) + 1):
            ways = []
            for size in v.lengths.get(text[max(0, end - 2) : end], (1,)):
                piece = v.ids.get(text[end - size : end], -1) if size <= end else -1
                if size <= end and (piece >= 0 or size == 1):
                    ways.append((self.scores[end - size] + (v.scores[piece] if piece >= 0 else -100.0), size, piece))
            score, size, piece = max(ways)
            self.scores.append(score)
            self.sizes.append(size)
            self.last.append(piece)

    def _settle(self, oldest: int) -> Iterator[tuple[str, int]]:
        """Give out the pieces up to the place that the ways to `oldest` and all later places go through."""
        ways = set(range(max(0, oldest), len(self.sizes)))
        while len(ways) > 1:
            end = max(ways)
            ways.remove(end)
            ways.add(end - self.sizes[end])
        yield from self._cut(ways.pop())

    def _cut(self, place: int) -> Iterator[tuple[str, int]]:
        out, at = [], place
        while at:
            size = self.sizes[at]
            out.append((self.text[at - size : at], self.last[at]))
            at -= size
        if place:
            self.text = self.text[place:]
            self.sizes, self.last = [0, *self.sizes[place + 1 :]], self.last[place:]
            if not self.v.merges:
                self.scores = [x - self.scores[place] for x in self.scores[place:]]
        return reversed(out)

    def end(self) -> Iterator[tuple[str, int]]:
        yield from self._cut(len(self.text))


class Codec:
    """Ids of texts and texts of ids."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        # Ids of a part, and whether they decode to it.
        self.memo: dict[str, tuple[bytes, bool]] = {}
        self.older: dict[str, tuple[bytes, bool]] = {}  # what was in a full memo; still found, then kept anew

    def _short(self, part: str) -> tuple[bytes, bool] | None:
        """:meth:`known` of a part that is searched in one go and has a piece for every sign, else None."""
        search = Viterbi(self.v)
        search._extend(part)
        sizes, last, at, out = search.sizes, search.last, len(part), []
        while at:
            if last[at] < 0:
                return None
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        raw = self.v.raw
        same = b"".join([raw[k] for k in out]) == part.replace(MARK, " ").encode("utf-8", "surrogatepass")
        return struct.pack(f"<{len(out)}i", *out), same

    def _part(self, part: str) -> bytes:
        search, v, out = Viterbi(self.v), self.v, []
        for pieces in (search.feed(part), search.end()):
            for piece, found in pieces:
                if found >= 0:
                    out.append(found)
                elif v.bytes:
                    out += [v.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
                else:
                    out.append(v.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def known(self, part: str) -> tuple[bytes, bool]:
        """Ids of a part, and whether they decode to it."""
        found = self.memo.get(part)
        if found is None:
            found = self.older.get(part)
            if found is None and len(borders := self._borders(part)) > 2:
                inner = [self.known(part[a:b]) for a, b in zip(borders, borders[1:])]
                found = b"".join([x[0] for x in inner]), all(x[1] for x in inner)
            elif found is None and len(part) <= self.v.longest and (short := self._short(part)) is not None:
                found = short
            elif found is None:
                ids = self._part(part)
                found = ids, self.raw_text(np.frombuffer(ids, dtype="<i4").tolist()) == part.replace(MARK, " ")
            if len(part) <= 64:
                self.memo[part] = found
                if len(self.memo) > MEMO:
                    self.older, self.memo = self.memo, {}
        return found

    def _borders(self, part: str) -> list[int]:
        """Places where a piece certainly begins or ends, the ends of the part included."""
        near = self.v.neighbours
        return [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in near), len(part)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.checked(text)[0]

    def checked(self, text: str | None) -> tuple[np.ndarray, bool]:
        """Ids of a text and whether they decode to it; a text whose parts all do is not decoded."""
        if not text:
            return np.zeros(0, dtype="<i4"), True
        parts = [self.known(p) for p in _PARTS.findall((MARK if self.v.prefix else "") + text.replace(" ", MARK))]
        ids = np.frombuffer(b"".join([p[0] for p in parts]), dtype="<i4")
        return ids, all(p[1] for p in parts) or self.decode(ids.tolist()) == text.replace(MARK, " ")

    def batch(self, texts: pa.Array) -> list[tuple[np.ndarray, bool]]:
        """:meth:`checked` of many texts: every distinct word of a batch is looked up once."""
        texts = pc.fill_null(texts, "")
        hard = pc.match_substring_regex(texts, f"{MARK}|  |\\A |\\A\\z| \\z").to_numpy(zero_copy_only=False)
        if not self.v.prefix:
            hard = np.ones(len(texts), dtype=bool)
        out: list = [self.checked(texts[k].as_py()) if hard[k] else None for k in range(len(texts))]
        easy = np.flatnonzero(~hard)
        if len(easy):
            lists = pc.split_pattern(texts.take(pa.array(easy)), " ")
            coded = lists.flatten().dictionary_encode()
            known = [self.known(MARK + w) for w in strings(coded.dictionary)]
            sizes = np.fromiter((len(k[0]) for k in known), dtype=np.int64, count=len(known)) // 4
            odd = np.fromiter((not k[1] for k in known), dtype=np.int64, count=len(known))
            code, edges = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
            ids, after = gathered(np.frombuffer(b"".join([k[0] for k in known]), dtype="<i4"), sizes, code)
            ends, wrong = np.append(0, after)[edges], sums(odd[code], edges)
            for k, a, b, w in zip(easy.tolist(), ends[:-1].tolist(), ends[1:].tolist(), wrong.tolist()):
                own = ids[a:b]
                out[k] = own, not w or self.decode(own.tolist()) == texts[k].as_py()
        return out

    def raw_text(self, ids: Iterable[int]) -> str:
        """The text of ids as it stands, a space of the codec's own included."""
        raw = self.v.raw
        return b"".join([raw[k] for k in ids]).decode("utf-8", "surrogatepass")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; a run of byte pieces is read as UTF-8."""
        text = self.raw_text(ids)
        return text[1:] if self.v.prefix and text.startswith(" ") else text


_READY: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The codec of a model file; a worker serves many tasks and keeps it."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = Codec(path)
    return _READY[path]


def encoded(docs: DataFrame, vocabulary: str, ids: bool = True) -> DataFrame:
    """`doc_id`, `n_ids`, `ids_crc32`, whether the ids decode to the text (`round_trip`), and `ids` if asked for."""
    names = ["doc_id", "n_ids", "ids_crc32", "round_trip"] + ["ids"] * ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary_path(vocabulary))
        for batch in (b.slice(k, _DOCS) for b in batches for k in range(0, b.num_rows, _DOCS)):
            out: list[list] = [[], [], [], []]
            for found, same in codec.batch(batch.column("text")):
                values = (len(found), zlib.crc32(found.tobytes()), same, found)
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            columns = [pa.array(x, k) for x, k in list(zip(out, kinds))[: len(names) - 1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names)

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def decoded(rows_in: DataFrame, vocabulary: str) -> DataFrame:
    """`doc_id` and `text` of rows with `doc_id` and `ids`; null ids give a null text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary_path(vocabulary))
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows_in.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")
