"""Ids of whole texts from a vocabulary, every distinct word encoded once.

A vocabulary cuts texts into words and encodes each word by itself.  A batch of texts is cut with Arrow
into parts, distinct parts into words, and distinct words are looked up in a memory that a worker keeps
from task to task; the rest is copying of ids.  Where the cuts are not certain to be those of the
vocabulary, a part or a text goes to the tokenizer as it is.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers.
_MEMO = 1_000_000
#: A blank with no white space beside it: the splitter of the vocabulary always cuts in front of it.
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BESIDE = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z"
#: Runs of Latin letters, which the splitter takes whole, with a blank in front of them.
_RUN = r"( ?[a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+)"
#: Parts that are not cut at letters: with an apostrophe (a shortened word may follow), blanks, or other signs.
_UNCUT = r"['\x00-\x08\x0b\x0c\x0e-\x20\x7f-\x{a0}]|[^\x00-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}]"
_LATIN = r"\A ?[a-zA-Z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_MARK = "\x01"


def gathered(table: np.ndarray, sizes: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries `code` of a table of runs one after another, and the end of each."""
    runs = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(table))
    found = runs.take(pa.array(code))
    return found.flatten().to_numpy(), found.offsets.to_numpy()[1:]


def strings(texts: pa.Array) -> list[str]:
    """The texts of an array without nulls; many times as fast as `to_pylist`."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def sums(sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of the sizes between one edge and the next."""
    return np.diff(np.append(0, np.cumsum(sizes))[edges])


class Encoder:
    """Little-endian 32-bit ids of texts; see :meth:`batch`."""

    #: Whether a line end between two words is a word too.
    line_ends = True

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Words that were seen, by number, and their ids one after another.
        self.memo: dict[str, int] = {}
        self.ids, self.sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; null is empty."""
        return [self.whole(t) for t in pc.fill_null(texts, "").to_pylist()]

    def whole(self, text: str) -> bytes:
        """Ids of a text that goes to the tokenizer as it is."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _named(self, texts: pa.Array) -> np.ndarray:
        """Which texts name a special token."""
        found = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            found |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return found

    def _fill(
        self, out: list[bytes], places: np.ndarray, edges: np.ndarray, code: np.ndarray, parts: pa.Array
    ) -> None:
        """Ids of texts that consist of the parts `code`; a part that is a known word is not cut again."""
        names = strings(parts)
        number = np.fromiter(map(self.memo.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new, known = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        fresh = parts.take(pa.array(new))
        # Parts of letters are words as they are.
        whole = pc.match_substring_regex(fresh, _LATIN)
        chosen = whole.to_numpy(zero_copy_only=False)
        new = np.append(new[chosen], new[~chosen])
        words = pc.split_pattern(self._cut(fresh.filter(pc.invert(whole))), _MARK)
        whole = fresh.filter(whole)
        word_edges = np.append(np.arange(len(whole)), len(whole) + words.offsets.to_numpy())
        coded = pa.concat_arrays([whole, words.flatten()]).dictionary_encode()
        numbers, ids, sizes = self._words(coded.dictionary)
        word_code = np.append(number[known], numbers[coded.indices.to_numpy()])
        table, _ = gathered(ids, sizes, word_code)
        part_edges = np.append(np.arange(len(known)), len(known) + word_edges)
        place = np.empty(len(names), dtype=np.int64)
        place[np.append(known, new)] = np.arange(len(names))
        ids, after = gathered(table, sums(sizes[word_code], part_edges), place[code])
        data, ends = ids.tobytes(), 4 * np.append(0, after)[edges]
        for k, a, b in zip(places.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[k] = data[a:b]

    def _cut(self, parts: pa.Array) -> pa.Array:
        """Parts with marks between their words."""
        raise NotImplementedError

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of distinct words in a table of ids and sizes.

        New words are remembered until the memory is full; later ones serve one batch.
        """
        memo, names = self.memo, strings(words)
        number = np.fromiter(map(memo.get, names, repeat(-1)), dtype=np.int64, count=len(names))
        new = np.flatnonzero(number < 0)
        fresh = words.take(pa.array(new))
        latin = pc.match_substring_regex(fresh, _LATIN).to_numpy(zero_copy_only=False)
        blank = pc.starts_with(fresh, " ").to_numpy(zero_copy_only=False)
        order = [new[latin & blank], new[latin & ~blank], new[~latin]]
        plain = [[names[k] for k in some.tolist()] for some in order]
        ids, sizes = [self.ids], [self.sizes]
        for own, size in self._plain(plain[0], plain[1]):
            ids.append(own)
            sizes.append(size)
        others = [made.ids for made in self.tokenizer.encode_batch(plain[2], add_special_tokens=False)]
        ids += [np.array(x, dtype="<u4") for x in others]
        sizes.append(np.array([len(x) for x in others], dtype=np.int64))
        table, size = np.concatenate(ids), np.concatenate(sizes)
        number[np.concatenate(order)] = np.arange(len(self.sizes), len(size))
        if len(memo) + len(new) <= _MEMO:
            memo.update(zip(plain[0] + plain[1] + plain[2], range(len(self.sizes), len(size))))
            self.ids, self.sizes = table, size
        return number, table, size


    def _plain(self, blank: list[str], bare: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and sizes of words of letters, in order: those with a blank in front and then those without.

        They share calls, with their blank or else a line end between them.
        """
        for ends, found in enumerate((blank, bare)):
            groups = [found[k : k + 1024] for k in range(0, len(found), 1024)]
            texts = [("\n" * ends).join(g) for g in groups]
            for group, made in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
                owners, step = np.frombuffer(array("q", made.word_ids), dtype=np.int64), 1 + ends * self.line_ends
                own = owners % step == 0  # what is between is a line end
                yield np.frombuffer(array("I", made.ids), dtype="<u4")[own], np.bincount(owners[own] // step, minlength=len(group))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = byte_letters()


class ByteEncoder(Encoder):
    """A byte-level vocabulary, whose words take the blank in front of them along.

    The splitter always cuts in front of a blank that stands alone, and around a run of letters.  So
    texts are cut at such blanks into parts, and distinct parts around letters.
    """

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; null is empty."""
        texts = pc.fill_null(texts, "")
        special = self._named(texts) | pc.match_substring(texts, _MARK).to_numpy(zero_copy_only=False)
        beside = pc.match_substring_regex(texts, _BESIDE).to_numpy(zero_copy_only=False) & ~special
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(special).tolist():
            out[k] = self.whole(texts[k].as_py())
        easy = np.flatnonzero(~special & ~beside)
        if len(easy):
            self._put(out, easy, pc.split_pattern(texts.take(pa.array(easy)), " "))
        hard = np.flatnonzero(beside)
        if len(hard):
            parts = [_BLANK.split(texts[k].as_py()) for k in hard.tolist()]
            self._put(out, hard, pa.array(parts, pa.list_(texts.type)))
        return out

    def _put(self, out: list[bytes], places: np.ndarray, lists: pa.ListArray) -> None:
        """Ids of texts that were cut into parts; all parts but the first had a blank in front."""
        edges = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = edges[:-1]
        parts = pa.concat_arrays(
            [pc.binary_join_element_wise(" ", distinct, ""), distinct.take(pa.array(code[first]))]
        )
        code[first] = len(distinct) + np.arange(len(first))
        self._fill(out, places, edges, code, parts)

    def _plain(self, blank: list[str], bare: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """See :meth:`Encoder._plain`; the splitter leaves such words whole, so they go straight to the merges."""
        tokenize = self.tokenizer.model.tokenize
        for found in (blank, bare):
            for k in range(0, len(found), 1024):
                letters = "\n".join(found[k : k + 1024]).encode().decode("latin-1").translate(_LETTERS)
                tokens = [tokenize(word) for word in letters.split(_LETTERS[10])]
                sizes = np.array([len(word) for word in tokens], dtype=np.int64)
                yield np.frombuffer(array("I", [t.id for word in tokens for t in word]), dtype="<u4"), sizes

    def _cut(self, parts: pa.Array) -> pa.Array:
        bare = pc.replace_substring_regex(parts, r"\A ", "")
        uncut = pc.match_substring_regex(bare, _UNCUT)
        return pc.if_else(uncut, parts, pc.replace_substring_regex(parts, _RUN, f"{_MARK}\\1{_MARK}"))


#: White space, and signs that a lower-casing vocabulary of plain words treats in a known way.
_KNOWN = r"\A[\t\n\r\x20-\x7e\x{a1}-\x{ff}]*\z"
_LETTERS_RUN = r"([a-z\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}]+)"


class WordEncoder(Encoder):
    """A vocabulary of lower-case words that drops white space.

    A text in Latin-1 is cut at white space and its distinct parts around letters; parts with an
    apostrophe stay whole.  Any other text goes to the tokenizer as it is.
    """

    line_ends = False

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of every text; null is empty."""
        texts = pc.fill_null(texts, "")
        known = pc.match_substring_regex(texts, _KNOWN).to_numpy(zero_copy_only=False) & ~self._named(texts)
        known &= ~pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(~known).tolist():
            out[k] = self.whole(texts[k].as_py())
        places = np.flatnonzero(known)
        if len(places):
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts.take(pa.array(places))))
            coded = lists.flatten().dictionary_encode()
            self._fill(out, places, lists.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary)
        return out

    def _cut(self, parts: pa.Array) -> pa.Array:
        cut = pc.replace_substring_regex(parts, _LETTERS_RUN, f"{_MARK}\\1{_MARK}")
        return pc.if_else(pc.match_substring(parts, "'"), parts, cut)


_READY: dict[tuple[type, str], Encoder] = {}


def kept_encoder(kind: type, path: str) -> Encoder:
    """The encoder of a vocabulary; a worker serves many tasks and keeps it."""
    if (kind, path) not in _READY:
        _READY.clear()
        _READY[kind, path] = kind(path)
    return _READY[kind, path]


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name is looked up among the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
