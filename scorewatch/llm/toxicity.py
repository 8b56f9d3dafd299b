"""Toxicity of restored text: a noisy-channel decoder under a character model, then a learned lexicon.

A token with digits or signs among its letters, with a letter three times in a row, or spelled out
letter by letter, is a lattice: every sign may stand for letters it resembles, for itself (a break),
or for nothing; repeats may collapse.  Viterbi search finds the likeliest letters under an
interpolated Kneser-Ney character model of the corpus.  The words of the restored text, and their
openings, are looked up in a lexicon of features that labelled toxic documents have far more often
than labelled clean ones, and a logistic curve makes a probability of what was found.

The character model counts all texts; the lexicon counts all labelled texts that may be learned from.
The curve is fitted on at most `sample` labelled rows, each judged by a lexicon of the other half of
the labelled rows.

Cases: null and empty texts have no features and get the curve's lowest score; without labelled rows
of both classes every score is the share of toxic labels.  Rows given twice are scored twice.  Extra
columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm import charlm
from scorewatch.llm.common import staged
from scorewatch.llm.compression import _logistic, training_marks

#: What a sign may stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
    "*": "aeiou", "#": "aeiou", "%": "aeiou", "?": "aeiou",
}
#: Costs in nats of a sign for a letter, of a sign as a break, of a dropped sign, of a dropped repeat.
SIGN, BREAK, DROP, REPEAT = 0.7, 4.0, 5.0, 0.3
BEAM, MEMO, LM_ORDER = 24, 200_000, 3
#: Log probabilities that a worker remembers.
LOGS = 1_000_000
OPENINGS = (4, 5, 6)
#: What may stand around a word without being part of it.
_AROUND = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$@") + "«»“”„’‘…"
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPLIT = re.compile(r"[^\w@$!|+*#%?]+|_")
_READY: dict[str, object] = {}


class Restorer:
    """Restored words of texts."""

    def __init__(self, scorer: charlm.Scorer):
        self.scorer, self.memo = scorer, {}
        self.logs: dict[int, float] = {}

    def _logs(self, keys: list[int]) -> list[float]:
        """Log probabilities of packed letters; the same few come again and again."""
        known = self.logs
        new = [k for k in keys if k not in known]
        if new:
            if len(known) + len(new) > LOGS:
                known.clear()
                new = keys
            found = self.scorer.log_probability(np.array(new, dtype=np.uint64), LM_ORDER)[:, 0]
            known.update(zip(new, found.tolist()))
        return [known[k] for k in keys]

    def decode(self, token: str) -> str:
        """The likeliest letters of one token; a break is a space."""
        found = self.memo.get(token)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            found = self.memo[token] = self._viterbi(token)
        return found

    def _viterbi(self, token: str) -> str:
        mask = (1 << (16 * (LM_ORDER - 1))) - 1
        beam: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # state: cost, letters as a linked list
        before = ""
        for c in token:
            arcs: list[tuple[str | None, float]]
            if c.isalpha():
                arcs = [(c, 0.0)] + ([(None, REPEAT)] if c == before else [])
            else:
                arcs = [(x, SIGN) for x in RESEMBLES.get(c, "")] + [(" ", BREAK), (None, REPEAT if c == before else DROP)]
            before = c
            heard = [(s, x, w) for s in beam for x, w in arcs if x is not None]
            keys = [(s << 16 | (0 if x == " " else ord(x) & 0xFFFF)) for s, x, _ in heard]
            logs = self._logs(keys)
            after: dict[int, tuple[float, tuple]] = {}
            for (s, x, w), key, log in zip(heard, keys, logs):
                cost, state = beam[s][0] + w - log, key & mask
                if state not in after or cost < after[state][0]:
                    after[state] = cost, (x, beam[s][1])
            for w in (w for x, w in arcs if x is None):
                for s, (cost, path) in beam.items():
                    if s not in after or cost + w < after[s][0]:
                        after[s] = cost + w, path
            beam = after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda e: e[1][0])[:BEAM])
        logs = self._logs([s << 16 for s in beam])
        path = min(zip(beam.values(), logs), key=lambda e: e[0][0] - e[1])[0][1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def words(self, text: str | None) -> set[str]:
        """The distinct words of the restored text."""
        found: set[str] = set()
        text = (text or "").lower()
        runs = _RUN.search(text) is not None
        single: list[str] = []
        for token in text.split():
            if token.isalpha() and len(token) > 1:
                word = token
            else:
                alone = token if len(token) == 1 else token.rstrip(".,;:")
                if len(alone) == 1 and (alone.isalpha() or alone in RESEMBLES):
                    single.append(alone)
                    if alone != token:  # a stop ends what is spelled out
                        self._spelled(single, found)
                        single = []
                    continue
                word = token.strip(_AROUND)
            if single:
                self._spelled(single, found)
                single = []
            if word.isalpha() and not (runs and _RUN.search(word)):
                found.add(word)
            elif word:
                self._odd(word, found)
        if single:
            self._spelled(single, found)
        found.discard("")
        return found

    def _spelled(self, letters: list[str], found: set[str]) -> None:
        if len(letters) >= 3:
            found.update(self.decode("".join(letters)).split())
        found.update(x for x in letters if x.isalpha())

    def _odd(self, token: str, found: set[str]) -> None:
        if not any(c.isalpha() for c in token):
            return
        parts = [p for p in _SPLIT.split(token) if p]
        if len(parts) >= 3 and max(map(len, parts)) == 1:  # s.c.u.m
            found.update(self.decode("".join(parts)).split())
            return
        for part in parts:
            if part.isalpha() and not _RUN.search(part):
                found.add(part)
            elif any(c.isalpha() for c in part):
                found.update(self.decode(part).split())
                found.update(x for x in re.split(r"[\W\d_]+", part) if len(x) > 1)


def features(words: set[str]) -> set[str]:
    """Words and their openings (`ab~`)."""
    out = set(words)
    for w in words:
        for k in OPENINGS:
            if len(w) > k:
                out.add(w[:k] + "~")
    return out


def heads(names: Iterable[str]) -> set[str]:
    """The first four letters of each feature: a word with another head has none of them."""
    return {n.rstrip("~")[: OPENINGS[0]] for n in names}


@dataclass
class Model:
    letters: charlm.Model
    name: str
    lexicon: dict[str, float]
    weights: list[float]
    base: float


def _restorer(letters: charlm.Model, name: str) -> Restorer:
    if name not in _READY:  # a worker serves many tasks
        _READY.clear()
        _READY[name] = Restorer(letters.ready())
    return _READY[name]


def _counted(docs: DataFrame, letters: charlm.Model, name: str, only: set[str] | None) -> DataFrame:
    """In how many documents of each half each feature is (of `only`, if given): `feature`, `n0`, `n1`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen = _restorer(letters, name), (Counter(), Counter())
        known = None if only is None else heads(only)

        def out(half: int) -> pa.RecordBatch:
            keys, counts = list(seen[half]), list(seen[half].values())
            seen[half].clear()
            columns = [pa.array(keys, pa.string()), pa.array([half] * len(keys), pa.int32()), pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["feature", "half", "n"])

        for batch in batches:
            for text, half in zip(batch.column("text"), batch.column("half").to_pylist()):
                words = restore.words(text.as_py())
                if known is None:
                    seen[half].update(features(words))
                else:
                    some = features({w for w in words if w[: OPENINGS[0]] in known})
                    seen[half].update([f for f in some if f in only])
                if len(seen[half]) > 1 << 20:
                    yield out(half)
        yield out(0)
        yield out(1)

    half = [F.coalesce(F.sum(F.when(F.col("half") == h, F.col("n"))), F.lit(0)).alias(f"n{h}") for h in (0, 1)]
    return docs.select("text", "half").mapInArrow(rows, "feature string, half int, n long").groupBy("feature").agg(*half)


def _lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, lift: float) -> dict[str, float]:
    """Log ratio of the shares of toxic and clean documents, less one and a half standard errors, where over log `lift`."""
    out = {}
    for f, n in toxic.items():
        a, b = n + 0.5, clean.get(f, 0) + 0.5
        weight = np.log(a / (n_toxic + 1)) - np.log(b / (n_clean + 1)) - 1.5 * np.sqrt(1 / a + 1 / b)
        if n and weight >= np.log(lift):
            out[f] = float(weight)
    return out


def _evidence(docs: DataFrame, letters: charlm.Model, name: str, lexicon: dict[str, float], key: str = "doc_id") -> DataFrame:
    """Per row: strongest weight, sum of the three strongest, log of the number of words with weight."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, known = _restorer(letters, name), heads(lexicon)
        for batch in batches:
            out = [[], [], []]
            for text in batch.column("text"):
                found = []
                for w in restore.words(text.as_py()):
                    if w[: OPENINGS[0]] not in known:
                        continue
                    best = max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "~", 0.0) for k in OPENINGS if len(w) > k)])
                    if best > 0:
                        found.append(best)
                found.sort(reverse=True)
                for column, x in zip(out, (found[0] if found else 0.0, sum(found[:3]), float(np.log1p(len(found))))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(pa.int64()), *(pa.array(x, pa.float64()) for x in out)], [key, "top", "three", "many"]
            )

    return docs.select(key, "text").mapInArrow(rows, f"{key} long, top double, three double, many double")


def fit(
    docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = 6000, support: float = 0.002, lift: float = 3.0
) -> Model:
    """The character model, the lexicon and the curve.

    A feature enters the lexicon if it is in at least `support` of the toxic documents, and surely in
    `lift` times as large a share of them as of the clean ones; so its size is bounded by the words of a
    document over `support`.  `held_out` is a condition on `doc_id`, so the texts that are held out are
    left out before the others meet their labels.
    """
    import uuid

    letters = charlm.fit(charlm.gram_counts(docs.withColumn("all", F.lit("all")), "all"))
    name = uuid.uuid4().hex
    marks = staged(training_marks(labels, "toxic", held_out), "marks")
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    known = sum(counts.values())
    base = counts.get(1, 0) / known if known else 0.5
    if len(counts) < 2:
        return Model(letters, name, {}, [], base)
    half = (F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2).cast("int").alias("half")
    marks = marks.select("doc_id", "mark", half)
    some = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out)
    # Labels grow with the texts: the same join at every size.
    texts = staged(some.join(marks.hint("merge"), "doc_id"), "labelled")
    size = {(r["mark"], r["half"]): r["count"] for r in texts.groupBy("mark", "half").count().collect()}
    n = [[size.get((v, h), 0) for h in (0, 1)] for v in (0, 1)]
    found = _counted(texts.where("mark = 1"), letters, name, None).where(F.col("n0") + F.col("n1") >= max(2.0, support * sum(n[1])))
    toxic = {r["feature"]: (r["n0"], r["n1"]) for r in found.collect()}
    clean = {r["feature"]: (r["n0"], r["n1"]) for r in _counted(texts.where("mark = 0"), letters, name, set(toxic)).collect()}
    lexicon = _lexicon(
        {f: sum(x) for f, x in toxic.items()}, {f: sum(x) for f, x in clean.items()}, sum(n[1]), sum(n[0]), lift
    )
    drawn = None
    for value in (0, 1):
        some = marks.where(F.col("mark") == value).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample // 2)
        drawn = some if drawn is None else drawn.unionAll(some)
    drawn = texts.join(F.broadcast(drawn), "doc_id", "left_semi")
    judged = None
    for h in (0, 1):
        other = _lexicon({f: x[1 - h] for f, x in toxic.items()}, {f: x[1 - h] for f, x in clean.items()}, n[1][1 - h], n[0][1 - h], lift)
        some = _evidence(drawn.where(F.col("half") == h), letters, name, other, "mark")
        judged = some if judged is None else judged.unionAll(some)
    rows = judged.toPandas()
    y = rows["mark"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(letters, name, lexicon, [], base)
    weights = _logistic(_inputs(rows["top"], rows["three"], rows["many"]), y)
    weights[0] += np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum()))
    return Model(letters, name, lexicon, weights.tolist(), base)


def _inputs(top, three, many) -> np.ndarray:
    return np.stack([np.ones(len(top)), np.asarray(top), np.asarray(three) / 3, np.asarray(many)], axis=1)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `score` (0 to 1, higher is more toxic) and the evidence of every row, from its whole text."""
    found = _evidence(docs, model.letters, model.name, model.lexicon)
    if not model.weights:
        return found.withColumn("score", F.lit(float(model.base)))
    one, top, three, many = model.weights
    z = F.lit(one) + top * F.col("top") + three * F.col("three") / 3 + many * F.col("many")
    return found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
