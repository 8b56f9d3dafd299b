"""Search, whitening and id files against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewatch.llm import idfiles, search, whitening
from scorewatch.llm.queries import QUERIES

from .conftest import ODD, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_ranks(docs, items, k=20):
    held = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    count, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 100 - 25 + (25 * c.total() * count) // length
            score = 0
            for t in TERM.findall((text or "").translate(UPPER)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, place, d, -s) for place, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def fast_ranks(spark, docs, items, k=20, **options):
    width = options.pop("width", 4096)
    queries = spark.createDataFrame(items, "item_id long, text string")
    found = search.ranked(search.index(docs, width), queries, "item_id", "text", k, **options)
    return sorted([tuple(r) for r in found.collect()], key=repr)


def prose(r, n, words=400):
    return " ".join(f"w{min(int(r.expovariate(0.02)), words)}" for _ in range(n))


@pytest.mark.parametrize("width,block,growth", [(4096, 256, 4), (16, 3, 2), (1, 256, 2)])
def test_search_equals_scoring_every_document(shared, width, block, growth):
    r = random.Random(3)
    texts = [prose(r, r.choice([1, 5, 60, 300])) for _ in range(160)]
    texts += [texts[5]] * 30 + ODD + ["Word, WORD word-word x1 ÉTÉ été", "9 9 9"]
    items = [(k, prose(r, 12)) for k in range(6)] + [(6, texts[5]), (7, "word ÉTÉ"), (8, None), (9, "?!"), (0, "unheard of"), (None, "w1 w1 w2")]
    docs = frame(shared, texts, term=["x"] * len(texts), n=list(range(len(texts))))
    got = fast_ranks(shared, docs, items, block=block, growth=growth, width=width)
    assert got == slow_ranks(list(enumerate(texts)), items)


def test_search_odd_tables(shared):
    docs = shared.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "b"), (3, None)], "doc_id long, text string")
    items = [(1, "a"), (1, "a"), (2, "b")]
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "b"), (3, None)]
    assert fast_ranks(shared, docs, items, k=2) == slow_ranks(rows, items, k=2)
    assert fast_ranks(shared, docs, items) == slow_ranks(rows, items)
    assert fast_ranks(shared, docs.where("false"), items) == []
    assert fast_ranks(shared, docs, []) == []


def test_bounds_are_upper_bounds_and_exact_without_collisions(shared):
    r = random.Random(4)
    texts = [prose(r, 50, 60) for _ in range(40)]
    items = [(k, prose(r, 8, 60)) for k in range(4)]
    for width in (7, 1 << 16):
        found = search.index(frame(shared, texts), width)
        asked = search._block(found, [k for k, _ in items], [t.encode() for _, t in items])
        batch = found.sketches.orderBy("doc_id").toArrow().to_batches()[0]
        bounds = np.vstack([b for _, b in search._bounds(batch, asked.column, asked.matrix, found.documents, found.length)])
        scores = np.zeros_like(bounds)
        for item, _, d, s in slow_ranks(list(enumerate(texts)), items, k=40):
            scores[d, item] = s
        assert (bounds >= scores).all()
        assert width == 7 or (bounds == scores).all()


def vectors(shared, rows, **columns):
    return shared.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for k, v in rows], "vec_id long, embedding array<float>, n int, component string")


def slow_white(rows, count):
    rows = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([[np.float32(c) for c in v] for _, v in rows], dtype=float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    covariance = (exact / n).T @ (exact / n) / n
    values, turn = np.linalg.eigh(covariance)
    values, turn = values[::-1], turn[:, ::-1]
    keep = np.flatnonzero(values[:count] > 1e-12 * values[0])
    return [k for k, _ in rows], n, (exact**2).sum(axis=1), exact / n @ turn[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


@pytest.mark.parametrize("dims,rank,count", [(8, 8, 4), (40, 40, 6), (50, 50, 32), (64, 5, 32)])
def test_whitening_equals_eigenvectors_of_the_covariance(shared, dims, rank, count):
    rng = np.random.default_rng(dims)
    data = rng.standard_normal((300, rank)) * np.linspace(3, 1, rank) @ rng.standard_normal((rank, dims))
    if rank < dims:  # whole multiples of 1/64 keep the rank
        data = np.round(rng.integers(-300, 300, (300, rank)) @ rng.integers(-3, 4, (rank, dims))) / 64
    rows = [(k, v.tolist()) for k, v in enumerate(data)]
    rows += [(900, None), (901, [None] * dims), (902, [math.nan] * dims), (903, [1.0] * (dims - 1) + [math.inf]), (0, rows[0][1])]
    got = whitening.whitened(vectors(shared, rows), count).toPandas()
    ids, n, deviation, white, shares = slow_white(rows, count)
    assert len(got) == len(ids) * white.shape[1] and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() <= 1e-9
    table = {(r.vec_id, r.component): r for r in got.itertuples()}
    signs = np.sign([table[ids[1], j + 1].whitened * white[1, j] for j in range(white.shape[1])])
    for i, k in enumerate(ids):
        for j in range(white.shape[1]):
            r = table[k, j + 1]
            assert r.deviation == deviation[i]
            assert abs(r.whitened * signs[j] - white[i, j]) < 1e-7
            assert abs(r.explained / shares[j] - 1) < 1e-9


def test_whitening_odd_tables(shared):
    assert whitening.whitened(vectors(shared, [(1, None)])).count() == 0
    assert whitening.whitened(vectors(shared, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    with pytest.raises(ValueError):
        whitening.whitened(vectors(shared, [(1, [1.0, 2.0]), (2, [1.0])]))


@pytest.mark.parametrize("kind", ["repeats", "random", "runs", "words", "short"])
def test_compression_round_trip(kind):
    rng = np.random.default_rng(1)
    ids = {
        "repeats": np.tile(rng.integers(0, 500, 37), 200),
        "random": rng.integers(0, 50_000, 20_000),
        "runs": np.repeat(rng.integers(0, 5, 300), rng.integers(1, 60, 300)),
        "words": np.concatenate([np.tile(w, 1) for w in [rng.integers(0, 900, 6) for _ in range(40)] * 100]),
        "short": np.array([7]),
    }[kind].astype(np.uint32)
    symbols, rules, lengths = idfiles.compress(ids, 50_257)
    shard = idfiles.Shard.read(idfiles.Shard(50_257, np.array([3]), np.array([len(ids)]), rules, lengths, symbols).data())
    assert (shard.ids() == ids).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (shard.ids(a, b) == ids[a:b]).all()
    if kind in ("repeats", "words"):
        assert len(symbols) + 2 * len(rules) < len(ids) / 3


def test_frequent_pairs_become_rules():
    symbols, rules, lengths = idfiles.compress(np.array([1, 2, 3] * 8 + [9]), 100)
    expanded = {}
    for k, (a, b) in enumerate(rules.tolist()):
        expanded[100 + k] = expanded.get(a, [a]) + expanded.get(b, [b])
        assert len(expanded[100 + k]) == lengths[k]
    assert [x for s in symbols.tolist() for x in expanded.get(s, [s])] == [1, 2, 3] * 8 + [9]
    assert [1, 2, 3] in [v for v in expanded.values()] or any([1, 2, 3] == v[i : i + 3] for v in expanded.values() for i in range(len(v)))


def whole_files(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(idfiles.vocabulary_path("byte_bpe_50k.json"))
    out, at = [], 0
    for d, t in docs:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


SPACED = [
    "a  b", " lead", "trail ", "two\n\nlines \n x", "tab\tand nbsp\xa0x \xa0y", "don't we'll I'M", "x <|endoftext|> y",
    "line\x1csep \x1c z", "a b  c", "ünïcode wörds 中文 text", "1 2 34 5a a5", "...  !? --", "​ zero", "a\x85b c",
]


@pytest.mark.parametrize("shard_ids", [1 << 20, 50])
def test_id_files(shared, tmp_path, shard_ids):
    texts = ODD + SPACED + SPACED
    docs = frame(shared, texts, part=list(range(len(texts))), data=["x"] * len(texts)).orderBy(F.desc("doc_id"))
    path = str(tmp_path / "ids")
    idfiles.written(docs.repartition(3), path, "byte_bpe_50k.json", shard_ids=shard_ids)
    want = whole_files(list(enumerate(texts)))
    got = sorted([tuple(r) for r in idfiles.read(shared, path).collect()])
    assert got == want
    flat = [x for w in want for x in w[4]]
    asked = [(0, 5), (want[7][1] + 3, want[9][1] + 2), (len(flat) - 1, len(flat)), (0, len(flat))]
    found = {(r["first"], r["after"]): r["ids"] for r in idfiles.ranges(shared, path, asked).collect()}
    assert found == {(a, b): flat[a:b] for a, b in asked}


def test_id_files_odd_tables(shared, tmp_path):
    rows = [(2, "b"), (None, "z"), (2, "b"), (1, None), (2, "other")]
    idfiles.written(shared.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), "byte_bpe_50k.json")
    got = idfiles.read(shared, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 2]
    assert [r["start"] for r in got] == [0, 2, 3] + [got[2]["start"] + s for s in np.cumsum([got[2]["n_tokens"], got[3]["n_tokens"]]).tolist()]
    assert got[1]["ids"] == [0]
    idfiles.written(shared.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), "byte_bpe_50k.json")
    assert idfiles.read(shared, str(tmp_path / "b")).count() == 0


def test_whole_tables(shared, given):
    docs = [(r["doc_id"], r["text"]) for r in shared.read.parquet(f"{given}/documents.parquet").orderBy("doc_id").collect()]
    items = [tuple(r) for r in shared.read.parquet(f"{given}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op11_search"](shared, given).collect()], key=repr) == slow_ranks(docs, items)
    got = QUERIES["op13_idfiles"](shared, given).collect()
    assert sorted(tuple(r) for r in got) == [w[:4] for w in whole_files(docs)]


def test_byte_words_straight_to_the_merges():
    """Words of letters never pass the splitter, and a part that is a known word is not cut again."""
    from scorewatch.llm.words import ByteEncoder, strings

    encode = ByteEncoder(idfiles.vocabulary_path("byte_bpe_50k.json"))
    whole, asked, cut = encode.tokenizer, [], []

    class Recorder:
        model = whole.model

        def encode_batch(self, texts, **options):
            asked.extend(texts)
            return whole.encode_batch(texts, **options)

    encode.tokenizer = Recorder()
    own = encode._cut
    encode._cut = lambda parts: cut.extend(strings(parts)) or own(parts)
    texts = ["Élan vital, ñandú straße", "straße vital Élan", "vital, (straße)"]
    for _ in range(2):
        want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert encode.batch(pa.array(texts)) == want
    assert all(not any(c.isalpha() for c in t) for t in asked)
    assert set(cut) == {" vital,", "vital,", " (straße)"}
