"""SimHash, packing, rules, chunks, pieces and suffixes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scorewatch.llm import chunks, packing, pieces, rules, simhash, suffix
from scorewatch.llm.common import connected
from scorewatch.llm.queries import QUERIES

from .conftest import ODD, frame

WORDS = "the quick brown fox jumps over lazy dog and runs far away from every hill in town by night".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))


def groups_of(nodes, edges):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_connected(shared):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)]
    found = {x["node"]: x["root"] for x in connected(shared.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert found == groups_of({x for e in edges for x in e}, edges)
    assert connected(shared.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def slow_print(text, words):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not tokens:
        return 0
    parts = [b" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, docs, words, distance):
    prints = {d: slow_print(t, words) for d, t in docs}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= distance]
    want = groups_of(ids, near)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {
        d: (f"{prints[d]:016x}", want[d]) for d in ids
    }


def test_simhash_query_on_all_documents(shared, given):
    docs = [(r["doc_id"], r["text"]) for r in shared.read.parquet(f"{given}/documents.parquet").collect()]
    check_simhash(QUERIES["op6_simhash"](shared, given).collect(), docs, 4, 4)


def test_simhash_odd_texts_and_near_copies(shared):
    base = prose(1, 300)
    texts = ODD + [base, base, base + " end", base.replace("fox", "cat"), base.upper(), prose(2, 300), "b", "c d"]
    docs = frame(shared, texts, fp=list(range(len(texts))), component_id=["x"] * len(texts))
    rows = simhash.near_copies(docs, 4, 4).withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    check_simhash(rows.collect(), list(enumerate(texts)), 4, 4)
    assert simhash.near_copies(docs.limit(0)).count() == 0
    twice = docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))
    assert simhash.near_copies(twice).count() == 2 * len(texts)
    unnamed = shared.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(unnamed).collect()} == {(None, 3), (3, 3)}


@pytest.mark.parametrize("distance", [1, 4, 7])
def test_all_links_of_random_fingerprints(shared, distance):
    r = random.Random(distance)
    prints = {r.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for flips in range(1, distance + 3):
            prints.add(p ^ sum(1 << b for b in r.sample(range(64), flips)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = [(x["a"], x["b"]) for x in simhash.links(shared.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
    assert set(found) == want
    assert len(found) == len(want)


def test_links_broadcast_no_exploded_side(shared):
    """Spark takes an exploded side for as small as its source, here 8 KB; the sides have to be dealt out."""
    found = simhash.links(shared.range(1000).selectExpr("id * 1234567891011 fp"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_survivors_of_rounds(shared):
    base = prose(3, 400).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 100)]
    texts = [" ".join(base), *near, prose(4, 400), None, "", "one", "one"]
    left = {r["doc_id"] for r in simhash.survivors(frame(shared, texts)).collect()}
    assert left == {0, 5, 6, 8}


def near_pairs(texts):
    """Pairs of texts with a Jaccard similarity of 0.8 at least, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    return [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def changed(text, seed, places):
    r, words = random.Random(seed), text.split()
    for k in r.sample(range(len(words)), places):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


def test_survivors_recall_of_loose_near_copies(shared):
    texts = []
    for k in range(250):
        base = prose(1000 + k, 300)
        texts += [base, changed(base, k, 5 + k % 3)]  # about 0.8 to 0.85 of the shingles are shared
    near = near_pairs(texts)
    assert len(near) > 150
    left = {r["doc_id"] for r in simhash.survivors(frame(shared, texts)).collect()}
    assert sum(b not in left for _, b in near) >= 0.98 * len(near)


def test_survivors_miss_no_pair(shared):
    """All pairs at 0.8, of short texts too, whose fingerprints differ more often in all bands."""
    texts = []
    for k in range(400):  # five shingles, and four of them
        base = [f"w{k}x{j}" for j in range(9)]
        texts += [" ".join(base), " ".join(base[k % 2 :][:8])]
    for k in range(160):  # a text and the four fifths of its shingles it begins with
        base = [f"v{k}x{j}" for j in range(5 * (1 + k % 60) + 4)]
        texts += [" ".join(base), " ".join(base[: 4 * (1 + k % 60) + 4])]
    near = near_pairs_of_neighbours(texts)
    assert len(near) == 560
    twice = frame(shared, texts).unionAll(frame(shared, texts).where("doc_id % 7 = 0"))
    left = {r["doc_id"] for r in simhash.survivors(twice).collect()}
    assert left == set(groups_of(range(len(texts)), near).values())


def near_pairs_of_neighbours(texts):
    return [(k, k + 1) for k in range(0, len(texts), 2) if near_pairs(texts[k : k + 2])]


def test_survivors_unite_links_and_take_only_verified_ones(shared):
    texts = []
    for k in range(30):  # chains: the ends share less than 0.8, the middle 0.8 and more with both
        middle = prose(2000 + k, 300)
        texts += [changed(middle, 2 * k, 3), changed(middle, 2 * k + 1, 3), middle]
    for k in range(60):  # templated texts under 0.8
        base = prose(3000 + k, 300)
        texts += [base, changed(base, k, 8)]
    hot = prose(4000, 300)
    texts += [changed(hot, k, 2) for k in range(60)]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    texts = [texts[k] for k in order]
    want = groups_of(range(len(texts)), near_pairs(texts))
    left = {r["doc_id"] for r in simhash.survivors(frame(shared, texts)).collect()}
    assert left == set(want.values())


def test_survivors_of_a_large_group_of_loose_copies(shared, monkeypatch):
    """Pairs that meet in a band but are no near copies are told apart before their texts are read."""
    base = prose(5000, 160)
    texts = [changed(base, k, 3 + k % 2) for k in range(150)]
    near = near_pairs(texts)
    verified, seen = simhash._verified, []

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "_verified", counted)
    left = {r["doc_id"] for r in simhash.survivors(frame(shared, texts)).collect()}
    assert left == set(groups_of(range(len(texts)), near).values())
    assert len(near) < 150 and sum(seen) <= len(near) + 150


def test_parity_never_excludes_near_copies():
    r = np.random.default_rng(1)
    for n in (1, 4, 5, 9, 50, 400, 5000):
        for _ in range(50):
            kinds = np.unique(r.integers(0, 2**64, 2 * n, dtype=np.uint64))
            cut = len(kinds) // 5  # four fifths and, where it divides, not one more are shared
            one, other = kinds[: len(kinds) - cut // 2], kinds[cut - cut // 2 :]
            shared = len(np.intersect1d(one, other))
            assert 5 * shared >= 4 * len(kinds)
            a, b = (np.array(simhash.parity_of(x), dtype="<i8").view("<u8") for x in (one, other))
            assert 9 * int(np.bitwise_count(a ^ b).sum()) <= len(one) + len(other)


def test_packing(shared, given):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in shared.read.parquet(f"{given}/documents.parquet").collect()}
    rows = QUERIES["op4_packing"](shared, given).collect()
    check_packing(rows, docs, tokenizer)
    odd = ODD + ["<|endoftext|> x", "It's we'll ²½ ªº µ ß É", "á İ Σς", "\x1c\x85\xa0x", "'s''t 'll!!'d"]
    placed = packing.place(packing.pieces(frame(shared, odd, offset=odd), "word_bpe_49k.json"))
    check_packing(placed.collect(), dict(enumerate(odd)), tokenizer)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    assert sum(map(len, whole.values())) == sum(r["length"] for r in placed.collect())
    assert packing.place(packing.pieces(frame(shared, odd).limit(0), "word_bpe_49k.json")).count() == 0


def check_packing(rows, docs, tokenizer):
    bins, seen = defaultdict(list), Counter()
    for r in rows:
        ids = tokenizer.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and len(part) == r["length"] == min(2048, len(ids) - r["start"])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
        assert seen[r["doc_id"]] <= len(ids)
    assert set(seen) == set(docs)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(seen.values()) // 2048) + 2


def test_packing_rounds_lose_nothing_and_help(shared):
    r = np.random.default_rng(3)
    lengths = r.integers(200, 1500, 4000).tolist()
    rows = shared.createDataFrame([(k, 0, 0, int(n)) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    one = packing.place(rows, per_partition=10_000)
    many = packing.place(rows, per_partition=300, opened=0.25)
    used = many.select("sequence_id").distinct().count()
    assert sorted(x["doc_id"] for x in many.collect()) == list(range(4000))
    assert many.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m")).where("n > 2048 or n != m").count() == 0
    assert used <= 1.03 * one.select("sequence_id").distinct().count()
    assert one.where("bins < bound").count() == 0


def fewest_bins(lengths, size):
    """The least number of bins, by trying every bin for every piece, longest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            put(k + 1, [r - lengths[k] * (i == j) for j, r in enumerate(rooms)])
        put(k + 1, [*rooms, size - lengths[k]])

    put(0, [])
    return best[0]


def test_small_packings_meet_the_least_number_of_bins(shared):
    r = random.Random(8)
    missed = 0
    for _ in range(40):
        lengths = [r.randrange(1, 21) for _ in range(r.randrange(1, 11))]
        bound, least = packing.lower_bound(np.array(lengths), 20), fewest_bins(lengths, 20)
        used = packing.best_fit(np.array(lengths), 20)[2]
        assert bound <= least <= used
        missed += used > least
    assert missed <= 2
    lengths = [r.randrange(3, 18) for _ in range(12)]
    rows = shared.createDataFrame([(k, 0, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    placed = packing.place(rows, size=20, per_partition=3).collect()
    assert len({x["sequence_id"] for x in placed}) <= fewest_bins(lengths, 20) + 1


def test_partitions_with_a_gap_exchange_documents(shared, monkeypatch):
    # Pieces of 600 and of 1448 fill a sequence together; partitions of few pieces rarely hold as many of both.
    lengths = [600] * 300 + [1448] * 300
    rows = shared.createDataFrame([(k, 0, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    rounds = []
    packed = packing._packed
    monkeypatch.setattr(packing, "_packed", lambda *a: rounds.append(a[2]) or packed(*a))
    placed = packing.place(rows, per_partition=40).collect()
    used = len({x["sequence_id"] for x in placed})
    first = shared.createDataFrame([(k, 0, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long")
    alone = packed(first, 2048, 15, 0).select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
    assert len(placed) == 600 and len(rounds) > 1 and 300 <= used < alone
    for x in placed:
        assert x["bins"] >= x["bound"]
    # What is certified at once is not packed again.
    rounds.clear()
    packing.place(rows.where("length = 600"), per_partition=30).count()
    assert len(rounds) <= 4


def test_lower_bounds():
    assert packing.lower_bound(np.array([], dtype=int), 10) == 0
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([5, 5, 5, 5]), 10) == 2
    r = random.Random(2)
    for _ in range(200):
        lengths = np.array([r.randint(1, 20) for _ in range(r.randint(1, 25))])
        bins, offsets, count = packing.best_fit(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= count
        assert max(np.bincount(bins, weights=lengths)) <= 20


def slow_rules(text):
    text = text or ""
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(blank)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    n, m = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), m, n < 50 or 100 * m > 50 * n)


def test_rule_statistics(shared, given):
    docs = {r["doc_id"]: r["text"] for r in shared.read.parquet(f"{given}/documents.parquet").collect()}
    rows = QUERIES["op7_rules"](shared, given).collect()
    assert {r["doc_id"]: tuple(r[c] for c in (*rules.BASE, "base_failed")) for r in rows} == {d: slow_rules(t) for d, t in docs.items()}
    assert all(not r["kept"] for r in rows if r["base_failed"])
    texts = ODD + ["a b c a b c x", "a b a b a", "l\nl \nl\n\n\nl\r\n|#", "a b c " * 40, prose(1, 60)]
    rows = rules.statistics(frame(shared, texts, n_words=["x"] * len(texts), w=texts)).withColumn("base_failed", rules.base_failed()).collect()
    assert {r["doc_id"]: tuple(r[c] for c in (*rules.BASE, "base_failed")) for r in rows} == {k: slow_rules(t) for k, t in enumerate(texts)}


def test_rules_are_learned_and_native(shared):
    texts = [prose(k, 80) + (" ## $$" * 30 if k % 4 == 0 else "") for k in range(240)]
    docs = frame(shared, texts)
    labels = shared.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(200)] + [(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = rules.judged(docs, labels)
    assert {r["doc_id"]: r["kept"] for r in found.collect()} == {k: k % 4 != 0 for k in range(240)}
    plan = rules.statistics(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert rules.learn(rules.statistics(docs), labels.limit(0)) == []
    assert rules.judged(docs.limit(0), labels).count() == 0


def slow_cuts(data, average, apart=8, most=4096):
    h, small, cuts = 0, [], []
    for k, b in enumerate(data):
        h = ((h << 1) + int(chunks.GEAR[b])) & 0xFFFF
        small.append(k >= 15 and h < 65536 // average)
        end = k + 1
        if small[k] and not any(small[max(0, k - apart) : k]) and end < len(data) and data[end] & 0xC0 != 0x80:
            cuts.append(end)
    out, last = [], 0
    for c in [*cuts, len(data)]:
        while c - last > most:
            stop = last + most
            if stop >= c:
                break
            out.append(stop)
            last = stop
        if c > last:
            out.append(c)
        last = c
    return out


def test_chunk_boundaries():
    for seed in range(20):
        data = prose(seed, 400).encode() if seed % 2 else random.Random(seed).randbytes(3000).decode("latin-1").encode()
        assert chunks.boundaries(data, 32).tolist() == slow_cuts(data, 32)
    assert chunks.boundaries(b"", 32).tolist() == []
    assert chunks.boundaries(b"a", 32).tolist() == [1]
    assert chunks.boundaries(b"a" * 10_000, 32).tolist() == slow_cuts(b"a" * 10_000, 32)
    long = prose(7, 400_000).encode()
    assert chunks.boundaries(long, 32).tolist() == slow_cuts(long, 32)


def slow_chunks(docs, average, least):
    lists, places = {}, defaultdict(list)
    for d, t in docs:
        data, last, mine = (t or "").encode(), 0, []
        for end in slow_cuts(data, average):
            mine.append((last, end, data[last:end]))
            places[data[last:end]].append((d, last))
            last = end
        lists[d] = data, mine
    out = {}
    for d, (data, mine) in lists.items():
        gone, run = [], []
        for a, b, part in [*mine, (None, None, None)]:
            if part is not None and min(places[part]) != (d, a):
                run.append((a, b))
                continue
            if run and run[-1][1] - run[0][0] >= least:
                gone.append((run[0][0], run[-1][1]))
            run = []
        edges = [0, *(x for s in gone for x in s), len(data)]
        out[d] = (sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))).hexdigest())
    return out


def test_chunks_query_on_all_documents(shared, given):
    docs = [(r["doc_id"], r["text"]) for r in shared.read.parquet(f"{given}/documents.parquet").collect()]
    rows = QUERIES["op5_chunks"](shared, given).collect()
    assert {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == slow_chunks(docs, 32, 80)


def test_chunks_resist_shifts_and_odd_texts(shared):
    passage = prose(50, 60)
    texts = ODD + [prose(51, 100) + "\n" + passage + "\n" + prose(52, 90), "x " + prose(53, 70) + " " + passage + prose(54, 80), prose(55, 100)]
    docs = frame(shared, texts, start=texts, found=texts)
    rows = {r["doc_id"]: r for r in chunks.deduplicated(docs, keep=("source",)).collect()}
    assert {d: (r["n_removed"], r["n_spans"]) for d, r in rows.items()} == {d: x[:2] for d, x in slow_chunks(list(enumerate(texts)), 32, 80).items()}
    first, second, clean = len(ODD), len(ODD) + 1, len(ODD) + 2
    assert rows[first]["n_removed"] == 0 < 0.6 * len(passage) < rows[first]["n_repeated"]
    assert rows[second]["n_removed"] > 0.6 * len(passage)
    assert rows[clean]["n_removed"] == rows[clean]["n_repeated"] == 0
    assert rows[0]["kept"] is None and rows[1]["kept"] == ""
    assert chunks.deduplicated(docs.limit(0)).count() == 0
    assert chunks.deduplicated(docs.select("doc_id", "text").unionAll(docs.select("doc_id", "text"))).count() == 2 * len(texts)


def test_chunks_of_texts_that_share_an_id(shared):
    r = random.Random(64)
    passage, own = prose(60, 60), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(150))
    texts = [(7, prose(61, 80) + passage), (7, own + prose(62, 50)), (7, passage + prose(63, 60)), (8, own + "z"), (7, passage + prose(63, 60))]
    docs = shared.createDataFrame(texts, "doc_id long, text string")
    rows = chunks.deduplicated(docs, keep=("text",)).collect()
    kept = defaultdict(list)
    for r in rows:
        rest = iter(r["more"]["text"])
        assert all(c in rest for c in r["kept"])  # nothing of another text
        kept[r["more"]["text"]].append((r["n_removed"], r["kept"]))
    assert len(rows) == 5 and len(kept[texts[2][1]]) == 2 and len(set(kept[texts[2][1]])) == 1
    # One of the two texts with the passage keeps it; the text of id 8 loses what one of id 7 has.
    lost = sorted([kept[texts[0][1]][0][0], kept[texts[2][1]][0][0]])
    assert lost[0] == 0 and lost[1] > 0.6 * len(passage)
    assert kept[texts[1][1]][0] == (0, texts[1][1])
    assert kept[texts[3][1]][0][0] >= 80


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(shared, given, codec):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [r["text"] for r in shared.read.parquet(f"{given}/documents.parquet").collect()]
    r = random.Random(4)
    signs = ["  ", " ", "a", "the", "ing", "é", "😀", "\n", "\t", "x" * 33, "1", ".", "\x00", "中文", " " * 19, "▁"]
    texts = [*docs, *(x for x in ODD if x), *("".join(r.choices(signs, k=r.randint(1, 12))) for _ in range(500)), "".join(docs[0].split()) * 20]
    for text in texts:
        ids = codec.encode(text).tolist()
        assert ids == library.encode(text)
        assert codec.decode(ids) == text.replace("▁", " ")
    rows = QUERIES["op9_sentencepiece"](shared, given).collect()
    want = {r["doc_id"]: zlib.crc32(np.array(library.encode(r["text"]), dtype="<i4").tobytes()) for r in shared.read.parquet(f"{given}/documents.parquet").collect()}
    assert {r["doc_id"]: r["ids_crc32"] for r in rows} == want
    assert all(r["round_trip"] for r in rows)


def test_pieces_odd_rows(shared):
    docs = frame(shared, ODD, ids=ODD, n_ids=ODD)
    ids = pieces.encoded(docs, "piece_bpe_32k.model")
    assert all(r["round_trip"] for r in ids.collect())
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(ids, "piece_bpe_32k.model").collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert pieces.encoded(docs.limit(0), "piece_bpe_32k.model").count() == 0


def test_streaming_holds_a_bounded_window(codec):
    search, text = pieces.Viterbi(codec.v), "".join(prose(9, 20_000).split())
    out = [p for p, _ in search.feed(text)] + [p for p, _ in search.end()]
    assert "".join(out) == text and search.widest < 10 * codec.v.longest


def test_words_of_known_signs_are_not_decoded(codec, monkeypatch):
    """Pieces that make up a word decode to it, so only words with byte pieces are decoded."""
    words = [pieces.MARK + w for w in set(prose(12, 3000).split())]
    wanted = [codec._part(w) for w in words]

    def fail(ids):
        raise AssertionError("a word was decoded")

    fresh = pieces.Codec.__new__(pieces.Codec)
    fresh.v, fresh.memo, fresh.older = codec.v, {}, {}
    monkeypatch.setattr(fresh, "raw_text", fail)
    assert [fresh.known(w) for w in words] == [(ids, True) for ids in wanted]
    assert pieces.ending_lengths(["ab", "cab", "xcab", "b"], 3) == {"cab": (4, 3, 2, 1)}


def test_ids_of_known_signs_are_decoded_too():
    """`round_trip` is found by decoding the ids, also of words that are searched in one go."""
    import public_tokenizers

    own = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.raw_text([own.v.ids["▁town"]]) == " town"
    own.v.texts[own.v.ids["▁town"]] = "▁tower"  # what decoding gives is no longer what was encoded
    own.v.__dict__.pop("raw", None)
    own.__dict__.pop("raw", None)
    ids, same = own.checked("every town by night")
    assert own.decode(ids.tolist()) == "every tower by night" and not same
    found = own.batch(pa.array(["every town by night", "every hill by night"]))
    assert [x[1] for x in found] == [False, True]


def test_unigram_vocabulary_keeps_the_best_sum(codec):
    v = object.__new__(pieces.Vocabulary)
    v.merges, v.texts, v.scores = False, ["a", "b", "ab", "ba", "aba"], [-1.0, -1.0, -1.5, -1.2, -3.0]
    v.ids, v.longest, v.allowed = {t: k for k, t in enumerate(v.texts)}, 3, {}
    v.lengths = pieces.ending_lengths(v.ids)
    r = random.Random(1)
    for _ in range(100):
        text = "".join(r.choices("ab", k=r.randint(1, 60)))
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[end - n] + v.scores[v.ids[text[end - n : end]]] for n in (1, 2, 3) if n <= end and text[end - n : end] in v.ids))
        search = pieces.Viterbi(v)
        out = [*search.feed(text), *search.end()]
        assert "".join(p for p, _ in out) == text
        assert abs(sum(v.scores[k] for _, k in out) - best[-1]) < 1e-9


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for _ in range(150):
        t = np.append(r.integers(1, int(r.integers(2, 5)), int(r.integers(1, 60))), 0).astype(np.int16)
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda k: t[k:].tolist())
        prefix = suffix.common_prefixes(t, sa)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
            m = 0
            while max(a, b) + m < len(t) and t[a + m] == t[b + m]:
                m += 1
            assert prefix[b] == m


def slow_suffix(docs, length):
    data = [(t or "").encode() for _, t in docs]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(docs, data):
        gone = np.zeros(len(d) + 1, dtype=int)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, dtype=np.uint8)[~gone])))
    return sorted(out, key=str)


def test_suffix_query_on_all_documents(shared, given):
    docs = [(r["doc_id"], r["text"]) for r in shared.read.parquet(f"{given}/documents.parquet").collect()]
    rows = QUERIES["op10_suffix"](shared, given).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows), key=str)
    assert got == [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in slow_suffix(docs, 400)]


@pytest.mark.parametrize("kinds", [2000, 3])
def test_suffix_odd_texts_and_hot_grams(shared, kinds):
    passage = prose(60, 12)[:70]
    texts = ODD + [prose(k, 12) + passage[k % 20 :] + prose(100 + k, 10) for k in range(40)] + [passage, passage, prose(1, 30), prose(1, 30), "ab" * 100]
    docs = frame(shared, texts, data=texts, uid=texts)
    rows = suffix.without_repeats(docs, 40, grams=(16, 28, 36), kinds=kinds, shard_bytes=3000).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], sum(s["after"] - s["first"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in rows), key=str)
    assert got == slow_suffix(list(enumerate(texts)), 40)
    assert suffix.without_repeats(docs.limit(0), 40).count() == 0
    twice = docs.where("doc_id = 52").select("doc_id", "text")
    assert [len(r["kept"]) for r in suffix.without_repeats(twice.unionAll(twice), 40).collect()] == [0, 0]


def test_strings_of_arrays():
    """Texts of an array, slices included, as Python strings."""
    import pyarrow as pa

    from scorewatch.llm.words import strings

    texts = ["", "é", "a b", "\x00", "中"]
    assert strings(pa.array(texts)) == texts
    assert strings(pa.array(texts).slice(1, 3)) == texts[1:4]
    assert strings(pa.array([], pa.string())) == []
