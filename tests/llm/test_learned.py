"""Embeddings against brute force; language, quality and toxicity by what is held out; the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorewatch.llm import charlm, compression, embeddings, langid, toxicity
from scorewatch.llm.queries import QUERIES, held_out

from .conftest import DOC, ODD, frame
from .test_exact import groups_of, prose


def slow_vectors(rows, cosine):
    links, edges = Counter(), []
    good = [
        (k, np.array(e, dtype=float), label)
        for k, e, label in rows
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)
    ]
    for n, (a, u, x) in enumerate(good):
        for b, v, y in good[n + 1 :]:
            if x == y and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= cosine:
                links[a] += 1
                links[b] += 1
                edges.append((a, b))
    root = groups_of([r[0] for r in rows], edges)
    return {k: (links[k], root[k], root[k] == k) for k, _, _ in rows}


def got(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_embeddings_query_on_all_vectors(shared, given):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in shared.read.parquet(f"{given}/embeddings.parquet").collect()]
    assert got(QUERIES["op1_embeddings"](shared, given)) == slow_vectors(rows, 0.93)


def test_embeddings_groups_blocks_and_odd_rows(shared):
    r = np.random.default_rng(4)
    rows, key = [], 0
    for label in (1, 1, 2, 2, 2):
        centre = r.standard_normal(24)
        for _ in range(60):
            rows.append((key, (centre + r.uniform(0.1, 0.5) * r.standard_normal(24)).astype("float32").tolist(), label))
            key += 1
    rows += [(key + k, list(rows[5][1]), 1) for k in range(5)]
    key += 5
    odd = [None, [], [0.0] * 24, [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] * 24, [1e-30] * 24, [1.0] * 24]
    rows += [(key + k, e, 1) for k, e in enumerate(odd)] + [(key + 20, rows[5][1], None)]
    df = shared.createDataFrame([(*x, 7, 7) for x in rows], "vec_id long, embedding array<float>, label int, n_links int, uid int")
    want = slow_vectors(rows, 0.93)
    assert sum(x[0] for x in want.values()) > 1000
    assert got(embeddings.near_vectors(df)) == want
    assert got(embeddings.near_vectors(df, block=32)) == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_collisions_reach_the_recall():
    width, least = embeddings.collision_rule(0.93, 64, 0.999)
    r = np.random.default_rng(0)
    u = embeddings.unit(r.standard_normal((4000, 32)))
    w = embeddings.unit(r.standard_normal((4000, 32)))
    w = embeddings.unit(w - (u * w).sum(axis=1, keepdims=True) * u)
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * w
    axes = r.standard_normal((32, 64))
    assert ((np.abs(u @ axes - v @ axes) <= width).sum(axis=1) >= least).mean() > 0.996


def slow_kneser_ney(counts, text, order, discount):
    """Sum of natural logs over the symbols of `text`, from counted grams (tuples)."""
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    vocabulary = max(2, len(levels[1]) + 1)

    def p(gram):
        if not gram:
            return 1 / vocabulary
        level = levels[len(gram)]
        follow = {g: c for g, c in level.items() if g[:-1] == gram[:-1]}
        below = p(gram[1:])
        if not follow:
            return below
        return max(level[gram] - discount, 0) / sum(follow.values()) + discount * len(follow) / sum(follow.values()) * below

    seen = [tuple(int(x) >> (16 * k) & 0xFFFF for k in range(order - 1, -1, -1)) for x in charlm.grams(charlm.symbols(text))]
    return sum(math.log(p(g)) for g in seen)


def test_kneser_ney_against_its_formula(shared):
    texts = ["banana bandana", "Banana? band!", "ananas and nab", None, "", "12"]
    counts = charlm.gram_counts(frame(shared, texts), "lang")
    model = charlm.fit(counts)
    grams = Counter()
    for t in texts:
        for x in charlm.grams(charlm.symbols(t or "")):
            grams[tuple(int(x) >> (16 * k) & 0xFFFF for k in range(3, -1, -1))] += 1
    assert sum(r["n"] for r in counts.collect()) == sum(grams.values())
    for text in ("banana", "nab dab", "zebra"):
        logs = model.ready().log_probability(charlm.grams(charlm.symbols(text)))
        assert abs(float(logs.sum()) - slow_kneser_ney(grams, text, 4, 0.75)) < 1e-3


def test_symbols():
    assert charlm.symbols("Ab--1 ç").tolist() == [0, ord("a"), ord("b"), 0, ord("ç"), 0]
    assert charlm.symbols("\U00010400 a")[1] >= 0xE000
    assert len(charlm.symbols("12 .")) == len(charlm.grams(charlm.symbols(""))) == 0


def words_in(language, seed, n):
    """Invented words; a language is a set of syllables."""
    r, s = random.Random(seed), random.Random(language)
    parts = ["".join(s.choices("aeioubdfgklmnprst", k=2)) for _ in range(14)]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def test_language_of_held_out_texts(shared):
    texts = [words_in(f"l{k % 3}", k, 30) for k in range(300)] + ODD
    docs = frame(shared, texts, score=["x"] * len(texts)).withColumn(
        "lang", F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("l"), (F.col("doc_id") % 3).cast("string")))
    )
    found = {r["doc_id"]: r for r in langid.languages(docs, learn=F.col("doc_id") % 5 > 1, check=F.col("doc_id") % 5 == 1).collect()}
    assert len(found) == len(texts)
    assert sum(found[k]["lang_pred"] == f"l{k % 3}" for k in range(300)) >= 297
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[300 + k]["lang_pred"] == "und" for k in range(5)] == [True, True, True, False, False]
    unknown = langid.languages(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True), F.lit(True))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}
    assert langid.languages(docs.limit(0), F.lit(True), F.lit(True)).count() == 0


def labelled(shared, given, name):
    rows = defaultdict(int)
    for r in shared.read.parquet(f"{given}/labels.parquet").collect():
        rows[r["doc_id"]] = r[name]
    return rows


def test_language_query(shared, given):
    lang = {r["doc_id"]: r["lang"] for r in shared.read.parquet(f"{given}/documents.parquet").collect()}
    rows = QUERIES["op2_langid"](shared, given).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_quality_query(shared, given):
    marks = labelled(shared, given, "quality")
    rows = QUERIES["op3_quality"](shared, given).collect()
    assert len(rows) == shared.read.parquet(f"{given}/documents.parquet").count()
    known = [r for r in rows if r["doc_id"] in marks]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in known) >= 0.85 * len(known)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_learns_and_takes_odd_texts(shared):
    texts = [prose(k, 80) if k % 2 else "BUY!! NOW!! " * 30 + prose(k, 4) for k in range(200)] + ODD
    docs = frame(shared, texts, score=texts)
    labels = shared.createDataFrame([(k, k % 2, 0) for k in range(100)] + [(1, None, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = compression.fit(docs, labels, F.lit(False))
    found = {r["doc_id"]: r["score"] for r in compression.scored(docs, model).collect()}
    assert sum((found[k] >= 0.5) == bool(k % 2) for k in range(100, 200)) >= 98
    assert all(0 <= x <= 1 for x in found.values()) and len(found) == len(texts)
    assert {r["doc_id"] for r in compression.filtered(docs, model, 0.5).collect()} == {k for k, x in found.items() if x >= 0.5}
    one_class = compression.fit(docs, labels.where("quality = 1"), F.lit(False))
    assert {r["score"] for r in compression.scored(docs, one_class).collect()} == {1.0}
    nothing = compression.fit(docs, labels.limit(0), F.lit(False))
    assert {r["score"] for r in compression.scored(docs, nothing).collect()} == {0.5}
    assert compression.scored(docs.limit(0), compression.fit(docs.limit(0), labels, F.lit(False))).count() == 0


def test_quality_learns_from_whole_long_texts(shared):
    r = random.Random(12)
    words = [["".join(r.choices("abcdefghijklmnoprstuvé", k=r.randint(5, 11))) for _ in range(1200)] for _ in range(2)]
    texts = []  # what tells the classes apart comes after 16,384 characters, in texts that are not ASCII
    for k in range(120):
        texts.append(prose(k, 2400) + " é" * 2000 + " " + " ".join(r.choices(words[k % 2], k=2500)))
    assert min(t.index(" é é") for t in texts) > 10_000
    docs = frame(shared, texts)
    labels = shared.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = compression.fit(docs, labels, F.lit(False))
    found = {r["doc_id"]: r["score"] for r in compression.scored(docs, model).collect()}
    assert sum((found[k] >= 0.5) == bool(k % 2) for k in range(60, 120)) >= 57


INSULTS = ["moron", "scum", "idiot", "pathetic"]


def test_toxicity_of_disguised_words(shared):
    r = random.Random(8)

    def text(k, word=None):
        words = prose(k, 60).split()
        if word:
            for _ in range(3):
                words.insert(r.randrange(len(words)), word)
        return " ".join(words)

    texts = [text(k, r.choice(INSULTS) if k % 4 == 0 else None) for k in range(400)]
    hidden = ["m0r0n", "s c u m", "1d10t", "p@thetic", "s.c.u.m", "moooron", "idi0000t", "$cum"]
    texts += [text(1000 + k, w) for k, w in enumerate(hidden)] + [text(2000 + k) for k in range(40)] + ODD
    docs = frame(shared, texts, top=texts)
    labels = shared.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, held_out(3, 1))
    score = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((score[k] >= 0.7) == (k % 4 == 0) for k in out) >= 0.97 * len(out)
    assert sum(score[400 + k] >= 0.7 for k in range(len(hidden))) >= len(hidden) - 1
    assert all(score[408 + k] < 0.7 for k in range(40))
    assert len(score) == len(texts) and all(0 <= x <= 1 for x in score.values())
    nothing = toxicity.fit(docs, labels.limit(0), F.lit(False))
    assert {r["score"] for r in toxicity.scored(docs, nothing).collect()} == {0.5}
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.lit(False))).count() == 0


def test_restored_words(shared):
    letters = charlm.fit(charlm.gram_counts(frame(shared, [" ".join(INSULTS) + " " + prose(k, 30) for k in range(60)]), "lang"))
    restore = toxicity.Restorer(letters.ready())
    assert restore.decode("m0r0n") == "moron" and restore.decode("p@7hetic") == "pathetic"
    assert "scum" in restore.words("what s c u m, said") and "idiot" in restore.words("(1d1ot!!)")
    assert restore.words("Plain words, here.") == {"plain", "words", "here"}
    assert restore.words(None) == restore.words("12 34 -- **") == set()


def test_letters_are_scored_once(shared):
    letters = charlm.fit(charlm.gram_counts(frame(shared, [" ".join(INSULTS) + " " + prose(k, 30) for k in range(60)]), "lang"))
    scorer, asked = letters.ready(), []
    plain = scorer.log_probability

    class Counting:
        def log_probability(self, packed, order):
            asked.extend(packed.tolist())
            return plain(packed, order)

    restore = toxicity.Restorer(Counting())
    assert [restore.decode(w) for w in ("m0r0n", "m0ron", "mor0n", "sc*m", "$c*m")] == ["moron"] * 3 + ["scum"] * 2
    assert len(asked) == len(set(asked))


def test_labelled_texts_meet_labels_in_one_way(shared, monkeypatch):
    """Texts that are held out are not shuffled, and few labels are joined like many."""
    plans, plain = [], toxicity.staged

    def spied(df, name):
        if name == "labelled":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(toxicity, "staged", spied)
    docs = frame(shared, [prose(k, 20) for k in range(60)])
    labels = shared.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, held_out(3, 1))
    [plan] = plans
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and plan.count("crc32") >= 2


def test_toxicity_query(shared, given):
    marks = labelled(shared, given, "toxic")
    rows = QUERIES["op8_toxicity"](shared, given).collect()
    assert len(rows) == shared.read.parquet(f"{given}/documents.parquet").count()
    clean = [r for r in rows if marks.get(r["doc_id"]) == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_pipeline_stages_one_by_one(shared, given):
    docs = shared.read.parquet(f"{given}/documents.parquet")
    columns, left = docs.columns, docs
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(shared, left, given).cache()
        counts.append(made.select("doc_id").distinct().count())
        if k < 4:
            assert made.columns == columns
            texts = {r["doc_id"]: r["text"] for r in left.collect()}
            for r in made.collect():
                assert r["doc_id"] in texts
                assert r["text"] == texts[r["doc_id"]] if k < 3 else r["n_chars"] == len(r["text"])
        left = made
    assert counts[0] > counts[2] >= counts[3] == counts[4] == counts[5] > 0.5 * counts[0]


def test_near_duplicates_keeps_other_texts_of_one_id(shared, given):
    rows = [(1, prose(1, 120)), (1, prose(2, 120)), (1, prose(1, 120)), (2, prose(2, 120) + " end"), (3, prose(3, 120))]
    docs = shared.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC)
    left = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(shared, docs, given).collect())
    assert left == sorted({rows[0], rows[1], rows[4]})


def test_pipeline_takes_odd_tables(shared, given):
    good = [prose(k, 120) for k in range(6)]
    texts = ODD + good + [good[0], good[1] + " end"]
    docs = frame(shared, texts, kept=texts, fp=texts, more=texts)
    docs = docs.unionAll(docs.where("doc_id = 9")).unionAll(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    left = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(shared, docs.limit(0), given).count() == 0
        if k in (0, 1):
            continue  # these learn from given labels, which do not fit these texts
        left = stage(shared, left, given)
        if k < 4:
            assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect())[9] == 1


def test_pipeline_runs(shared, given):
    rows = QUERIES_WITH_PIPELINE()["pipeline"](shared, given).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


def QUERIES_WITH_PIPELINE():
    import __spark_entry__

    return __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_are_registered(name):
    assert name in QUERIES_WITH_PIPELINE()
