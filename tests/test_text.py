import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest

from scorewatch.operators import audit, evaluation, privacy, retrieval

TOKEN = re.compile(r"(?u)\b[^\W\d_][\w-]{1,63}\b")
TEXTS = [
    "Straße déjà-vu x yy -lead trail- a--b 3abc 4-def snake_case été",
    "plain words only",
    "long " + "z" * 70 + " tail",
    "",
]


def test_terms_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {}
    for r in retrieval.term_counts(df, "i").collect():
        got.setdefault(r.i, {})[r.term] = r.tf
    for i, t in enumerate(TEXTS):
        assert got.get(i, {}) == dict(Counter(TOKEN.findall(t.casefold())))


def test_search_matches_brute_force(spark):
    docs = ["alpha beta beta", "beta gamma", "gamma gamma delta", "alpha beta beta", "other thing"]
    df = spark.createDataFrame([("s", d) for d in docs], "scope string, text string")
    corpus = retrieval.citations(df)
    assert corpus.count() == 4
    asked = spark.createDataFrame([(1, "s", "beta gamma unknown"), (2, "t", "beta")], "query_id int, scope string, text string")
    got = {r.content_hash: r.score for r in retrieval.search(corpus, asked, limit=10).collect()}
    unique = list(dict.fromkeys(docs))
    n = len(unique)
    df_ = Counter(t for d in unique for t in set(d.split()))
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in df_.items()}

    def vector(text):
        w = {t: c * idf[t] for t, c in Counter(text.split()).items() if t in idf}
        size = math.sqrt(sum(v * v for v in w.values()))
        return {t: v / size for t, v in w.items()}

    q = vector("beta gamma unknown")
    want = {}
    for d in unique:
        score = sum(v * q.get(t, 0) for t, v in vector(d).items())
        if score > 0:
            want[hashlib.sha256(d.encode()).hexdigest()] = score
    assert got == pytest.approx(want, abs=1e-11)


def test_search_by_blocks_equals_scoring_all(spark):
    r = random.Random(2)
    words = [f"word{k}" for k in range(60)]
    docs = [("ab"[k % 2], " ".join(r.choices(words, k=r.choice([2, 8, 40])))) for k in range(240)]
    docs += [("a", "word1 word2 word3"), ("a", "word3 word2 word1"), ("a", "word2 word1 word3"), ("a", "123 456"), ("a", "")]
    corpus = retrieval.citations(spark.createDataFrame(docs, "scope string, text string")).cache()
    queries = [(k, "abc"[k % 3], " ".join(r.choices(words, k=6))) for k in range(9)] + [(9, "a", "word1 word2 word3"), (10, "a", "unheard"), (11, "b", None)]
    asked = spark.createDataFrame(queries, "query_id int, scope string, text string")
    index = retrieval.build_index(corpus, size=8)
    got = {(x.query_id, x["rank"]): (x.citation_id, round(x.score, 9)) for x in retrieval.ask(index, asked, limit=4, first_blocks=1).collect()}
    every = {}
    for x in corpus.collect():
        every.setdefault(x.scope, []).append((x.citation_id, Counter(TOKEN.findall(x.text))))
    want = {}
    for number, scope, text in queries:
        own = every.get(scope, [])
        df = Counter(t for _, c in own for t in c)
        idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
        q = {t: n * idf[t] for t, n in Counter(TOKEN.findall(text or "")).items() if t in idf}
        size = math.sqrt(sum(v * v for v in q.values()))
        scores = []
        for citation, c in own:
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
            score = round(sum(n * idf[t] * q.get(t, 0) for t, n in c.items()) / (norm * size), 9) if norm and size else 0
            if score > 0:
                scores.append((-score, citation))
        want |= {(number, k): (c, -v) for k, (v, c) in enumerate(sorted(scores)[:4], 1)}
    assert got == want


SAFE = "plain sentence without anything special. another one"
UNSAFE = {
    "uri": "see http://a.example now",
    "email": "write a@b.org now",
    "unix_path": "open /etc/passwd now",
    "long_number": "call 12345678 now",
    "secret_reference": "the password is hunter",
    "assignment": "alpha=beta",
    "inline_code": "call run(x) now",
    "code_fence": "use `x` here",
    "comma_line": "one, two",
    "table_delimiter": "a|b",
    "list_comprehension": "take [x for x in y now",
    "code_line": "hello\nimport os",
    "segment_field": "the segment gold is best",
    "control_character": "a\x01b",
    "empty": "  \n ",
}


def test_admission_reasons(spark):
    rows = [("safe", SAFE), *UNSAFE.items()]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r.k: r.rs for r in df.select("k", privacy.admission_reasons("text").alias("rs")).collect()}
    assert got["safe"] == []
    for name in UNSAFE:
        assert name in got[name], (name, got[name])
    closed = spark.createDataFrame([("take [x] for x in y",)], "text string")
    assert "list_comprehension" not in closed.select(privacy.admission_reasons("text")).first()[0]
    assert [r.k for r in privacy.admitted(df).collect()] == ["safe"]


def test_unsafe_values_and_names(spark):
    df = spark.createDataFrame(
        [("/tmp/x", 1.0), ("a@b.org", float("inf")), ("fine", 2.0), ("user_id=5", None)], "s string, v double"
    )
    got = {(r.column, r.reason): r.row_count for r in privacy.unsafe_values(df).collect()}
    assert got == {("s", "path"): 1, ("s", "email"): 1, ("s", "identifier"): 1, ("v", "non_finite"): 1}
    names = ["customerId", "customer_count", "raw_x", "lift", "file_path", "userTotal", "target"]
    assert privacy.exposing_columns(names) == ["customerId", "raw_x", "file_path", "target"]
    odd = ["uri", "my_uri", "raw", "Raw Rows", "personName", "personCount", "entity", "total_user", "HTTPPath", ""]
    assert privacy.exposing_columns(odd) == ["my_uri", "raw", "Raw Rows", "personName", "entity"]


def chain(run, n):
    previous, out = audit.ROOT_HASH, []
    for seq in range(1, n + 1):
        content = json.dumps({"run_id": run, "v": seq}, separators=(",", ":"))
        evidence = hashlib.sha256(content.encode()).hexdigest()
        link = json.dumps(
            {"evidence_id": evidence, "previous_hash": previous, "run_id": run, "sequence": seq},
            separators=(",", ":"),
        )
        this = hashlib.sha256(link.encode()).hexdigest()
        parents = [out[0][3]] if out else []
        out.append([run, seq, content, evidence, previous, this, parents])
        previous = this
    return out


def test_chain_verification(spark):
    good, edited, gap, forked, orphan = (chain(r, 5) for r in "abcde")
    edited[2][2] = "{}"
    del gap[1]
    forked += [list(forked[3])]
    orphan[1][6] = ["nothing"]
    schema = (
        "run_id string, sequence long, content_json string, evidence_id string, previous_hash string, "
        "chain_hash string, parent_ids array<string>"
    )
    df = spark.createDataFrame([tuple(r) for c in (good, edited, gap, forked, orphan) for r in c], schema)
    got = {r.run_id: (r.valid, r.first_broken) for r in audit.verify_chains(df).collect()}
    assert got["a"] == (True, None) and got["b"] == (False, 3) and got["c"] == (False, 3)
    assert got["d"][0] is False and got["e"] == (False, 2)


def test_log_verification(spark):
    previous, rows = audit.ROOT_HASH, []
    for seq in range(1, 6):
        text = json.dumps({"n": seq})
        this = hashlib.sha256(f"{seq}\n{previous}\n{text}".encode()).hexdigest()
        rows.append((seq, text, previous, this))
        previous = this
    schema = "sequence long, event_json string, previous_hash string, event_hash string"
    df = spark.createDataFrame(rows, schema)
    assert audit.verify_log(df, 5, previous).first().valid
    assert not audit.verify_log(df, 6, previous).first().valid
    assert not audit.verify_log(df.filter("sequence <> 3"), 4, previous).first().valid


def test_set_scores_with_empty_sets(spark):
    ids = lambda rows: spark.createDataFrame(rows, "case_id string, id int")
    cases = ids([("a", 0), ("b", 0)])
    got = {
        r.case_id: r
        for r in evaluation.set_scores(cases, ids([("a", 1), ("a", 2)]), ids([("a", 2), ("a", 3)])).collect()
    }
    assert (got["a"].precision, got["a"].recall, got["a"].f1) == (0.5, 0.5, 0.5)
    assert (got["b"].precision, got["b"].f1, got["b"].exact) == (0.0, 0.0, True)
    assert evaluation.outside_universe(ids([("a", 1)]), ids([("a", 1), ("a", 9)])).count() == 1
