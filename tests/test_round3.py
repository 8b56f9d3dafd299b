"""Faults found in the third review round."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_queries import DATA, TABLES, comparable


def against_sql(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = [dict(zip(columns, r)) for r in result.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.collect(), sorted(columns)) == comparable(expected, sorted(columns))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["g11_candidate_summary", "g12_evidence_summary"])
def test_summaries_run(spark, name):
    against_sql(spark, name)


def test_portable_fingerprint_of_many_rows(spark):
    """The sum of 48-bit numbers passes the range of a long at about 65,000 rows."""
    import hashlib

    from scorewatch.sources.tables import portable_fingerprint

    n = 150_000
    got = portable_fingerprint(spark.range(n).select("id", F.lit("x").alias("name"))).first()
    wanted = sum(int(hashlib.sha256(f"{i}|x".encode()).hexdigest()[:12], 16) for i in range(n))
    assert wanted > 2**63 and (got["row_count"], got["digest_sum"]) == (n, str(wanted))


def brute_quotas(strata):
    """Water level by turns, from {(segment, target): size}."""
    sizes = {}
    for (_, t), n in strata.items():
        sizes[t] = sizes.get(t, 0) + n
    total = sum(sizes.values())
    wanted = int(0.7 * total)
    exact = {t: n / total * wanted for t, n in sizes.items()}
    quota = {t: int(x) for t, x in exact.items()}
    for t in sorted(exact, key=lambda t: (-(exact[t] - int(exact[t])), t))[: wanted - sum(quota.values())]:
        quota[t] += 1
    out = dict.fromkeys(strata, 0)
    for t in quota:
        left = quota[t]
        while left:
            for key in sorted((k for k in strata if k[1] == t), key=lambda k: f'"{k[0]}"'):
                if left and out[key] < strata[key] - 1:
                    out[key] += 1
                    left -= 1
    return out


def test_stratum_quotas_of_many_strata(spark):
    import random

    from scorewatch.operators import split

    draw = random.Random(5)
    strata = {(f"s{k}", t): draw.choice([3, 4, 7, 7, 12, 90]) for k in range(60) for t in (0, 1)}
    rows = [(s, t) for (s, t), n in strata.items() for _ in range(n)]
    got = split.stratum_quotas(spark.createDataFrame(rows, "segment string, target int"), "target", "segment").collect()
    assert all(r["feasible"] for r in got) and len(got) == len(strata)
    assert {(r["segment"], r["target"]): r["quota"] for r in got} == brute_quotas(strata)


def test_single_row_strata_are_not_put_in_order(spark, monkeypatch):
    """With a stratum per row, the fallback is known before any window over strata."""
    from scorewatch.operators import split

    def fail(strata):
        raise AssertionError("strata were ordered")

    monkeypatch.setattr(split, "_stratum_quotas", fail)
    df = spark.range(1000).selectExpr("cast(id as string) entity_id", "cast(id % 4 = 0 as int) target")
    parts, limits = split.stratified_split(df, "target", "entity_id")
    counts = {(r["target"], r["partition"]): r["count"] for r in parts.groupBy("target", "partition").count().collect()}
    assert limits == [split.FALLBACK_LIMITATION]
    assert counts == {(0, "train"): 525, (0, "test"): 225, (1, "train"): 175, (1, "test"): 75}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_risk_view_is_joined_once(spark):
    from scorewatch.plans import queries_rules

    assert not any("lineitem" in f for f in queries_rules.train(spark, DATA).inputFiles())


def test_tfidf_from_term_maps(spark):
    """Weights equal a plain computation; postings carry a number, not the 64 characters of an id."""
    import math
    from collections import Counter

    from scorewatch.operators import retrieval

    texts = ["alpha beta beta", "beta gamma", "gamma gamma delta", "alpha beta beta", "1 2"]
    docs = retrieval.citations(spark.createDataFrame([("s", t) for t in texts], "scope string, text string"))
    maps = retrieval.term_maps(docs, "scope", "citation_id")
    assert retrieval.postings_of(maps).columns == ["scope", "doc", "term", "tf"]
    assert maps.select("doc").distinct().count() == 4
    names = {r["citation_id"]: r["text"] for r in docs.collect()}
    got = {(names[r["citation_id"]], r["term"]): r["weight"] for r in retrieval.tfidf(docs).collect()}
    n, seen = 4, Counter(w for t in set(texts[:4]) for w in set(t.split()))
    want = {}
    for t in set(texts[:4]):
        w = {x: c * (math.log((1 + n) / (1 + seen[x])) + 1) for x, c in Counter(t.split()).items()}
        want |= {(t, x): v / math.sqrt(sum(y * y for y in w.values())) for x, v in w.items()}
    assert got == pytest.approx(want)
