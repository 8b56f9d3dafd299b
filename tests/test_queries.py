"""Registered queries against their SQL on the smallest tables.

The quick subset runs by default; SCOREWATCH_ALL=1 runs every query.
"""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUICK = (
    "a1_projected_scan", "b3_profile", "c1_time_split", "c2_stratified_split", "d2_comparisons",
    "e1_rule_metrics", "e8_quantiles", "i6_feature_psi", "j4_credit_card_balance", "n1_term_counts",
    "o1_set_scores", "o8_verify_chains", "s2_window_bins",
)
NAMES = sorted(entry.queries()) if os.environ.get("SCOREWATCH_ALL") else QUICK


def comparable(rows, columns):
    def value(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr([value(r[c]) for c in columns]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    import duckdb

    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected = [dict(zip(columns, r)) for r in result.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(rows, sorted(columns)) == comparable(expected, sorted(columns))


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
