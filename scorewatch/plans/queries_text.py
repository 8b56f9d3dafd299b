"""Queries for privacy, text admission, retrieval, evaluation and audit."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorewatch.functions.expr import rounded
from scorewatch.functions.tokens import (
    redact_strings,
    redaction_code,
    segment_token,
    stable_token,
)
from scorewatch.operators import audit, evaluation, privacy, retrieval
from scorewatch.plans.registry import query
from scorewatch.plans.views import r6, table

# --- M. privacy ---------------------------------------------------------------------------


@query(
    "m1_small_groups",
    "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 12",
)
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return privacy.suppress_small_groups(counts, "n", 12)


@query(
    "m2_segment_tokens",
    """SELECT c_name, 'segment-' || substring(sha256('{"namespace":"ns","value":"' || c_name || '"}'), 1, 24) AS token FROM customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_name", segment_token("c_name", "ns").alias("token"))


@query(
    "m3_stable_tokens",
    """SELECT n_name, 'tok_' || substring(sha256('institution:' || n_name), 1, 16) AS token,
    'segment-' || substring(sha256(n_name), 1, 8) AS code FROM nation""",
)
def _(spark, sf):
    return table(spark, sf, "nation").select(
        "n_name", stable_token("n_name", "institution").alias("token"), redaction_code("n_name").alias("code")
    )


@query(
    "m4_redacted_strings",
    """SELECT s_suppkey, 'tok_' || substring(sha256('value:' || s_name), 1, 16) AS s_name, s_nationkey, s_acctbal FROM supplier""",
)
def _(spark, sf):
    return redact_strings(table(spark, sf, "supplier"))


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def values_sql(relation: str, column: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{column}' AS \"column\", '{name}' AS reason, count(*) AS row_count FROM {relation} "
        f"WHERE regexp_matches(trim({column}), {sql_text(p)}) HAVING count(*) > 0"
        for name, p in privacy.UNSAFE_VALUES.items()
    )


@query("m5_unsafe_urls", values_sql("pages", "url"))
def _(spark, sf):
    return privacy.unsafe_values(table(spark, sf, "pages"), ["url"])


@query(
    "m5_unsafe_words",
    "WITH words AS (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) "
    + values_sql("words", "word"),
)
def _(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    return privacy.unsafe_values(words)


# The SQL engine knows neither look-around nor Unicode word boundaries, so the
# boundaries are spelled out here and reasons that need more are left out.
SQL_PATTERNS = {
    "uri": r"(^|[^\p{L}\p{N}_])[A-Za-z][A-Za-z0-9+.-]*://[^\s<>()]+",
    "windows_path": r"(^|[^\p{L}\p{N}_])[A-Za-z]:[\\/][^\s]+",
    "unc_path": r"\\\\[^\\\s]+\\[^\s]+",
    "unix_path": r"(^|[^A-Za-z0-9])/([A-Za-z0-9._~-]+/)*[A-Za-z0-9._~%-]+",
    "long_number": r"(^|[^\p{L}\p{N}_])\d{8,}([^\p{L}\p{N}_]|$)",
    "json_row": r"(?s)(\{|\[\s*\{)\s*\"[^\"\r\n]{1,128}\"\s*:",
}


@query(
    "m6_admission_reasons",
    " UNION ALL ".join(
        f"SELECT '{name}' AS reason, count(*) AS row_count FROM documents WHERE regexp_matches(trim(text), {sql_text(p)}) HAVING count(*) > 0"
        for name, p in SQL_PATTERNS.items()
    )
    + " UNION ALL SELECT 'comma_line', count(*) FROM documents WHERE contains(text, ',') HAVING count(*) > 0"
    + " UNION ALL SELECT 'too_long', count(*) FROM documents WHERE length(trim(text, ' ' || chr(10))) > 16384 HAVING count(*) > 0"
    + " UNION ALL SELECT 'table_delimiter', count(*) FROM documents WHERE contains(text, '|') OR contains(text, chr(9)) HAVING count(*) > 0",
)
def _(spark, sf):
    checked = [*SQL_PATTERNS, "comma_line", "too_long", "table_delimiter"]
    reasons = table(spark, sf, "documents").select(
        F.explode(privacy.admission_reasons("text")).alias("reason")
    )
    return (
        reasons.filter(F.col("reason").isin(checked))
        .groupBy("reason")
        .agg(F.count("*").alias("row_count"))
    )


@query("m6_admitted_texts")
def _(spark, sf):
    sentences = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split("text", r"[.\n]")).alias("text")
    )
    return privacy.admitted(sentences).groupBy("doc_id").agg(F.count("*").alias("sentences"))


# --- N. retrieval --------------------------------------------------------------------------

# Runs of word characters and hyphens, from their first letter at a word start, without the
# hyphens at the end.
TERMS_SQL = r"""runs AS (SELECT {key}, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}_-]+')) AS run FROM {src}),
 cut AS (SELECT {key}, regexp_replace(regexp_extract(run, '(?:^|-)(\p{{L}}[\p{{L}}\p{{N}}_-]*)', 1), '-+$', '') AS term FROM runs),
 {name} AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM cut WHERE length(term) >= 2 GROUP BY ALL)"""


@query(
    "n1_term_counts",
    "WITH " + TERMS_SQL.format(key="doc_id", src="documents", name="tc") + " SELECT doc_id, term, tf FROM tc",
)
def _(spark, sf):
    return retrieval.term_counts(table(spark, sf, "documents"), "doc_id")


def corpus(spark, sf):
    return retrieval.citations(table(spark, sf, "documents"), scope="lang")


CORPUS_SQL = """corpus AS MATERIALIZED (SELECT scope, text, content_hash, sha256('document' || chr(0) || content_hash) AS document_id,
   sha256('citation' || chr(0) || scope || chr(0) || sha256('document' || chr(0) || content_hash)) AS citation_id
   FROM (SELECT DISTINCT lang AS scope, text, sha256(text) AS content_hash FROM documents))"""


@query("n2_citations", f"WITH {CORPUS_SQL} SELECT scope, content_hash, document_id, citation_id FROM corpus")
def _(spark, sf):
    return corpus(spark, sf).drop("text")


IDF_SQL = (
    CORPUS_SQL + ", " + TERMS_SQL.format(key="scope, citation_id", src="corpus", name="post")
    + """, sizes AS (SELECT scope, count(*) AS n FROM corpus GROUP BY 1),
 idf AS MATERIALIZED (SELECT scope, term, ln((1 + n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM post JOIN sizes USING (scope) GROUP BY scope, term, n),
 norms AS MATERIALIZED (SELECT scope, citation_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM post JOIN idf USING (scope, term) GROUP BY 1, 2)"""
)


@query(
    "n3_tfidf",
    "WITH " + CORPUS_SQL + ", " + TERMS_SQL.format(key="scope, citation_id", src="corpus", name="post")
    + f""", sizes AS (SELECT scope, count(*) AS n FROM corpus GROUP BY 1),
 w AS (SELECT scope, citation_id, term, tf * (ln((1 + n)::DOUBLE / (1 + count(*) OVER (PARTITION BY scope, term))) + 1) AS w FROM post JOIN sizes USING (scope))
 SELECT scope, citation_id, term, {r6('w / sqrt(sum(w * w) OVER (PARTITION BY scope, citation_id))')} AS weight FROM w""",
)
def _(spark, sf):
    return rounded(retrieval.tfidf(corpus(spark, sf)))


def questions(spark, sf):
    """Every benchmark text asked in every scope that the documents have (a handful of languages)."""
    items = table(spark, sf, "benchmark")
    scopes = table(spark, sf, "documents").select("lang").distinct().where("lang IS NOT NULL")
    names = [r["lang"] for r in scopes.orderBy("lang").collect()]
    return items.select(
        F.col("item_id").alias("query_id"),
        F.explode(F.array(*[F.lit(s) for s in names])).alias("scope"),
        "text",
    )


@query(
    "n4_search",
    f"""WITH {IDF_SQL}, asked0 AS (SELECT item_id AS query_id, scope, text FROM benchmark, (SELECT DISTINCT lang AS scope FROM documents WHERE lang IS NOT NULL)),
    {TERMS_SQL.format(key='query_id, scope', src='asked0', name='asked').replace('runs AS', 'runs2 AS').replace('FROM runs)', 'FROM runs2)').replace('cut AS', 'cut2 AS').replace('FROM cut WHERE', 'FROM cut2 WHERE')},
    qw AS (SELECT query_id, scope, term, tf * idf AS w FROM asked JOIN idf USING (scope, term)),
    qn AS (SELECT query_id, scope, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY 1, 2),
    dots AS (SELECT query_id, scope, citation_id, sum(tf * idf * w) AS dot FROM post JOIN idf USING (scope, term) JOIN qw USING (scope, term) GROUP BY 1, 2, 3),
    sc AS (SELECT query_id, scope, citation_id, round(greatest(0, least(1, dot / (norm * qnorm))), 12) AS score FROM dots JOIN norms USING (scope, citation_id) JOIN qn USING (query_id, scope))
    SELECT query_id, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(score, 9) DESC, citation_id) AS rank, {r6('score')} AS score
    FROM sc WHERE score > 0 QUALIFY rank <= 5""",
)
def _(spark, sf):
    found = retrieval.search(corpus(spark, sf), questions(spark, sf), limit=5)
    return rounded(found.select("query_id", "scope", F.col("rank").cast("long").alias("rank"), "score"))


# --- O. evaluation ----------------------------------------------------------------------------


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    return rows.select(
        F.col("source").alias("case_id"), F.col("doc_id").alias("id"), "quality", "toxic", "n_chars"
    )


LABELLED_SQL = "lab AS (SELECT source AS case_id, doc_id AS id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id))"
SETS_SQL = (
    LABELLED_SQL
    + """, sc AS (SELECT case_id, count(*) FILTER (quality = 1 AND toxic = 1) AS true_positives, count(*) FILTER (quality = 0 AND toxic = 1) AS false_positives,
   count(*) FILTER (quality = 1 AND toxic = 0) AS false_negatives, count(*) FILTER (quality = 0 AND toxic = 0) AS true_negatives FROM lab GROUP BY 1)"""
)


def rates_sql(prefix="") -> str:
    p = "(CASE WHEN true_positives + false_positives > 0 THEN true_positives::DOUBLE / (true_positives + false_positives) ELSE 0 END)"
    r = "(CASE WHEN true_positives + false_negatives > 0 THEN true_positives::DOUBLE / (true_positives + false_negatives) ELSE 0 END)"
    f1 = f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
    return f"{prefix}true_positives, false_positives, false_negatives, {r6(p)} AS precision, {r6(r)} AS recall, {r6(f1)} AS f1"


FPR_SQL = r6("CASE WHEN false_positives + true_negatives > 0 THEN false_positives::DOUBLE / (false_positives + true_negatives) ELSE 0 END")


def _sets(spark, sf):
    rows = labelled(spark, sf)
    return evaluation.set_scores(
        rows.select("case_id").distinct(), rows.filter("quality = 1"), rows.filter("toxic = 1")
    )


def _confusion(spark, sf):
    rows = labelled(spark, sf)
    universe = rows.select("case_id", "id")
    return evaluation.drift_confusion(universe, rows.filter("quality = 1"), rows.filter("toxic = 1"))


def _hits(spark, sf):
    rows = labelled(spark, sf)
    order = W.partitionBy("case_id").orderBy(F.desc("n_chars"), "id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    return evaluation.ranked_hits(ranked, rows.filter("toxic = 1"), 5)


@query(
    "o1_set_scores",
    f"WITH {SETS_SQL} SELECT case_id, {rates_sql()}, false_positives = 0 AND false_negatives = 0 AS exact FROM sc",
)
def _(spark, sf):
    return rounded(_sets(spark, sf))


@query(
    "o2_drift_confusion",
    f"WITH {SETS_SQL}, x AS (SELECT case_id, {rates_sql()}, true_negatives, {FPR_SQL} AS false_positive_rate FROM sc) SELECT * EXCLUDE (f1) FROM x",
)
def _(spark, sf):
    return rounded(_confusion(spark, sf))


HITS_SQL = (
    LABELLED_SQL
    + """, rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, id) AS rank FROM lab),
 h AS (SELECT case_id, count(*) FILTER (toxic = 1) AS relevant_count, count(*) FILTER (toxic = 1 AND rank <= 5) AS retrieved_relevant_count FROM rk GROUP BY 1)"""
)


@query(
    "o3_ranked_hits",
    f"""WITH {HITS_SQL} SELECT case_id, relevant_count, retrieved_relevant_count, CAST(5 AS BIGINT) AS k, CASE WHEN retrieved_relevant_count > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_k,
    {r6('CASE WHEN relevant_count > 0 THEN retrieved_relevant_count::DOUBLE / relevant_count ELSE 0 END')} AS recall_at_k FROM h""",
)
def _(spark, sf):
    return rounded(_hits(spark, sf))


@query(
    "o4_micro_set_scores",
    f"""WITH {SETS_SQL}, t AS (SELECT CAST(sum(true_positives) AS BIGINT) AS true_positives, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(false_negatives) AS BIGINT) AS false_negatives,
    count(*) AS case_count, count(*) FILTER (false_positives = 0 AND false_negatives = 0) AS exact_count FROM sc)
    SELECT {rates_sql()}, case_count, exact_count, {r6('exact_count::DOUBLE / case_count')} AS exact_rate FROM t""",
)
def _(spark, sf):
    return rounded(evaluation.micro_set_scores(_sets(spark, sf)))


@query(
    "o4_micro_confusion",
    f"""WITH {SETS_SQL}, t AS (SELECT CAST(sum(true_positives) AS BIGINT) AS true_positives, CAST(sum(false_positives) AS BIGINT) AS false_positives, CAST(sum(false_negatives) AS BIGINT) AS false_negatives,
    CAST(sum(true_negatives) AS BIGINT) AS true_negatives FROM sc), x AS (SELECT {rates_sql()}, true_negatives, {FPR_SQL} AS false_positive_rate FROM t) SELECT * EXCLUDE (f1) FROM x""",
)
def _(spark, sf):
    return rounded(evaluation.micro_confusion(_confusion(spark, sf)))


@query(
    "o4_micro_hits",
    f"""WITH {HITS_SQL}, t AS (SELECT count(*) AS case_count, count(*) FILTER (retrieved_relevant_count > 0) AS hit_count, CAST(sum(relevant_count) AS BIGINT) AS relevant_count,
    CAST(sum(retrieved_relevant_count) AS BIGINT) AS retrieved_relevant_count FROM h)
    SELECT *, {r6('hit_count::DOUBLE / case_count')} AS hit_at_k, {r6('retrieved_relevant_count::DOUBLE / relevant_count')} AS recall_at_k FROM t""",
)
def _(spark, sf):
    return rounded(evaluation.micro_hits(_hits(spark, sf)))


def replayed(spark, sf):
    """Cases and two observation tables derived from the conversations."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("r0"),
        F.max(F.when(F.col("turn") == 1, F.col("role"))).alias("r1"),
        F.max("turn").alias("last"),
        F.max(F.length("text")).cast("long").alias("size"),
    )
    case = F.col("conv_id").alias("case_id")
    cases = turns.select(
        case,
        F.array(F.lit("user"), F.lit("assistant")).alias("expected_tools"),
        F.array(F.lit(1).cast("long"), F.lit(3).cast("long")).alias("required_evidence"),
        (F.col("conv_id") % 2 == 0).alias("require_diagnosis"),
    )
    observed = turns.select(
        case,
        (F.col("last") >= 3).alias("task_succeeded"),
        F.array("r0", "r1").alias("tools"),
        F.sequence(F.lit(0).cast("long"), F.col("last")).alias("evidence"),
        F.when(F.col("last") >= 5, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>")).alias(
            "diagnosis_evidence"
        ),
        (F.col("size") % 9 == 0).cast("int").alias("policy_violations"),
        (F.col("size") % 11 == 0).cast("int").alias("privacy_violations"),
    )
    again = observed.withColumn(
        "policy_violations", F.when(F.col("case_id") % 7 == 0, 5).otherwise(F.col("policy_violations"))
    )
    return cases, observed, again


GATES_SQL = """turns AS (SELECT conv_id, max(role) FILTER (turn = 0) AS r0, max(role) FILTER (turn = 1) AS r1, max(turn) AS last, max(length(text)) AS size FROM conversations GROUP BY 1),
 g0 AS (SELECT conv_id AS case_id, last >= 3 AS task_succeeded, [r0, r1] = ['user', 'assistant'] AS tool_sequence_matched,
   last >= 3 AND (conv_id % 2 <> 0 OR last >= 5) AS evidence_complete, size % 9 <> 0 AS policy_compliant, size % 11 <> 0 AS privacy_compliant,
   conv_id % 7 <> 0 AS replay_deterministic FROM turns),
 gates AS (SELECT *, task_succeeded AND tool_sequence_matched AND evidence_complete AND policy_compliant AND privacy_compliant AND replay_deterministic AS passed FROM g0)"""


@query("o5_case_gates", f"WITH {GATES_SQL} SELECT * FROM gates")
def _(spark, sf):
    return evaluation.case_gates(*replayed(spark, sf))


_MEANS = [f"avg(CASE WHEN {g} THEN 1.0::DOUBLE ELSE 0 END)" for g in evaluation.GATES]


@query(
    "o5_gate_means",
    f"WITH {GATES_SQL} SELECT count(*) AS case_count, "
    + ", ".join(f"{r6(m)} AS {g}" for g, m in zip(evaluation.GATES, _MEANS))
    + f", {r6('(' + ' + '.join(_MEANS) + ') / 6')} AS overall FROM gates",
)
def _(spark, sf):
    return rounded(evaluation.gate_means(evaluation.case_gates(*replayed(spark, sf))))


@query(
    "o6_compare_reports",
    f"WITH {GATES_SQL}, v AS (" + " UNION ALL ".join(
        f"SELECT '{g}' AS metric, avg(CASE WHEN {g} THEN 1.0::DOUBLE ELSE 0 END) FILTER (case_id % 2 = 0) AS baseline, avg(CASE WHEN {g} THEN 1.0::DOUBLE ELSE 0 END) FILTER (case_id % 2 = 1) AS candidate FROM gates"
        for g in evaluation.GATES
    ) + f") SELECT metric, {r6('baseline')} AS baseline, {r6('candidate')} AS candidate, {r6('candidate - baseline')} AS delta, candidate - baseline < -1e-12::DOUBLE AS regressed FROM v",
)
def _(spark, sf):
    gates = evaluation.case_gates(*replayed(spark, sf))
    sides = [
        evaluation.metric_rows(evaluation.gate_means(gates.filter(F.col("case_id") % 2 == i)), evaluation.GATES)
        for i in (0, 1)
    ]
    return rounded(evaluation.compare_reports(*sides))


@query(
    "o7_measurement_rollup",
    f"""WITH t AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY 1)
    SELECT count(*) AS task_count, {r6('(sum(n) - sum(n / 4)) / sum(n)')} AS efficiency_rate, CAST(sum(n) AS BIGINT) AS total_reviewed_rules, CAST(sum(f) AS BIGINT) AS total_accepted_rules,
    {r6('sum(f)::DOUBLE / sum(n)')} AS rule_review_acceptance, {r6('sum(f)::DOUBLE / (sum(f) + sum(o))')} AS anomaly_precision, {r6('sum(f)::DOUBLE / sum(n)')} AS anomaly_recall,
    {r6('sum(o)::DOUBLE / sum(n)')} AS root_cause_top3_hit_rate FROM t""",
)
def _(spark, sf):
    n, priority = F.count("*"), F.col("o_orderpriority")
    f, o = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "O")
    records = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority")
        .agg(
            n.alias("reviewed_rules"), f.alias("accepted_rules"), f.alias("true_positives"),
            o.alias("false_positives"), (n - f).alias("false_negatives"), o.alias("top3_hits"),
            n.alias("root_cause_cases"),
        )
        .select(
            "*",
            priority.alias("run_id"), priority.alias("task_id"), priority.alias("baseline_task_id"),
            F.lit("orders").alias("dataset_id"), F.lit("c").alias("config_hash"),
            F.lit("d").alias("data_fingerprint"), priority.alias("baseline_fingerprint"),
            F.col("reviewed_rules").cast("double").alias("manual_minutes"),
            (F.col("reviewed_rules") / 4).alias("agent_minutes"),
            (F.col("reviewed_rules") * 15.0).alias("stage_seconds"),
        )
    )
    return rounded(evaluation.measurement_rollup(records))


def chained(spark, sf):
    """Conversations as hash-chained runs with a record per turn, some of them tampered with.

    Only the hashes of a run meet to be chained; the records with their texts stay rows.
    """
    turns = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(
        F.min("role").alias("role"), F.min("text").alias("text")
    )
    content = F.to_json(F.struct("role", "text", "turn"))
    rows = turns.select(
        F.col("conv_id").cast("string").alias("run_id"),
        "conv_id",
        (F.col("turn") + 1).alias("sequence"),
        content.alias("content_json"),
        F.sha2(content, 256).alias("evidence_id"),
    )
    listed = rows.groupBy("run_id", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "evidence_id"))).alias("rs")
    )
    link_type = (
        "array<struct<sequence:bigint,evidence_id:string,previous_hash:string,chain_hash:string>>"
    )

    def fold(acc, r):
        before = F.when(F.size(acc) == 0, F.lit(audit.ROOT_HASH)).otherwise(
            F.try_element_at(acc, F.lit(-1))["chain_hash"]
        )
        link = audit.chain_hash(r["evidence_id"], before, F.col("run_id"), r["sequence"])
        return F.concat(
            acc,
            F.array(
                F.struct(
                    r["sequence"].alias("sequence"),
                    r["evidence_id"].alias("evidence_id"),
                    before.alias("previous_hash"),
                    link.alias("chain_hash"),
                )
            ),
        )

    links = listed.withColumn("ls", F.aggregate("rs", F.array().cast(link_type), fold))
    flat = links.select("run_id", "conv_id", F.explode("ls").alias("l")).select("run_id", "conv_id", "l.*")
    flat = flat.join(rows.select("run_id", "sequence", "content_json"), ["run_id", "sequence"])
    seq, conv = F.col("sequence"), F.col("conv_id")
    first = F.min(F.when(seq == 1, F.col("evidence_id")))
    parents = flat.groupBy("run_id").agg(first.alias("first_id"))
    return (
        flat.join(parents, "run_id")
        .withColumn(
            "parent_ids",
            F.when(
                (seq == 2) & F.col("first_id").isNotNull(),
                F.array(F.when(conv % 10 == 7, F.lit("missing")).otherwise(F.col("first_id"))),
            ).otherwise(F.array().cast("array<string>")),
        )
        .withColumn(
            "content_json",
            F.when((conv % 10 == 3) & (seq == 3), F.lit("{}")).otherwise(F.col("content_json")),
        )
        .filter(~((conv % 10 == 5) & (seq == 2)))
        .drop("first_id", "conv_id")
    )


@query(
    "o8_verify_chains",
    """WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations),
    r AS (SELECT CAST(conv_id AS VARCHAR) AS run_id, conv_id, turn + 1 AS seq FROM t WHERE NOT (conv_id % 10 = 5 AND turn = 1)),
    b AS (SELECT *, (conv_id % 10 = 3 AND seq = 3) OR (conv_id % 10 = 5 AND seq = 3) OR (conv_id % 10 = 7 AND seq = 2) AS broken FROM r)
    SELECT run_id, count(*) AS record_count, count(*) FILTER (broken) AS broken_records, min(seq) FILTER (broken) AS first_broken,
    count(*) FILTER (broken) = 0 AND min(seq) = 1 AND max(seq) = count(*) AS valid FROM b GROUP BY 1""",
)
def _(spark, sf):
    return audit.verify_chains(chained(spark, sf))


@query(
    "o9_verify_log",
    """SELECT count(*) AS event_count, count(*) FILTER (event_id > 0 AND event_id % 100 = 51) AS gaps,
    count(*) FILTER (event_id > 0) + count(*) FILTER (event_id = 0) * 0 AS broken_links,
    count(*) FILTER (event_id % 1000 = 7) AS broken_hashes, FALSE AS valid FROM events WHERE event_id % 100 <> 50""",
)
def _(spark, sf):
    # The log is linked to fixed anchors instead of its predecessors, which every
    # link check must notice; some events are missing and some were edited.
    seq = F.col("event_id") + 1
    anchor = F.when(seq == 1, F.lit(audit.ROOT_HASH)).otherwise(F.sha2(seq.cast("string"), 256))
    events = table(spark, sf, "events").filter(F.col("event_id") % 100 != 50)
    text = F.to_json(F.struct("event_type", "user_id", "value"))
    edited = F.when(F.col("event_id") % 1000 == 7, F.concat(text, F.lit(" "))).otherwise(text)
    log = events.select(
        seq.alias("sequence"),
        edited.alias("event_json"),
        anchor.alias("previous_hash"),
        audit.event_hash(seq, anchor, text).alias("event_hash"),
    )
    return audit.verify_log(log, 0, "")
