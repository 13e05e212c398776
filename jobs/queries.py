"""The jobs as registered queries: each runs twice into one new shared folder and gives what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.operators.answer import NO_ANSWER
from tarnwick.plans import tables as T
from tarnwick.sources.versions import shared_folder

from . import evaluation, keyword_index

EXPERIMENTS = {"one context": 1, "three contexts": 3, "ten contexts": 10}


def job1_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job1")
    for _ in range(2):
        index = keyword_index.run(spark, f"{sf_dir}/documents.parquet", folder)
    return keyword_index.documents(index)


def job2_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "job2")
    for _ in range(2):
        cases, _ = evaluation.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/index", folder, EXPERIMENTS)
    return cases.select("experiment", "query_id", "contexts", "answer", "source", "coverage", "error")


QUERIES = {f.__name__: f for f in (job1_keyword_index, job2_evaluation)}

_WORDS = f"list_filter({T.tok('rest')}, lambda t: length(t) >= 6)"
_TRIES = " UNION ALL ".join(f"SELECT '{name}' AS experiment, {most} AS most" for name, most in EXPERIMENTS.items())

ORACLE_SQL = {
    "job1_keyword_index": f"""
        WITH w AS (SELECT doc_id, {T.tok('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, unnest(w) AS term, len(w) AS doc_length FROM w),
        tf AS (SELECT doc_id, term, CAST(count(*) AS INT) AS tf, doc_length FROM p GROUP BY ALL),
        df AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf)
        SELECT doc_id, doc_length, count(*) AS terms, sum(df)::BIGINT AS df_sum, sum(('0x' || substr(md5(term || ':' || tf), 1, 8))::BIGINT)::BIGINT AS entries_sum FROM df GROUP BY 1, 2
    """,
    "job2_evaluation": f"""
        WITH cases AS (SELECT item_id, substr(text, 1, length(text) // 2) AS text, substr(text, length(text) // 2 + 1) AS rest FROM benchmark),
        {T.BM25.replace('FROM benchmark', 'FROM cases')}, {T.SENTENCES},
        said AS (SELECT item_id, text, {_WORDS} AS a FROM cases),
        gold AS (SELECT item_id AS query_id, text AS query, list_transform(list_sort(list_transform(list_distinct(a), lambda x: list_position(a, x))), lambda i: a[i])[1:5] AS kw, list_distinct({T.tok('text')}) AS w FROM said),
        tries AS ({_TRIES}),
        c AS (SELECT experiment, b.query_id, b.rank, d.doc_id, d.text, d.source FROM btop b JOIN tries ON rank <= most JOIN documents d ON d.doc_id = b.id),
        hit AS (SELECT experiment, c.query_id, rank, pos, sentence, source, len(list_intersect(w, {T.tok('sentence')})) AS hits FROM c JOIN gold USING (query_id) JOIN sentences USING (doc_id)),
        best AS (SELECT * FROM hit WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY experiment, query_id ORDER BY hits DESC, rank, pos) = 1),
        told AS (SELECT experiment, query_id, count(*) AS contexts, string_agg(text, chr(0)) AS t FROM c GROUP BY ALL),
        all_of AS (SELECT t.experiment, g.query_id, g.query, g.kw, coalesce(contexts, 0) AS contexts, coalesce(sentence, '{NO_ANSWER}') AS answer, source,
            lower(concat(g.query, chr(0), told.t, chr(0), coalesce(sentence, '{NO_ANSWER}'))) AS seen
            FROM gold g CROSS JOIN tries t LEFT JOIN told ON told.experiment = t.experiment AND told.query_id = g.query_id LEFT JOIN best ON best.experiment = t.experiment AND best.query_id = g.query_id)
        SELECT experiment, query_id, contexts, answer, source, CASE WHEN len(kw) > 0 THEN round(len(list_filter(kw, lambda k: contains(seen, k))) / len(kw), 6) ELSE 0 END AS coverage,
            CASE WHEN coalesce(length(query), 0) = 0 THEN 'no question' END AS error FROM all_of
    """,
}

