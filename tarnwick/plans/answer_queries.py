"""Queries on prompts, answers, traces and alignment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer as A
from ..operators import evaluate as E
from ..operators import understand as U
from . import retrieve as P
from . import search_queries as S
from . import tables as T
from .text_queries import _ALIASES, _CLASS, _CODE, _MIXED, _mixed

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tokens_of(c: str) -> str:
    wide = f"length(regexp_replace({c}, '[\\x00-\\x7F]', '', 'g'))"
    return f"CASE WHEN {c} = '' THEN 0 ELSE greatest(1, floor((length({c}) - {wide}) * 0.3::DOUBLE + {wide} * 1.5::DOUBLE))::BIGINT END"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_SHOWN = "'[来源: ' || source || ']' || chr(10) || '[vector_similarity: ' || format('{:.4f}', (doc_id / 8)::DOUBLE) || ']' || chr(10) || text"
_TOLD = "CASE WHEN role = 'assistant' THEN text || chr(10) || '<details>steps' || chr(10) || '</details>' || chr(10) || '---' || chr(10) || '📎 **参考来源**' || chr(10) || '- x' ELSE text END"


def _requests(spark, d):
    """Benchmark questions, each with three documents as contexts and the conversation of its number."""
    doc, asked = T.load(spark, d, "documents"), T.questions(spark, d)
    three = asked.select("query_id", F.posexplode(F.sequence(F.col("query_id") * 3, F.col("query_id") * 3 + 2)).alias("ctx_pos", "doc_id"))
    found = three.join(doc, "doc_id")
    shown = X.evidence(F.col("source"), F.array().cast("array<string>"), F.create_map().cast("map<string,double>"), F.lit("vector_similarity"), F.col("doc_id") / 8, F.col("text"))
    told = F.when(F.col("role") == "assistant", F.concat(F.col("text"), F.lit("\n<details>steps\n</details>\n---\n📎 **参考来源**\n- x"))).otherwise(F.col("text"))
    history = T.load(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", told.alias("text"))
    return asked, found.select("query_id", "ctx_pos", "source", "text", shown.alias("evidence")), history


_ASKED = f"""ctx AS (SELECT item_id AS query_id, string_agg({_SHOWN.replace('text', 'd.text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS told FROM benchmark b JOIN documents d ON doc_id // 3 = item_id GROUP BY 1),
    req AS (SELECT item_id AS query_id, {quoted(A.BEFORE_EVIDENCE)} || coalesce(told, '') || {quoted(A.BEFORE_QUESTION)} || text AS last FROM benchmark LEFT JOIN ctx ON query_id = item_id),
    bud AS (SELECT *, 32000 - 2048 - 500 - ({tokens_of(quoted(A.SYSTEM))}) - ({tokens_of('last')}) AS budget FROM req),
    his AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(told, '\\n*---\\n📎 \\*\\*参考来源\\*\\*.*', '', 's'), '\\n*<details>.*?</details>', '', 'gs'), '[\\s\\x{{0b}}]+$', '') AS body
        FROM (SELECT *, {_TOLD} AS told FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)),
    cost AS (SELECT h.*, budget, sum({tokens_of('body')}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM his h JOIN bud ON query_id = conv_id WHERE trim(body) <> ''),
    kept AS (SELECT conv_id AS query_id, string_agg(role || '=' || body, '|' ORDER BY turn) AS lines, count(*) AS n FROM cost WHERE used <= budget GROUP BY 1)"""


@query(f"WITH {_ASKED} SELECT query_id, budget::BIGINT AS history_budget, (2 + coalesce(n, 0))::INT AS n_messages, md5(concat_ws('|', 'system=' || {quoted(A.SYSTEM)}, lines, 'user=' || last)) AS digest FROM bud LEFT JOIN kept USING (query_id)")
def prompt_messages(spark, d):
    asked, contexts, history = _requests(spark, d)
    m = A.prompt_messages(asked, contexts, history)
    lines = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|")
    return m.select("query_id", F.col("history_budget").cast("long").alias("history_budget"), F.size("messages").alias("n_messages"), F.md5(lines).alias("digest"))


@query(f"""WITH {T.SENTENCES}, asked AS (SELECT item_id AS query_id, list_distinct({T.tok('text')}) AS w FROM benchmark),
    hit AS (SELECT query_id, doc_id, pos, sentence, source, len(list_intersect(w, {T.tok('sentence')})) AS hits FROM asked JOIN sentences ON doc_id // 3 = query_id JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
    best AS (SELECT * FROM hit WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id, pos) = 1)
    SELECT query_id, coalesce(sentence, {quoted(A.NO_ANSWER)}) AS answer, source FROM asked LEFT JOIN best USING (query_id)""")
def extractive_answer(spark, d):
    asked, contexts, _ = _requests(spark, d)
    return A.extract_answers(asked, contexts)


def _by_four(text: str):
    return (text[a : a + 4] for a in range(0, len(text), 4))


@query(f"""WITH {T.SENTENCES}, a AS (SELECT doc_id, sentence FROM sentences WHERE pos = 0), n AS (SELECT *, (length(sentence) + 11) // 12 AS n FROM a)
    SELECT doc_id, s::INT AS seq, md5(substr(sentence, 1, CAST(12 * s AS INT))) AS shown, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, unnest(generate_series(1, n)) AS s FROM n)""")
def answer_stream(spark, d):
    """First sentences as answers that come by four characters and are shown by ten at least."""
    first = T.load(spark, d, "documents").select("doc_id", F.try_element_at(X.sentences(F.col("text")), F.lit(1)).alias("sentence"))
    return A.stream_answers(first, "sentence", _by_four).select("doc_id", "seq", F.md5("shown").alias("shown"), "error")


_JSON = """CASE event_id % 5 WHEN 0 THEN '{"route": "global", "mode": "hybrid", "align_ms": 1.5, "rerank_active": true}' WHEN 1 THEN '{"mode": "bm25", "embed_ms": null, "parent_child_child_hits": 7}'
    WHEN 2 THEN '{"route_decision": "local", "mode": "", "original_query": "' || event_type || '", "align_triggered": false}' WHEN 3 THEN '{}' ELSE 'no json' END"""


@query(f"""WITH t AS (SELECT event_id, event_type, event_id % 5 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN 'global' WHEN 1 THEN 'bm25' ELSE 'local' END AS route_decision, CASE k WHEN 0 THEN 'hybrid' WHEN 1 THEN 'bm25' ELSE 'vector' END AS mode,
        CASE k WHEN 0 THEN 1.5 ELSE 0 END::DOUBLE AS align_ms, 0::DOUBLE AS embed_ms, k = 0 AS rerank_active, CASE k WHEN 1 THEN 7 ELSE 0 END AS parent_child_child_hits, CASE k WHEN 2 THEN event_type ELSE '' END AS original_query FROM t""")
def trace_roundtrip(spark, d):
    """Partial and broken traces read with their defaults, written, and read again."""
    rows = T.load(spark, d, "events").select("event_id", A.trace_from_json(F.expr(_JSON)).alias("t"))
    again = rows.select("event_id", A.trace_from_json(A.trace_to_json(F.col("t"))).alias("t"))
    return again.select("event_id", *[f"t.{n}" for n in ("route_decision", "mode", "align_ms", "embed_ms", "rerank_active", "parent_child_child_hits", "original_query")])


@query(S.SQL["retrieve_full"].replace("SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, pos)::INT AS ctx_pos, id::VARCHAR AS id, source, chunk_index::INT AS chunk_index, kind, score FROM fi", """, od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_index, pos) AS ctx_pos FROM fi)
    SELECT query_id, 'local' AS route_decision, 'hybrid' AS mode, true AS rerank_active, false AS parent_child_active, count(*)::INT AS n_contexts, string_agg(id::VARCHAR, ',' ORDER BY ctx_pos) AS ids FROM od GROUP BY 1"""))
def retrieve_trace(spark, d):
    """Contexts of a retrieval in one row with its trace."""
    rows = P.retrieve_with_trace(spark, d)
    return rows.select("query_id", "trace.route_decision", "trace.mode", "trace.rerank_active", "trace.parent_child_active", F.size("contexts").alias("n_contexts"), F.array_join(F.transform("contexts", lambda c: c["id"]), ",").alias("ids"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'a' || lang || 'b' WHEN 2 THEN '' ELSE 'xy' END AS content FROM documents""")
def content_flatten(spark, d):
    k = F.col("doc_id") % 4
    parts = F.to_json(F.array(F.struct(F.lit("a").alias("text")), F.struct(F.col("lang").alias("text")), F.struct(F.lit("b").alias("text"))))
    raw = F.when(k == 0, F.to_variant_object(F.struct(F.col("text").alias("t")))).when(k == 1, F.parse_json(parts)).when(k == 2, F.parse_json(F.lit("null"))).otherwise(F.parse_json(F.lit('["x", {"kind": 1}, "y"]')))
    raw = F.when(k == 0, F.try_variant_get(raw, "$.t", "variant")).otherwise(raw)
    return T.load(spark, d, "documents").select("doc_id", A.flatten_content(raw).alias("content"))


_REPLY = """CASE doc_id % 7 WHEN 0 THEN '{"should_expand": true, "confidence": 0.9, "expansions": [" one ", "two", "one", ""], "reason": "terms"}'
    WHEN 1 THEN '{"confidence": 0.8, "expansions": {"a": ["x", "y"], "b": "z", "c": 5}}' WHEN 2 THEN '{"should_expand": false, "confidence": 0.9, "expansions": ["x"]}'
    WHEN 3 THEN '{"confidence": 0.1, "expansions": ["x"]}' WHEN 4 THEN '{"confidence": 0.9, "expansions": []}' WHEN 5 THEN '{"confidence": 0.9, "expansions": ["x"], "search_query": " own "}' ELSE '[1]' END"""


@query(f"""WITH m AS (SELECT doc_id, {T.trimmed(_MIXED)} AS q FROM documents), a(i, j, canonical, alias) AS (VALUES {_ALIASES}),
    g AS (SELECT doc_id, q, CASE WHEN q = '' THEN 'empty_query' WHEN length(q) < 4 THEN 'too_short' WHEN {_CODE} THEN 'code_or_path_query'
        WHEN NOT EXISTS (SELECT 1 FROM a WHERE contains(lower(q), alias)) AND {_CLASS} <> 'mixed' THEN 'no_alignment_signal' END AS gate, {_CLASS} AS class FROM m),
    f AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN doc_id % 7 = 6 THEN 'invalid_payload' WHEN doc_id % 7 = 2 THEN 'model_declined' WHEN doc_id % 7 = 3 THEN 'low_confidence' WHEN doc_id % 7 = 4 THEN 'empty_expansion' END AS why, doc_id % 7 AS k FROM g),
    t AS (SELECT doc_id, count(*)::INT AS n FROM (SELECT DISTINCT doc_id, i FROM m JOIN a ON contains(lower(q), alias)) GROUP BY 1)
    SELECT doc_id, md5(CASE WHEN why IS NOT NULL THEN q WHEN k = 0 THEN q || ' one two' WHEN k = 1 THEN q || ' x y z' ELSE 'own' END) AS search, why IS NULL AS should_expand,
        CASE WHEN why IS NOT NULL THEN 0 WHEN k = 1 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN why IS NOT NULL THEN 'fallback' WHEN k = 0 THEN 'terms' ELSE 'aligned' END AS reason, why AS fallback_reason,
        CASE WHEN gate IN ('empty_query', 'too_short', 'code_or_path_query') THEN 'unknown' ELSE class END AS language, least(6, coalesce(n, 0))::INT AS n_terms,
        CASE WHEN why IS NOT NULL THEN '' WHEN k = 0 THEN 'one,two' WHEN k = 1 THEN 'x,y,z' ELSE 'x' END AS expansions FROM f LEFT JOIN t USING (doc_id)""")
def align_payload(spark, d):
    """Whole alignment results from replies of every kind."""
    rows = _mixed(spark, d).withColumn("q", X.strip(F.col("q"))).withColumn("v", F.try_parse_json(F.expr(_REPLY)))
    gate = X.align_gate(F.col("q"))
    early = F.when(gate != "gate_passed", gate).when(~F.schema_of_variant("v").startswith("OBJECT"), "invalid_payload")
    done = rows.select("doc_id", U.align_result(F.col("q"), gate, F.col("v"), early).alias("a"))
    return done.select("doc_id", F.md5("a.search_query").alias("search"), "a.should_expand", "a.confidence", "a.reason", "a.fallback_reason", "a.language", F.size("a.detected_terms").alias("n_terms"), F.array_join("a.expansions", ",").alias("expansions"))


@query("""WITH r AS (SELECT event_type AS experiment, round(avg(value), 4) AS relevance, round(max(value), 4) AS faithfulness, CASE WHEN event_type LIKE 'p%' THEN 'failed' END AS error FROM events GROUP BY 1),
    z AS (SELECT experiment, CASE WHEN error IS NULL THEN relevance ELSE 0 END AS relevance, CASE WHEN error IS NULL THEN faithfulness ELSE 0 END AS faithfulness, error FROM r)
    SELECT experiment, CASE WHEN error IS NOT NULL THEN rpad(experiment, 40, ' ') || ' [ERROR] ' || error ELSE rpad(experiment, 40, ' ') || ' ' || lpad(format('{:.4f}', relevance), 8, ' ') || ' ' || lpad(format('{:.4f}', faithfulness), 10, ' ')
        || CASE WHEN relevance > 0 AND relevance = (SELECT max(relevance) FROM z) THEN ' ★' ELSE '' END END AS line FROM z""")
def comparison_table(spark, d):
    """Lines of a comparison of experiments, the best marked, failed ones with their error."""
    r = T.load(spark, d, "events").groupBy(F.col("event_type").alias("experiment")).agg(F.round(F.avg("value"), 4).alias("relevance"), F.round(F.max("value"), 4).alias("faithfulness"))
    return E.comparison(r.withColumn("error", F.when(F.col("experiment").startswith("p"), "failed")))
