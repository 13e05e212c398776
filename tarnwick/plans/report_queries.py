"""Queries on aggregations, metrics and history, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import models
from . import tables as T

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STAGES = {"total": 1.0, "embed": 0.125, "search": 0.25, "align": 0.0625, "rerank": 0.1875, "generate": 0.375}


@query("SELECT count(*) AS total_requests, " + ", ".join(f"round(coalesce(avg(value * {w}::DOUBLE), 0), 4) AS avg_{s}_ms" for s, w in _STAGES.items()) + ", round(coalesce(quantile_cont(value * 1.0::DOUBLE, 0.95), 0), 4) AS p95_total_ms FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 200)")
def metrics_summary(spark, d):
    """Over the requests that the bounded history keeps."""
    kept = M.bounded(T.load(spark, d, "events"), "event_id")
    return M.summary(kept.select(*[(F.col("value") * F.lit(w)).alias(f"{s}_ms") for s, w in _STAGES.items()]))


@query("SELECT source, round(coalesce(avg(quality), 0), 4) AS quality, round(coalesce(avg(toxic), 0), 4) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def avg_skip_null(spark, d):
    j = T.load(spark, d, "documents").join(T.load(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(E.average(F.col("quality")).alias("quality"), E.average(F.col("toxic")).alias("toxic"))


@query(f"""WITH k AS (SELECT item_id, text, list_distinct(list_filter({T.tok('text')}, lambda t: length(t) >= 6)) AS u, list_filter({T.tok('text')}, lambda t: length(t) >= 6) AS a FROM benchmark),
    f AS (SELECT item_id, text, list_transform(list_sort(list_transform(u, lambda x: list_position(a, x))), lambda i: a[i])[1:5] AS kw FROM k)
    SELECT item_id AS query_id, CASE WHEN len(kw) > 0 THEN round(len(list_filter(kw, lambda w: contains(lower(d.text), w))) / len(kw), 6) ELSE 0 END AS coverage FROM f JOIN documents d ON d.doc_id = item_id""")
def keyword_coverage(spark, d):
    q = T.questions(spark, d).join(T.load(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), "query_id")
    return q.select("query_id", E.keyword_coverage(F.col("text"), E.expected_keywords(F.col("query"))).alias("coverage"))


@query("SELECT lang AS experiment, count(*) AS num_cases, count(quality) AS num_success, round(coalesce(avg(quality), 0), 4) AS avg_quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def eval_summary(spark, d):
    j = T.load(spark, d, "documents").join(T.load(spark, d, "labels"), "doc_id", "left")
    return j.groupBy(F.col("lang").alias("experiment")).agg(F.count("*").alias("num_cases"), F.count("quality").alias("num_success"), E.average(F.col("quality")).alias("avg_quality"))


@query("WITH s AS (SELECT event_type AS experiment, round(avg(value), 4) AS score FROM events GROUP BY 1) SELECT experiment, score, score > 0 AND score = (SELECT max(score) FROM s) AS best FROM s")
def best_marker(spark, d):
    s = T.load(spark, d, "events").groupBy(F.col("event_type").alias("experiment")).agg(F.round(F.avg("value"), 4).alias("score"))
    top = s.agg(F.max("score").alias("top"))
    return s.join(F.broadcast(top), (F.col("score") == F.col("top")) & (F.col("score") > 0), "left").select("experiment", "score", F.col("top").isNotNull().alias("best"))


@query(f"""WITH {T.TRIPLES}, c AS (SELECT chunk_id, count(*) AS n FROM triples GROUP BY 1), e AS (SELECT entity, count(*) AS n FROM (SELECT head AS entity FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1)
    SELECT (SELECT count(*) FROM triples) AS total_triples, (SELECT count(*) FROM c) AS unique_chunks, (SELECT round(avg(n), 6) FROM c) AS avg_per_chunk, (SELECT round(median(n), 6) FROM c) AS median_per_chunk,
    count(*) AS unique_entities, min(length(entity)) AS len_min, max(length(entity)) AS len_max, round(avg(length(entity)), 6) AS len_mean, count(*) FILTER (WHERE n = 1) AS singletons,
    round(count(*) FILTER (WHERE n = 1) / count(*), 6) AS singletons_pct, count(*) FILTER (WHERE regexp_matches(entity, '[^0-9A-Za-z_]')) AS non_alnum, round(count(*) FILTER (WHERE regexp_matches(entity, '[^0-9A-Za-z_]')) / count(*), 6) AS non_alnum_pct FROM e""")
def kg_stats(spark, d):
    t = T.triples(spark, d)
    c = t.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_triples"), F.count("*").alias("unique_chunks"), F.round(F.avg("n"), 6).alias("avg_per_chunk"), F.round(F.expr("percentile(n, 0.5)"), 6).alias("median_per_chunk"))
    size = F.length("entity")
    e = G.degrees(t).agg(F.count("*").alias("unique_entities"), F.min(size).alias("len_min"), F.max(size).alias("len_max"), F.round(F.avg(size), 6).alias("len_mean"), F.count_if(F.col("degree") == 1).alias("singletons"), F.count_if(F.col("entity").rlike(r"(?U)[^\w\x{4e00}-\x{9fff}]")).alias("non_alnum"))
    share = lambda n: F.round(F.coalesce(F.try_divide(n, "unique_entities"), F.lit(0.0)), 6).alias(f"{n}_pct")
    e = e.select("*", share("singletons"), share("non_alnum"))
    return c.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


@query(f"WITH {T.TRIPLES}, e AS (SELECT entity, count(*) AS degree FROM (SELECT head AS entity FROM triples UNION ALL SELECT tail FROM triples) GROUP BY 1) SELECT * FROM e ORDER BY degree DESC, entity LIMIT 20")
def kg_top_entities(spark, d):
    return G.degrees(T.triples(spark, d)).orderBy(F.desc("degree"), "entity").limit(20)


_REPLY = """r AS (SELECT event_id, event_type AS variant, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN 'no json' WHEN event_id % 7 = 3 THEN '{"a": 1}' WHEN event_id % 7 = 4 THEN '[]' ELSE 'ok' END AS c FROM events),
    o AS (SELECT event_id, variant, CASE WHEN event_id % 7 = 0 THEN 'exception' WHEN event_id % 7 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'reasoning_only' ELSE 'empty_content' END WHEN event_id % 7 = 2 THEN 'json_parse_error' WHEN event_id % 7 = 3 THEN 'non_list_payload' WHEN event_id % 7 = 4 THEN 'empty_triples_list' ELSE 'success' END AS outcome FROM r)"""


def _outcomes(spark, d):
    k = F.col("event_id")
    m = k % 7
    content = F.when(m == 1, "").when(m == 2, "no json").when(m == 3, '{"a": 1}').when(m == 4, '```json\n[]\n```').when(m == 5, '{"triples": [{"head": "a"}]}').when(m == 6, 'Sure: [{"head": "a"}]')
    rows = T.load(spark, d, "events").select(k, F.col("event_type").alias("variant"), F.when(m == 0, "timeout").alias("error"), content.alias("content"), F.when(k % 2 == 0, "because").alias("why"))
    return rows.select("event_id", "variant", X.outcome(F.col("error"), F.col("content"), F.col("why")).alias("outcome"))


@query(f"WITH {_REPLY} SELECT variant, outcome, count(*) AS n FROM o GROUP BY 1, 2")
def outcome_counts(spark, d):
    return _outcomes(spark, d).groupBy("variant", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {_REPLY} SELECT outcome, event_id, row_number() OVER (PARTITION BY outcome ORDER BY event_id)::INT AS n FROM o WHERE outcome <> 'success' QUALIFY n <= 5")
def examples_per_group(spark, d):
    return M.first_per_group(_outcomes(spark, d).where("outcome <> 'success'"), "outcome", "event_id").select("outcome", "event_id", "n")


def _extractor(prompts: list[str]) -> list[str]:
    """A stub that likes short prompts and lists less than objects."""
    if any(p.startswith("List") and len(p) % 11 == 0 for p in prompts):
        raise OSError("overloaded")
    replies = ['[{"head": "a", "relation": "b", "tail": "c"}]', "[]", "no json", '{"content": "", "reasoning": "because"}', '{"a": 1}']
    return [replies[0] if len(p) % 7 > 4 else replies[len(p) % 7] for p in prompts]


_VARIANTS = {"list": "List the triples of: ", "object": "As an object, the triples of: "}


@query(f"""WITH v(variant, lead) AS (VALUES {', '.join(f"('{k}', '{t}')" for k, t in _VARIANTS.items())}), p AS (SELECT variant, lead, item_id, length(lead || coalesce(text, '')) AS n FROM benchmark CROSS JOIN v),
    o AS (SELECT variant, item_id, CASE WHEN variant = 'list' AND n % 11 = 0 THEN 'exception' WHEN n % 7 > 4 OR n % 7 = 0 THEN 'success' WHEN n % 7 = 1 THEN 'empty_triples_list' WHEN n % 7 = 2 THEN 'json_parse_error' WHEN n % 7 = 3 THEN 'reasoning_only' ELSE 'non_list_payload' END AS outcome FROM p)
    SELECT variant, outcome, count(*) AS n, CASE WHEN outcome = 'success' THEN '' ELSE array_to_string(list_sort(list(item_id))[1:5], ',') END AS examples FROM o GROUP BY 1, 2""")
def prompt_comparison(spark, d):
    """Two ways to ask for triples, over all benchmark texts, by a stub model."""
    made = {k: (lambda t, lead=lead: F.concat(F.lit(lead), F.coalesce(t, F.lit("")))) for k, lead in _VARIANTS.items()}
    got = models.compare_prompts(T.load(spark, d, "benchmark"), _extractor, made, wait=0)
    return models.prompt_summary(got, "item_id").withColumn("examples", F.array_join("examples", ","))


_CONTEXTS = """c AS (SELECT doc_id AS pos, lang, source, CASE doc_id % 4 WHEN 0 THEN [source, ' ' || lang || ' ', ''] WHEN 1 THEN [] END AS sources, CASE WHEN doc_id % 3 > 0 THEN 'kind' || doc_id % 3 END AS score_type, CASE WHEN doc_id % 5 > 0 THEN (n_chars % 50)::DOUBLE END AS score FROM documents),
    n AS (SELECT pos, coalesce(score, 0) AS score, coalesce(score_type, 'unknown') AS score_type, unnest(CASE WHEN len(sources) > 0 THEN sources ELSE [source] END) AS name, generate_subscripts(CASE WHEN len(sources) > 0 THEN sources ELSE [source] END, 1) AS spot FROM c),
    b AS (SELECT trim(name) AS source, first(score_type ORDER BY score DESC, pos, spot) AS score_type, max(score) AS score, min(pos) AS first_pos FROM n WHERE trim(name) <> '' GROUP BY 1)"""


def _contexts(spark, d):
    k = F.col("doc_id")
    sources = F.when(k % 4 == 0, F.array(F.col("source"), F.concat(F.lit(" "), F.col("lang"), F.lit(" ")), F.lit(""))).when(k % 4 == 1, F.array().cast("array<string>"))
    return T.load(spark, d, "documents").select(k.alias("pos"), "source", sources.alias("sources"), F.when(k % 3 > 0, F.concat(F.lit("kind"), (k % 3).cast("string"))).alias("score_type"), F.when(k % 5 > 0, (F.col("n_chars") % 50).cast("double")).alias("score"))


@query(f"WITH {_CONTEXTS} SELECT source, score_type, score, first_pos FROM b")
def source_block(spark, d):
    return M.source_block(_contexts(spark, d)).drop("first_at")


@query(f"""WITH {_CONTEXTS.replace('min(pos) AS first_pos', 'min(pos * 10 + spot) AS first_pos')} SELECT '---' || chr(10) || '📎 **参考来源**' || chr(10) || string_agg('- ' || source || ' <span style="color:#6c7086;font-size:0.82em">[' || score_type || '] ' || format('{{:.4f}}', score) || '</span>', chr(10) ORDER BY first_pos) AS text FROM b""")
def source_lines(spark, d):
    return M.source_text(M.source_block(_contexts(spark, d)))


@query("WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(n / (SELECT max(n) FROM s), 6) AS share FROM s")
def chart_scale(spark, d):
    s = T.load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    top = s.agg(F.max("n").alias("top")).withColumn("k", F.lit(1))
    return s.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").select("event_type", F.round(F.col("n") / F.col("top"), 6).alias("share"))


@query("SELECT event_id, CASE WHEN length(props) > 38 THEN substr(props, 1, 38) || '...' ELSE props END AS preview FROM events ORDER BY event_id DESC LIMIT 20")
def recent_requests(spark, d):
    return M.bounded(T.load(spark, d, "events"), "event_id", 20).select("event_id", X.truncate(F.col("props"), 38, "...").alias("preview"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200")
def bounded_history(spark, d):
    return M.bounded(T.load(spark, d, "events"), "event_id").select("event_id", "user_id")
