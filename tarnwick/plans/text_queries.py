"""Queries on sources, segmentation and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunker as C
from ..operators import segment as S
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


@query("SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def scan_corpus(spark, d):
    return T.load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def doc_fingerprint(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


@query("""WITH old AS (SELECT doc_id AS old_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS old_md5 FROM documents WHERE doc_id % 10 <> 0),
    new AS (SELECT doc_id, md5(text) AS md5 FROM documents)
    SELECT doc_id, CASE WHEN old_id IS NULL THEN 'added' WHEN md5 <> old_md5 THEN 'changed' ELSE 'unchanged' END AS state FROM new LEFT JOIN old ON doc_id = old_id""")
def incremental_diff(spark, d):
    from ..sources.collection import changes

    new = T.load(spark, d, "documents")
    old = new.where("doc_id % 10 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    key = lambda x: x.select("doc_id", F.md5("text").alias("md5"))
    return changes(key(old), key(new), "doc_id")


@query("""WITH v AS (SELECT doc_id AS id, 0 AS version, text FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 1, text || '!' FROM documents WHERE doc_id % 2 = 0)
    SELECT id, version, md5(text) AS md5 FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def upsert_latest(spark, d):
    from ..sources.collection import upsert

    docs = T.load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    old = docs.where("id % 3 <> 0").withColumn("version", F.lit(0))
    new = docs.where("id % 2 = 0").select("id", F.concat("text", F.lit("!")).alias("text"), F.lit(1).alias("version"))
    return upsert(old, new, "id").select("id", "version", F.md5("text").alias("md5"))


@query("SELECT doc_id, source FROM documents")
def scan_project(spark, d):
    return T.load(spark, d, "documents").select("doc_id", "source")


@query("SELECT item_id AS request, doc_id, lang FROM benchmark JOIN documents ON doc_id = item_id * 7")
def lookup_ids(spark, d):
    ids = T.load(spark, d, "benchmark").select(F.col("item_id").alias("request"), (F.col("item_id") * 7).alias("doc_id"))
    return ids.join(T.load(spark, d, "documents"), "doc_id").select("request", "doc_id", "lang")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 20")
def sample_chunks(spark, d):
    return T.load(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(20)


@query(f"WITH {T.SENTENCES} SELECT doc_id, pos::INT AS pos, sentence FROM sentences")
def sentence_split(spark, d):
    return S.split_sentences(T.load(spark, d, "documents"))


def _vectors(spark, d):
    """(doc, pos, dim, val) from the embeddings: eight vectors in a row make a document."""
    e = T.load(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).alias("doc"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))


@query("""WITH v AS (SELECT vec_id // 8 AS doc, vec_id % 8 AS pos, unnest(embedding)::DOUBLE AS val, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
    m AS (SELECT doc, pos, dim, avg(val) OVER (PARTITION BY doc, dim ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS val FROM v)
    SELECT doc, pos::INT AS pos, dim::INT AS dim, round(val / sqrt(sum(val * val) OVER (PARTITION BY doc, pos)), 6) AS val FROM m""")
def windowed_smooth(spark, d):
    long = _vectors(spark, d).select("doc", "pos", F.posexplode("vec").alias("dim", "val"))
    return S.smooth(long).select("doc", "pos", "dim", F.round("val", 6).alias("val"))


_SIMS = """v AS (SELECT vec_id // 8 AS doc, vec_id % 8 AS pos, embedding::DOUBLE[] AS vec FROM embeddings),
    a AS (SELECT doc, pos, vec, lead(vec) OVER (PARTITION BY doc ORDER BY pos) AS after FROM v),
    sims AS (SELECT doc, pos::INT AS pos, round(list_inner_product(vec, after), 6) AS sim FROM a WHERE after IS NOT NULL),
    cuts AS (SELECT s.doc, pos FROM sims s JOIN (SELECT doc, quantile_cont(sim, 0.85) AS th FROM sims GROUP BY 1) t ON s.doc = t.doc WHERE sim < th)"""


def _sims(spark, d):
    return S.adjacent(_vectors(spark, d)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {_SIMS} SELECT * FROM sims")
def adjacent_sims(spark, d):
    return _sims(spark, d)


@query(f"WITH {_SIMS} SELECT * FROM cuts")
def breakpoints(spark, d):
    return S.breakpoints(_sims(spark, d))


@query(f"WITH RECURSIVE {T.FENCED}, {T.semantic('fenced', 80, 1200)} SELECT doc_id AS doc, pos::INT AS pos, sim FROM sent JOIN gap USING (doc_id, pos)".replace("WHERE s.n >= 3 AND s.pos < s.n - 1", "WHERE s.pos < s.n - 1").replace("FROM sent WHERE n >= 3)", "FROM sent)"))
def sentence_sims(spark, d):
    return C.sentence_sims(T.fenced(spark, d))


@query(f"""WITH RECURSIVE {T.FENCED}, {T.semantic('fenced', 80, 1200).replace("CASE WHEN s.n >= 3 AND (", "CASE WHEN s.n >= 1 AND (")}
    SELECT doc_id AS doc, island::INT AS chunk, string_agg(text, ' ' ORDER BY pos) AS text, count(*)::INT AS n, bool_and(is_code) AS is_code, CASE WHEN bool_and(is_code) THEN arg_min(lang, pos) END AS code_language FROM isl GROUP BY doc_id, island""")
def build_chunks(spark, d):
    """Sentences up to each breakpoint of their own vectors, before merging and halving."""
    return C.sentence_chunks(T.fenced(spark, d))


@query(f"""WITH RECURSIVE {T.SENTENCES}, fold AS (
      SELECT doc_id, s, 1 AS i, [s[1]] AS acc FROM pieces WHERE len(s) > 0
      UNION ALL SELECT doc_id, s, i + 1, CASE WHEN length(acc[-1]) < 80 THEN list_append(acc[1:len(acc) - 1], acc[-1] || ' ' || s[i + 1]) ELSE list_append(acc, s[i + 1]) END FROM fold WHERE i < len(s))
    SELECT doc_id, len(acc)::INT AS pieces, md5(array_to_string(acc, '|')) AS digest FROM fold WHERE i = len(s)""")
def merge_small(spark, d):
    rows = T.load(spark, d, "documents").select("doc_id", S.merge_small(X.sentences(F.col("text")), 80).alias("m")).where("size(m) > 0")
    return rows.select("doc_id", F.size("m").alias("pieces"), F.md5(F.array_join("m", "|")).alias("digest"))


@query(f"WITH RECURSIVE {T.FENCED}, {T.semantic('fenced', 80, 1200)} SELECT doc_id, chunk_index::INT AS chunk_index, text, is_code, code_language FROM semantic")
def semantic_chunks(spark, d):
    """Text to chunks in one operator, fenced code kept whole."""
    return C.semantic_chunks(T.fenced(spark, d), ["doc_id"]).drop("chunker")


@query("SELECT doc_id, i::INT AS i, substr(text, i * 400 + 1, 400) AS piece FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, (length(text) - 1) // 400))) AS i FROM documents)")
def hard_slice(spark, d):
    return T.load(spark, d, "documents").select("doc_id", F.posexplode(S.hard_slices(F.col("text"), 400)).alias("i", "piece"))


@query()
def recursive_split(spark, d):
    return S.recursive_split(T.load(spark, d, "documents"))


_SECTIONS = f"""{T.MARKDOWN}, cutmd AS (SELECT source, string_split(regexp_replace(text, '(^|\\n)(#{{1,3}}\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM md),
    sec AS (SELECT source, list_filter(list_transform(p, lambda x: {T.trimmed('x')}), lambda x: length(x) > 0) AS s FROM cutmd)"""


@query(f"WITH {_SECTIONS} SELECT source, len(s)::INT AS sections, md5(array_to_string(s, '|')) AS digest FROM sec")
def heading_split(spark, d):
    rows = T.markdown(spark, d).select("source", X.heading_sections(F.col("text")).alias("s"))
    return rows.select("source", F.size("s").alias("sections"), F.md5(F.array_join("s", "|")).alias("digest"))


_PARENTS = f"""{_SECTIONS}, pfold AS (
      SELECT source, s, 1 AS i, [s[1]] AS acc FROM sec
      UNION ALL SELECT source, s, i + 1, CASE WHEN length(acc[-1]) < 500 THEN list_append(acc[1:len(acc) - 1], acc[-1] || chr(10) || chr(10) || s[i + 1]) ELSE list_append(acc, s[i + 1]) END FROM pfold WHERE i < len(s)),
    par AS (SELECT source, regexp_replace(replace(source, '/', '_'), '\\.[^._]+$', '') AS stem, unnest(acc) AS text, generate_subscripts(acc, 1) - 1 AS parent_index FROM pfold WHERE i = len(s)),
    sections AS (SELECT stem || '_parent_' || parent_index AS doc_id, text FROM par)"""


@query(f"""WITH RECURSIVE {_PARENTS}, {T.semantic('sections', 80, 400)}
    SELECT stem || '_child_' || parent_index || '_' || chunk_index AS child_id, doc_id AS parent_id, parent_index::INT AS parent_index, chunk_index::INT AS child_index, source, c.text, is_code, code_language
    FROM semantic c JOIN par ON doc_id = stem || '_parent_' || parent_index""")
def parent_child(spark, d):
    return C.children(C.parents(T.markdown(spark, d)))


@query(f"""WITH RECURSIVE {_PARENTS}, {T.semantic('sections', 80, 400)}, n AS (SELECT doc_id, count(*)::INT AS child_count FROM semantic GROUP BY 1)
    SELECT doc_id AS parent_id, source, parent_index::INT AS parent_index, md5(text) AS digest, coalesce(child_count, 0) AS child_count,
        (starts_with(text, '```') AND ends_with(text, '```') AND len(string_split(text, '```')) = 3) AS is_code FROM par LEFT JOIN n ON doc_id = stem || '_parent_' || parent_index""".replace("SELECT doc_id AS parent_id, source", "SELECT stem || '_parent_' || parent_index AS parent_id, source"))
def parent_table(spark, d):
    p = C.parents(T.markdown(spark, d))
    return C.with_child_count(p, C.children(p)).select("parent_id", "source", "parent_index", F.md5("text").alias("digest"), "child_count", "is_code")


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```py' || chr(10) || text || chr(10) || '```' WHEN 1 THEN 'see ```py' || chr(10) || text || chr(10) || '```'
      WHEN 2 THEN ' ```' || chr(10) || text || chr(10) || '``` ' ELSE '```a' || chr(10) || text || '```' || text || '```b' || chr(10) || '```' END AS t FROM documents)
    SELECT doc_id, t LIKE '%```' AND t LIKE '```%' AND len(t) - len(replace(t, '```', '')) = 6 AS whole_code FROM (SELECT doc_id, trim(t) AS t FROM s)""")
def parent_is_code(spark, d):
    k, t, nl, mark = F.col("doc_id") % 4, F.col("text"), F.lit("\n"), F.lit("```")
    shown = (
        F.when(k == 0, F.concat(F.lit("```py\n"), t, nl, mark)).when(k == 1, F.concat(F.lit("see ```py\n"), t, nl, mark))
        .when(k == 2, F.concat(F.lit(" ```\n"), t, nl, F.lit("``` "))).otherwise(F.concat(F.lit("```a\n"), t, mark, t, F.lit("```b\n```")))
    )
    return T.load(spark, d, "documents").select("doc_id", S.is_code_only(shown).alias("whole_code"))


@query("SELECT doc_id, replace(source, 'src', 'a_src') || '_' || (doc_id % 5) AS chunk_id FROM documents")
def chunk_id(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.chunk_id(F.concat(F.lit("a/"), F.col("source"), F.lit(".md")), F.col("doc_id") % 5).alias("chunk_id"))


@query(f"SELECT doc_id, regexp_replace(lower({T.trimmed('text')}), '{T.WS}+', ' ', 'g') AS normal FROM documents")
def normalize_text(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))


_MIXED = "CASE WHEN doc_id % 4 = 0 THEN '检索' || text WHEN doc_id % 4 = 1 THEN '检索增强' WHEN doc_id % 4 = 2 THEN '12' WHEN doc_id % 8 = 3 THEN 'rag ' || lang ELSE text END"


def _mixed(spark, d):
    k = F.col("doc_id")
    q = F.when(k % 4 == 0, F.concat(F.lit("检索"), F.col("text"))).when(k % 4 == 1, "检索增强").when(k % 4 == 2, "12").when(k % 8 == 3, F.concat(F.lit("rag "), F.col("lang"))).otherwise(F.col("text"))
    return T.load(spark, d, "documents").select("doc_id", q.alias("q"))


_CLASS = r"""CASE WHEN regexp_matches(q, '[\x{4e00}-\x{9fff}]') AND regexp_matches(q, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(q, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(q, '[A-Za-z]') THEN 'en' ELSE 'unknown' END"""
_CODE = r"""(regexp_matches(lower(q), 'https?://|\\|/|::') OR contains(lower(q), 'def ') OR contains(lower(q), 'class ') OR contains(lower(q), 'import ') OR contains(lower(q), 'lambda ') OR contains(lower(q), 'function('))"""
_ALIASES = ", ".join(f"({i}, {j}, '{c}', '{a}')" for i, (c, aliases) in enumerate(X.TERMS) for j, a in enumerate(aliases))


@query(f"SELECT doc_id, {_CLASS} AS class FROM (SELECT doc_id, {_MIXED} AS q FROM documents)")
def detect_language(spark, d):
    return _mixed(spark, d).select("doc_id", X.language_class(F.col("q")).alias("class"))


@query(f"SELECT doc_id, {_CODE} AS code FROM (SELECT doc_id, text AS q FROM documents)")
def code_or_path(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.code_or_path(F.col("text")).alias("code"))


@query(f"""WITH m AS (SELECT doc_id, {T.trimmed(_MIXED)} AS q FROM documents), a(i, j, canonical, alias) AS (VALUES {_ALIASES})
    SELECT doc_id, CASE WHEN q = '' THEN 'empty_query' WHEN length(q) < 4 THEN 'too_short' WHEN {_CODE} THEN 'code_or_path_query'
        WHEN NOT EXISTS (SELECT 1 FROM a WHERE contains(lower(q), alias)) AND {_CLASS} <> 'mixed' THEN 'no_alignment_signal' ELSE 'gate_passed' END AS gate FROM m""")
def align_gate(spark, d):
    return _mixed(spark, d).select("doc_id", X.align_gate(F.col("q")).alias("gate"))


@query(f"""WITH m AS (SELECT doc_id, lower({_MIXED}) AS q FROM documents), a(i, j, canonical, alias) AS (VALUES {_ALIASES}),
    h AS (SELECT doc_id, i, canonical, alias, row_number() OVER (PARTITION BY doc_id, i ORDER BY j) AS r, dense_rank() OVER (PARTITION BY doc_id ORDER BY i) AS t FROM m JOIN a ON contains(q, alias))
    SELECT doc_id, canonical, string_agg(alias, ',' ORDER BY r) AS aliases FROM h WHERE r <= 3 AND t <= 6 GROUP BY 1, 2""")
def alias_match(spark, d):
    from ..operators.understand import detected_terms

    return detected_terms(_mixed(spark, d), "doc_id", "q")


@query("SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE greatest(1, floor((length(text) - w) * 0.3::DOUBLE + w * 1.5::DOUBLE))::BIGINT END AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS w FROM documents)")
def token_estimate(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '...' ELSE text END AS shown FROM documents")
def truncate_text(spark, d):
    return T.load(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 800, "...").alias("shown"))


@query("""SELECT doc_id, concat_ws(chr(10), '[来源: ' || source || ']', '[通道: bm25, vector]', '[raw_scores: bm25=' || format('{:.4f}', n_chars::DOUBLE) || ', vector=' || format('{:.4f}', (doc_id / 8)::DOUBLE) || ']', '[rrf: ' || format('{:.4f}', (doc_id / 4)::DOUBLE) || ']',
    CASE WHEN doc_id % 2 = 0 THEN '[raw_rerank_logit: ' || format('{:.4f}', (doc_id / 16)::DOUBLE) || ']' END, '[metadata: {''lang'': ''' || lang || ''', ''chunk_index'': ' || (doc_id % 5) || '}]', text) AS evidence FROM documents""")
def evidence_chain(spark, d):
    k = F.col("doc_id")
    scores = F.create_map(F.lit("vector"), k / 8, F.lit("bm25"), F.col("n_chars").cast("double"))
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("score_type"), F.lit("rrf"), F.lit("chunk_index"), (k % 5).cast("string"))
    chain = X.evidence(F.col("source"), F.array(F.lit("bm25"), F.lit("vector")), scores, F.lit("rrf"), k / 4, F.col("text"), F.when(k % 2 == 0, k / 16), meta)
    return T.load(spark, d, "documents").select("doc_id", chain.alias("evidence"))


@query(f"SELECT doc_id, count(*) AS n_tokens, count(DISTINCT t) AS n_distinct FROM (SELECT doc_id, unnest({T.tok('text')}) AS t FROM documents) GROUP BY 1")
def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return T.load(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct")).where("n_tokens > 0")


@query("""WITH c AS (SELECT *, CASE role WHEN 'user' THEN text ELSE text END AS body FROM conversations WHERE role IN ('user', 'assistant')),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM c QUALIFY r <= 6),
    t AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE greatest(1, floor((length(body) - w) * 0.3::DOUBLE + w * 1.5::DOUBLE)) END::BIGINT AS cost FROM (SELECT *, length(regexp_replace(body, '[\\x00-\\x7F]', '', 'g')) AS w FROM k WHERE trim(body) <> '')),
    s AS (SELECT conv_id, turn, role, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM t)
    SELECT conv_id, turn, role, cost FROM s WHERE used <= 400""")
def history_budget(spark, d):
    from ..operators.understand import budgeted_history

    return budgeted_history(T.load(spark, d, "conversations")).select("conv_id", "turn", "role", "cost")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_turns_gen(spark, d):
    from ..operators.understand import last_turns

    return last_turns(T.load(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role IN ('user', 'assistant'))
    SELECT conv_id, turn, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 * least(n // 2, 3)""")
def last_turns_rewrite(spark, d):
    from ..operators.understand import last_whole_turns

    return last_whole_turns(T.load(spark, d, "conversations")).select("conv_id", "turn", "role")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM (SELECT * FROM conversations WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1""")
def prompt_messages(spark, d):
    from ..operators.understand import last_turns

    rows = last_turns(T.load(spark, d, "conversations")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("m")))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["m"]), "\n").alias("prompt"))


_ = Window
