"""Inputs the queries derive from the star-schema tables, alike in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for work on every word.  A table of fewer bytes than would give each core a split is dealt out
    first; a large one is scanned in many splits and gets no exchange."""
    d, cores = load(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    split = jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return d.repartition(cores) if size < cores * split else d


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, head, relation, tail, source, chunk_id) from customers, suppliers, nations and regions; their keys, modulo
    the number of documents, stand for the documents they come from."""
    t = lambda n: load(spark, sf_dir, n)
    nation, total = t("nation"), max(1, t("documents").count())

    def rows(df, head, relation, tail, kind, key, base):
        return df.select((F.col(key).cast("long") + base).alias("seq"), F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), F.lit(kind).alias("source"), F.concat(F.lit(kind + "_"), (F.col(key).cast("long") % total).cast("string")).alias("chunk_id"))

    return (
        rows(t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "located_in", "n_name", "customer", "c_custkey", 10**12)
        .unionByName(rows(nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "part_of", "r_name", "nation", "n_nationkey", 0))
        .unionByName(rows(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "located_in", "n_name", "supplier", "s_suppkey", 2 * 10**12))
    )


TRIPLES = """
    triples AS (
      SELECT c_custkey::BIGINT + 1000000000000 AS seq, c_name AS head, 'located_in' AS relation, n_name AS tail, 'customer' AS source, 'customer_' || (c_custkey % (SELECT greatest(1, count(*)) FROM documents)) AS chunk_id
      FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT n_nationkey::BIGINT, n_name, 'part_of', r_name, 'nation', 'nation_' || (n_nationkey % (SELECT greatest(1, count(*)) FROM documents)) FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT s_suppkey::BIGINT + 2000000000000, s_name, 'located_in', n_name, 'supplier', 'supplier_' || (s_suppkey % (SELECT greatest(1, count(*)) FROM documents)) FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, text, source): documents as the chunks that the derived triples come from, by any of their kinds."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("customer", "nation", "supplier")])).alias("kind")
    return load(spark, sf_dir, "documents").select(kinds, "doc_id", "text", "source").select(F.concat_ws("_", "kind", "doc_id").alias("chunk_id"), "text", "source")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source, chunk_index, text): ten documents make a note."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("note/n"), F.floor(F.col("doc_id") / 10).cast("string"), F.lit(".md")).alias("source"), (F.col("doc_id") % 10).cast("int").alias("chunk_index"), "text")


NOTES = "notes AS (SELECT doc_id AS id, 'note/n' || (doc_id // 10) || '.md' AS source, CAST(doc_id % 10 AS INT) AS chunk_index, text FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): every benchmark text."""
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def mentions(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, query) for the graph: the questions name none of its entities, so the first three words of each stand
    before a nation's name or the number of a customer and a supplier, by turns."""
    from ..functions import text as X

    q = questions(spark, sf_dir) if asked is None else asked
    nation = load(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    name = F.when(F.col("query_id") % 2 == 0, F.col("n")).otherwise(F.lpad((F.col("query_id") % 100).cast("string"), 9, "0"))
    words = F.slice(X.tokens(F.col("query")), 1, 3)
    return q.join(F.broadcast(nation), F.col("query_id") % 25 == F.col("n_nationkey")).select("query_id", F.array_join(F.concat(words, F.array(name)), " ").alias("query"))  # 25 nations


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


TOK = r"regexp_extract_all(regexp_replace(lower(coalesce({c}, '')), '([\x{{4e00}}-\x{{9fff}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


def tok(c: str) -> str:
    return TOK.format(c=c)


#: A trimmed text, as Java's Unicode white space has it.
WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0b}]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


SENTENCES = f"""
    cutted AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '([。！？!?])', '\\1' || chr(1), 'g'), '(\\n\\n)', '\\1' || chr(1), 'g'), '(\\n)(#{{1,6}} )', '\\1' || chr(1) || '\\2', 'g'),
        '([.!?])([ \\t][A-Z])', '\\1' || chr(1) || '\\2', 'g') AS t FROM documents),
    pieces AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: {trimmed('x')}), lambda x: length(x) >= 5) AS s FROM cutted),
    sentences AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM pieces)"""

VECTORS = f"""
    dterm AS (SELECT doc_id AS id, unnest({tok('text')}) AS t FROM documents),
    qterm AS (SELECT item_id AS query_id, unnest({tok('text')}) AS t FROM benchmark),
    dcount AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS tf FROM dterm GROUP BY ALL),
    qcount AS (SELECT query_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS tf FROM qterm GROUP BY ALL),
    dvec AS (SELECT id, dim, tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)) AS w FROM dcount),
    qvec AS (SELECT query_id, dim, tf / sqrt(sum(tf * tf) OVER (PARTITION BY query_id)) AS w FROM qcount),
    vscore AS (SELECT query_id, id, round(2 * sum(d.w * q.w) - 1, 6) AS score FROM dvec d JOIN qvec q USING (dim) GROUP BY ALL),
    vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vscore QUALIFY rank <= 10)"""

def unit_vectors(name: str, source: str, key: str, text: str) -> str:
    """The default embedding of ``source`` in long form as the CTE ``name`` (key, dim, w)."""
    return f"""{name}_c AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS tf FROM (SELECT {key}, unnest({tok(text)}) AS t FROM {source}) GROUP BY ALL),
    {name} AS (SELECT {key}, dim, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS w FROM {name}_c)"""


#: Entities of ``triples`` that the graph's questions mean, by the first of three ways: (query_id, entity, way).
LINKED = f"""
    mention AS (SELECT item_id AS query_id, array_to_string({tok('text')}[1:3] || [CASE item_id % 2 WHEN 0 THEN lower(n_name) ELSE lpad((item_id % 100)::VARCHAR, 9, '0') END], ' ') AS query FROM benchmark JOIN nation ON item_id % 25 = n_nationkey),
    ent AS MATERIALIZED (SELECT head AS entity FROM triples UNION SELECT tail FROM triples),
    plain AS MATERIALIZED (SELECT entity, regexp_replace({trimmed('lower(entity)')}, '{WS}+', ' ', 'g') AS e FROM ent WHERE length(entity) > 1),
    stated AS (SELECT query_id, regexp_replace({trimmed('lower(query)')}, '{WS}+', ' ', 'g') AS q FROM mention),
    way0 AS (SELECT query_id, entity FROM stated JOIN plain ON q <> '' AND e <> '' AND (contains(q, e) OR contains(e, q))),
    way1 AS (SELECT DISTINCT query_id, entity FROM (SELECT query_id, unnest({tok('query')}) AS t FROM mention) JOIN (SELECT entity, unnest({tok('entity')}) AS t FROM ent) USING (t) WHERE length(t) > 1),
    {unit_vectors('mvec', 'mention', 'query_id', 'query')}, {unit_vectors('evec', 'ent', 'entity', 'entity')},
    mnear AS (SELECT query_id, entity, round(2 * sum(m.w * e.w) - 1, 6) AS score FROM mvec m JOIN evec e USING (dim) GROUP BY ALL),
    way2 AS (SELECT query_id, entity, score FROM mnear QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ('0x' || substr(md5(entity), 1, 15))::BIGINT) <= 5),
    linked AS MATERIALIZED (SELECT query_id, entity, min(way) AS way FROM (SELECT query_id, entity, 0 AS way FROM way0 UNION ALL SELECT query_id, entity, 1 FROM way1 UNION ALL SELECT query_id, entity, 2 FROM way2 WHERE (score + 1) / 2 >= 0.35) GROUP BY ALL)"""

BM25 = f"""
    dtok AS MATERIALIZED (SELECT doc_id AS id, {tok('text')} AS w FROM documents),
    tf AS MATERIALIZED (SELECT id, t, count(*) AS tf FROM (SELECT id, unnest(w) AS t FROM dtok) GROUP BY ALL),
    dl AS (SELECT id, len(w) AS dl FROM dtok),
    corpus AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    counted AS MATERIALIZED (SELECT t, count(*) AS df FROM tf GROUP BY t),
    rawidf AS MATERIALIZED (SELECT t, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM counted, corpus),
    meanidf AS MATERIALIZED (SELECT avg(raw) AS mean FROM rawidf),
    idf AS (SELECT t, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM rawidf, meanidf),
    asked AS (SELECT query_id, t, count(*) AS q FROM (SELECT item_id AS query_id, unnest({tok('text')}) AS t FROM benchmark) GROUP BY ALL),
    bscore AS (SELECT query_id, tf.id, round(sum(q * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM corpus)))), 6) AS score
               FROM asked JOIN idf USING (t) JOIN tf USING (t) JOIN dl ON dl.id = tf.id GROUP BY ALL),
    btop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bscore QUALIFY rank <= 10) WHERE score > 0)"""


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents, every third with a fenced block after its first half."""
    d = load(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    code = F.concat(F.lit("\n```py\nx = "), F.md5("text"), F.lit("\n\nThe end. No cut! Here\n```\n"))
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", F.lit(1), half), code, F.substring("text", half + 1, F.length("text")))).otherwise(F.col("text")).alias("text"))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, text): each document, fenced blocks included, as Markdown with a heading every 1500 characters."""
    d = fenced(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    last = F.floor((F.length("text") - 1) / 1500).cast("int")
    part = lambda k: F.concat(F.repeat(F.lit("#"), k % 3 + 1), F.lit(" Part "), k.cast("string"), F.lit("\n"), F.substring(F.col("text"), k * 1500 + 1, F.lit(1500)), F.lit("\n"))
    parts = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), part), "")
    return d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("Intro of "), F.col("source"), F.lit("\n"), parts).alias("text"))


FENCE = "(?s)```[a-zA-Z0-9+#.-]*\\n.*?```"
FENCED = """
    fenced AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) || chr(10) || '```py' || chr(10) || 'x = ' || md5(text) || chr(10) || chr(10) || 'The end. No cut! Here' || chr(10) || '```' || chr(10)
        || substr(text, length(text) // 2 + 1) ELSE text END AS text FROM documents)"""

MARKDOWN = FENCED + """,
    md AS (SELECT 'd/' || doc_id || '.md' AS source, 'Intro of ' || source || chr(10) || array_to_string(list_transform(generate_series(0, greatest(0, (length(f.text) - 1) // 1500)),
        lambda k: repeat('#', CAST(k % 3 + 1 AS INT)) || ' Part ' || k || chr(10) || substr(f.text, k * 1500 + 1, 1500) || chr(10)), '') AS text FROM fenced f JOIN documents USING (doc_id))"""


def semantic(source: str, least: int, most: int) -> str:
    """The semantic chunker over ``source`` (doc_id, text): pieces, hashed vectors, smoothed similarities, breakpoints,
    merging, halving."""
    return f"""
    parts AS (SELECT doc_id, string_split_regex(text, '{FENCE}') AS p, regexp_extract_all(text, '{FENCE}') AS f FROM {source}),
    numbered AS (SELECT doc_id, unnest(p) AS prose, unnest(list_concat(f, [NULL])) AS code, generate_subscripts(p, 1) AS part FROM parts),
    marked AS (SELECT doc_id, part, code, regexp_replace(regexp_replace(regexp_replace(regexp_replace(prose,
        '([。！？!?])', '\\1' || chr(1), 'g'), '(\\n\\n)', '\\1' || chr(1), 'g'), '(\\n)(#{{1,6}} )', '\\1' || chr(1) || '\\2', 'g'),
        '([.!?])([ \\t][A-Z])', '\\1' || chr(1) || '\\2', 'g') AS t FROM numbered),
    listed AS (SELECT doc_id, part, code, list_filter(list_transform(string_split(t, chr(1)), lambda x: {trimmed('x')}), lambda x: length(x) >= 5) AS s FROM marked),
    unnested AS (SELECT doc_id, part, unnest(s) AS text, generate_subscripts(s, 1) AS k, false AS is_code, CAST(NULL AS VARCHAR) AS lang FROM listed
        UNION ALL SELECT doc_id, part, {trimmed('code')}, 1000000, true, {trimmed("regexp_extract(code, '^```([^\\n]*)', 1)")} FROM listed WHERE code IS NOT NULL),
    sent AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n, text, is_code, lang,
        sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY part, k) AS upto FROM unnested),
    word AS (SELECT doc_id, pos, n, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS dim, count(*)::DOUBLE AS tf FROM (SELECT doc_id, pos, n, unnest({tok('text')}) AS t FROM sent WHERE n >= 3) GROUP BY ALL),
    vec AS (SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, pos)) AS w FROM word),
    spread AS (SELECT doc_id, n, pos + o AS pos, dim, sum(w) AS w FROM vec, (VALUES (-1), (0), (1)) AS off(o) WHERE pos + o BETWEEN 0 AND n - 1 GROUP BY ALL),
    smoothed AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) AS v FROM spread),
    prod AS (SELECT a.doc_id, a.pos, sum(a.v * b.v) AS sim FROM smoothed a JOIN smoothed b ON a.doc_id = b.doc_id AND a.pos + 1 = b.pos AND a.dim = b.dim GROUP BY ALL),
    gap AS (SELECT s.doc_id, s.pos, round(coalesce(sim, 0), 6) AS sim FROM sent s LEFT JOIN prod p ON s.doc_id = p.doc_id AND s.pos = p.pos WHERE s.n >= 3 AND s.pos < s.n - 1),
    limits AS (SELECT doc_id, quantile_cont(sim, 0.85) AS th FROM gap GROUP BY 1),
    begun AS (SELECT s.*, CASE WHEN s.n >= 3 AND (sim < th OR is_code <> lag(is_code) OVER (PARTITION BY s.doc_id ORDER BY s.pos)) THEN 1 ELSE 0 END AS b
        FROM sent s LEFT JOIN gap g ON g.doc_id = s.doc_id AND g.pos = s.pos - 1 LEFT JOIN limits l ON l.doc_id = s.doc_id),
    isl AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM begun),
    islands AS MATERIALIZED (SELECT doc_id, island AS i, min(pos) AS a, max(pos) AS z, bool_and(is_code) AS code, min(upto - length(text) - 1) AS lo, max(upto) AS hi, max(n) AS n FROM isl GROUP BY ALL),
    fold AS (SELECT doc_id, i, a AS s, lo AS slo, hi, code FROM islands WHERE i = 0
        UNION ALL SELECT x.doc_id, x.i, CASE WHEN f.hi - f.slo - 1 < {least} AND f.code = x.code THEN f.s ELSE x.a END, CASE WHEN f.hi - f.slo - 1 < {least} AND f.code = x.code THEN f.slo ELSE x.lo END, x.hi, x.code
        FROM fold f JOIN islands x ON x.doc_id = f.doc_id AND x.i = f.i + 1),
    spans AS (SELECT f.doc_id, f.s AS a, max(x.z) AS z, max(x.n) AS n FROM fold f JOIN islands x ON x.doc_id = f.doc_id AND x.i = f.i GROUP BY ALL),
    sized AS (SELECT p.doc_id, a, z, p.n, (hi.upto - lo.upto + length(lo.text)) AS size, lo.is_code AND a = z AS one_code
        FROM spans p JOIN sent lo ON lo.doc_id = p.doc_id AND lo.pos = a JOIN sent hi ON hi.doc_id = p.doc_id AND hi.pos = z),
    halves AS (SELECT doc_id, a, z, size, one_code, n < 3 OR size <= {most} OR a = z AS done FROM sized
        UNION ALL SELECT h.doc_id, c.a, c.z, hi.upto - lo.upto + length(lo.text), lo.is_code AND c.a = c.z, hi.upto - lo.upto + length(lo.text) <= {most} OR c.a = c.z
        FROM halves h, LATERAL (SELECT h.a AS a, h.a + (h.z - h.a + 1) // 2 - 1 AS z UNION ALL SELECT h.a + (h.z - h.a + 1) // 2, h.z) c
        JOIN sent lo ON lo.doc_id = h.doc_id AND lo.pos = c.a JOIN sent hi ON hi.doc_id = h.doc_id AND hi.pos = c.z WHERE NOT h.done),
    joined AS (SELECT h.doc_id, h.a, h.z, h.size, string_agg(s.text, ' ' ORDER BY s.pos) AS text, bool_and(s.is_code) AS is_code, arg_min(s.lang, s.pos) AS lang, max(s.n) AS n
        FROM halves h JOIN sent s ON s.doc_id = h.doc_id AND s.pos BETWEEN h.a AND h.z WHERE h.done GROUP BY ALL),
    sliced AS (SELECT doc_id, a, is_code, lang, CASE WHEN n < 3 OR a < z OR is_code THEN [text] ELSE list_transform(generate_series(0, (length(text) - 1) // {most}), lambda k: substr(text, k * {most} + 1, {most})) END AS pieces FROM joined),
    cutup AS (SELECT doc_id, a, is_code, lang, {trimmed('unnest(pieces)')} AS text, generate_subscripts(pieces, 1) AS k FROM sliced),
    semantic AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, k) - 1 AS chunk_index, text, is_code, CASE WHEN is_code THEN lang END AS code_language FROM cutup WHERE text <> '')"""
