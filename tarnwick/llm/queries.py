"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, centroids, embed_dedup, jaccard, langid, mixing, quality, sharding, syncmers, token_counts, toxicity, warc
from .common import fold, load

#: Production parameters.
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
TOXIC_FROM, GOOD_FROM = 0.7, 0.5
COSINE = 0.95
CENTROIDS, ROUNDS = 40, 5
SHARDS = 8


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(load(spark, sf_dir, "documents"), tokenizer(), limit=TOKEN_LIMIT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    done = langid.predict(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(load(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(load(spark, sf_dir, "pages"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_test(load(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(load(spark, sf_dir, "embeddings"), COSINE)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, load(spark, sf_dir, "labels"), ~held_out)
    done = toxicity.score(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(load(spark, sf_dir, "documents"), tokenizer())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = quality.train(docs, load(spark, sf_dir, "labels"), ~held_out)
    done = quality.score(docs.select("doc_id", "text"), model, risk_col="risk_score")
    return done.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD_FROM).cast("int").alias("predicted"), "risk_score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(load(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(load(spark, sf_dir, "documents"), SHARDS)


def _lloyd_sql(rounds: int) -> str:
    """Every round as two tables: assignments, then centroids."""
    near = """a{i} AS MATERIALIZED (SELECT vec_id, row, q, k, d FROM (
            SELECT v.vec_id, v.row, v.q, c.k, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS d
            FROM v CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""
    move = """c{j} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN (
            SELECT k, list(x ORDER BY i) AS q FROM (
                SELECT k, i, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m USING (k))"""
    steps = [t.format(i=i, j=i + 1) for i in range(rounds) for t in (near, move)] + [near.format(i=rounds)]
    return ",\n        ".join(steps)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_ngram_jaccard_join, op4_warc_bundles, op5_document_fingerprints,
        op6_embedding_near_dedup, op7_toxicity, op8_bpe_round_trip, op9_quality_classifier, op10_source_mixing,
        op11_centroid_clustering, op12_sharding,
    )
}

ORACLE_SQL = {
    "op4_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        k AS (SELECT payload_digest AS digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM d LEFT JOIN k ON payload_bytes >= 1000 AND payload_digest = digest
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
                 AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
        comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1),
        n AS (SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY 1)
        SELECT comp.vec_id, coalesce(n_links, 0) AS n_links, component_id, comp.vec_id = component_id AS kept
        FROM comp LEFT JOIN n USING (vec_id)
    """,
    "op10_source_mixing": """
        WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
        r AS (SELECT source, w * ((SELECT sum(n) FROM c) / (SELECT sum(w) FROM c)) / n AS rate FROM c),
        k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 8 * sqrt(rate) + 20) AS INT))) AS i FROM r),
        p AS (SELECT source, sum(exp(i * ln(rate) - rate - lgamma(i + 1.0))) OVER (PARTITION BY source ORDER BY i) AS cum FROM k),
        u AS (SELECT *, ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|mix'), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents),
        m AS (SELECT u.doc_id, count(*) FILTER (WHERE p.cum <= u.u) AS copies FROM u JOIN p ON u.source IS NOT DISTINCT FROM p.source GROUP BY 1)
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(x.i AS INT) AS mix_copy
        FROM documents d JOIN (SELECT doc_id, unnest(generate_series(1, copies)) AS i FROM m WHERE copies > 0) x USING (doc_id)
    """,
    "op11_centroid_clustering": f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64),
        v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(e, lambda x: floor(256 * x)) AS q
              FROM e WHERE len(list_filter(e, lambda x: isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, vec_id) - 1 AS k, q FROM (
               SELECT sha256('2:' || vec_id) AS h, vec_id, q FROM v ORDER BY h, vec_id LIMIT {CENTROIDS})),
        {_lloyd_sql(ROUNDS)}
        SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
               CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c.q, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} c USING (k)
    """,
}
