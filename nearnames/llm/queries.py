"""Queries over whole tables, one per operator, and the SQL that checks those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearnames.llm import embedding_dedup, jaccard, langid, packing, quality, secrets, sharding, token_counts, topk, viterbi


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.encode(_table(spark, sf_dir, "documents"), with_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folded=False)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_packing, op3_sharding, op4_token_counts, op5_secrets, op6_sentencepiece,
        op7_quality, op8_language_id, op9_topk, op10_ngram_jaccard,
    )
}

#: Only what SQL can say about whole results: see tests/llm for the brute-force checks of the others.
ORACLE_SQL = {
    "op1_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b, a.e = b.e AS same FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), reach(node, root) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
        ), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT node AS vec_id, (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, component_id = node AS kept,
            least(node, coalesce((SELECT min(b) FROM links WHERE a = node AND same), node)) AS class_id
        FROM least
    """,
    "op10_ngram_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8
            UNION ALL SELECT p.doc_id, q.doc_id, true FROM w p JOIN w q ON p.doc_id <> q.doc_id AND len(p.w) = 0 AND len(q.w) = 0
        ), reach(node, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
        ), least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
        SELECT node AS doc_id, least(node, coalesce((SELECT min(b) FROM links WHERE a = node AND same), node)) AS class_id,
            (SELECT count(*) FROM links WHERE a = node) AS n_links, component_id, component_id = node AS kept
        FROM least
    """,
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        ) WHERE rank <= 20
    """,
}
