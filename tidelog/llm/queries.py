"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, conversations, fingerprints, licenses, minhash, mixing, quality_mil, sharding, substring, token_files, topk, vector_codes, vector_dedup
from tidelog.llm.common import ready, table


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_mil.judged(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).withColumnRenamed("id", "doc_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=8)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)
    return found.withColumnRenamed("id", "vec_id")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"), window=13)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(query):
    return lambda spark, sf_dir: query(ready(spark), sf_dir)


QUERIES = {
    f.__name__: _ready(f)
    for f in (op1_quality_mil, op2_vector_dedup, op3_mixing, op4_minhash, op5_sharding, op6_topk, op7_substring, op8_token_files, op9_bpe, op10_licenses, op11_fingerprints, op12_vector_codes, op13_conversations, pipeline)
}

_V = "list_transform(embedding, lambda x: x::DOUBLE)"

ORACLES: dict[str, str] = {
    "op2_vector_dedup": f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, {_V} AS e FROM embeddings),
    good AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL
        AND list_aggregate(list_transform(e, lambda x: coalesce(isfinite(x), false)::INT), 'min') = 1 AND list_dot_product(e, e) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
        AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
    reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
    comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
    n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
    FROM v JOIN comp ON comp.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """,
    "op3_mixing": mixing.mixed_sql(),
    "op4_minhash": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)])
        WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM w),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
        FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (na + nb - i)),
    reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
    comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN comp ON comp.id = s.doc_id
    """,
    "op6_topk": """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL
        AND list_aggregate(list_transform(embedding, lambda x: coalesce(isfinite(x), false)::INT), 'min') = 1),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op7_substring": r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
    own AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN own USING (h), range(0, 13) AS t(k) WHERE least < doc_id),
    lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
        sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT coalesce(list_contains(ps, i), false)], ' ')) AS kept_sha256
    FROM w LEFT JOIN lost USING (doc_id)
    """,
    "op10_licenses": licenses.scanned_sql(),
    "op12_vector_codes": vector_codes.digests_sql(),
    "op13_conversations": conversations.digests_sql(),
}
