"""The queries of the ten operators over the whole tables, and their SQL twins where SQL can tell them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweft.llm import ann, jaccard, packing, pieces, pii, sharding, token_orc, topk, toxicity, warc
from planweft.llm.shared import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    return pieces.digests(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=0, capacity=2048)


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(spark))


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk": op1_exact_topk,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_personal_data": op6_personal_data,
    "op7_prefix_forest": op7_prefix_forest,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "jaccard_links": jaccard_links,
    "op10_token_orc": op10_token_orc,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH parts AS (
            SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), good AS (
            SELECT vec_id FROM parts GROUP BY vec_id HAVING count(*) = count(x) AND bool_and(isfinite(x))
        ), whole AS (
            SELECT e.vec_id, list_transform(e.embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings e JOIN good USING (vec_id)
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op2_warc_round_trip": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p
        ), k AS (
            SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS keeper FROM d
        )
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN keeper <> page_id THEN keeper END AS refers_to
        FROM k
    """,
    "op9_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w
        ), g AS (
            SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT a AS doc_id, b AS other FROM pairs UNION SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON r.other = p.a
        ), least_id AS (
            SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id
        )
        SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id FROM s LEFT JOIN least_id USING (doc_id)
    """,
}
ORACLE_SQL["jaccard_links"] = ORACLE_SQL["op9_jaccard_join"].replace(
    "AS component_id FROM s", "AS component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM pairs GROUP BY a) USING (doc_id)"
)
