"""The thin queries of the training-data operators, and SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import audio, chat, dedup, language, licenses, packing, pieces, private, topk, warc
from .common import bound_batches


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_personal_data(read(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    from public_tokenizers import path

    return path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4, percent=80)


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_features(read(spark, sf_dir, "documents"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op5_language_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.conversation_digests(chat.format_conversations(rows, tokenizer_path("byte_bpe_50k.json")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(read(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_license_rules": op2_license_rules,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_pivot_top_k": op4_pivot_top_k,
    "op5_language_ranks": op5_language_ranks,
    "op6_chat_windows": op6_chat_windows,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_warc_segments": op8_warc_segments,
    "op9_packing": op9_packing,
    "op10_private": op10_private,
}

ORACLES: dict[str, str] = {
    "op4_pivot_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_warc_segments": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d,
                   octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        r AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
               CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN m = page_id THEN NULL ELSE m END AS refers_to
        FROM p LEFT JOIN r ON p.d = r.d
    """,
}
