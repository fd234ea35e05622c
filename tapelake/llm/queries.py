"""The opN queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.llm import chat, exact_dedup, mixture, packing, passages, quality, shards, simhash, suffixes, topk


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(documents(spark, sf_dir), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture.mix_documents(documents(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranker = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, ranker, 0.3).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), capacity=1024)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(documents(spark, sf_dir), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_bytes(documents(spark, sf_dir), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = turns.unionByName(added).withColumn("message", F.monotonically_increasing_id())  # each row is a message, rows that repeat too
    events = rows.select("conv_id", "turn", "message", F.col("turn").alias("seq"), F.lit("delta").alias("kind"), "role", "text")
    return chat.digests(chat.format_chats(events, message="message"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_passages": op3_passages,
    "op4_shards": op4_shards,
    "op5_simhash": op5_simhash,
    "op6_suffixes": op6_suffixes,
    "op7_chat": op7_chat,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mixture": op9_mixture,
    "op10_topk": op10_topk,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op9_mixture": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS w, source_size * 2.0::DOUBLE AS cap FROM s),
        r AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS need FROM w),
        l AS (SELECT *, (need - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        t AS (SELECT source, source_size, least((SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1) * w, cap) AS target,
                     ('0x' || substr(md5('{mixture.SEED}:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
        p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5('{mixture.SEED}:' || doc_id::VARCHAR), doc_id) - 1 AS k FROM d),
        j AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.k, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
              FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate * (k + 1) + u) - floor(rate * k + u)))::BIGINT AS taken FROM j""",
    "op7_chat": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length('<turn >' || chr(10) || '</turn>' || chr(10)) + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
                   + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
        QUALIFY rank <= 5""",
}
