"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + 1/2) / rows of its
source. Sorted by that rank, every stretch of the order holds the sources in their overall proportions; the order is
cut into shards whose counts differ by one at most.

Rules: null source is a source of its own; ties fall by source, hash, doc_id; rows that repeat a doc_id are rows of
their own; an empty table gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.common import pick, ranked

SEED = 20240607


def interleave(rows: DataFrame, shards: int, stratum: str = "source", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """rows plus `shard` (0..shards-1) and `slot` (gapless from 0 within the shard)."""
    mixed = rows.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    inside = ranked(mixed, [stratum], ["_mix", key], "_rank", "_rows")
    inside = inside.withColumn("_part_rank", (F.col("_rank") + F.lit(0.5)) / F.col("_rows"))
    placed = ranked(inside, [], ["_part_rank", stratum, "_mix", key], "_place", "_all")
    # shard k starts at place ceil(k * all / shards)
    shard = F.expr(f"(_place * {shards}) div _all")
    start = F.expr(f"(((_place * {shards}) div _all) * _all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("_place") - start).drop("_mix", "_rank", "_rows", "_part_rank", "_place", "_all")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = pick(docs, "doc_id", "source", "text").select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return interleave(slim, shards, seed=seed)
