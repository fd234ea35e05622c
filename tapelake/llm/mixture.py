"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies. Documents of a source are ordered by size (then by a
seeded hash), the expected copies are summed along that order, one random offset in [0, 1) is added for the source,
and a document is emitted once for each integer that its stretch of the sum crosses.

Rules: null text has size 0; sources go by code point, null last; a source without words has target 0 and is taken 0
times; rows that repeat a doc_id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.common import pick, ranked, words_count, written

SEED = 20240609


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) plus `target`: shares of the whole by weight, none above `most` times its size.

    Sorted by the size-to-weight ratio, the capped sources are a prefix: the first source that need not be capped
    settles the level that all later ones share by weight. One row a source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    low = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    pickw = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("_w", pickw).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    w = w.withColumn("_need", F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share)))
    before = low.rowsBetween(Window.unboundedPreceding, -1)
    after = low.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("_level", (F.col("_need") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    w = w.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(Window.partitionBy(F.lit(1)))["_level"])
    return w.select("source", "source_size", F.coalesce(F.least(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap")).alias("target"))


def copies(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """sized (doc_id, source, size, ...) plus source_size, target and `copies`."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goal = goal.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_name")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    goal = goal.withColumn("_u", offset).withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    mixed = sized.withColumn("_mix", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    placed = ranked(mixed, ["source"], ["size", "_mix", "doc_id"], "_rank")
    placed = placed.withColumn("_name", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).join(goal, "_name")
    crossed = F.floor(F.col("_rate") * (F.col("_rank") + 1) + F.col("_u")) - F.floor(F.col("_rate") * F.col("_rank") + F.col("_u"))
    return placed.withColumn("copies", crossed.cast("long")).drop("_mix", "_rank", "_name", "_u", "_rate")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", words_count(F.col("text")).alias("size"))
    return copies(written(sized, "sizes"), **how)  # texts are read once; sums, range bounds and rows use the sizes


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Rows that repeat doc_id and text count as one row of their joint copies."""
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    sized = pick(docs, "doc_id", "source", "text").select("doc_id", "source", words_count(F.col("text")).alias("size"), hashed.alias("__tl_th"))
    taken = copies(written(sized, "sizes"), **how).groupBy(F.col("doc_id").alias("__tl_id"), F.col("__tl_th").alias("__tl_t")).agg(F.sum("copies").alias("__tl_copies")).where("__tl_copies > 0")
    rows = docs.withColumn("__tl_th", hashed)
    joined = rows.join(taken, rows["doc_id"].eqNullSafe(F.col("__tl_id")) & (F.col("__tl_th") == F.col("__tl_t"))).dropDuplicates(["__tl_id", "__tl_t"])
    return joined.withColumn("__tl_copy", F.explode(F.sequence(F.lit(1), F.col("__tl_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
