"""Exact deduplication by a keyed streaming state.

The state store (RocksDB, on the executors' disks, checkpointed to the shared folder, no expiry) keeps one entry for
each content digest: the digest, the stable identifier of the row that stays, the locator of its content (file and row),
and how many rows had it. A digest with more than one row is a hit, and full bytes are compared on hits only: the rows of
this call with each other, and with the earlier content that the state locates. Rows of a digest whose texts differ
are grouped by the text itself; all others by their entry.

With `state`, a folder that later calls name again, the state goes on: each call adds its rows under its own `call` name,
and a call that failed is made again under the same name. Without it the state lasts for one call.

Rules: a null text counts as empty; the largest doc_id of a group stays; null doc_ids are smaller than any other; rows
that repeat a doc_id and a text are one document for `keep_id` and all count in `group_size`; an empty table gives an
empty result. Further columns of the input are not read. Rows without a file (made in memory) have no locator, and rows
whose texts share a digest with others that differ are grouped within their call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.llm.common import beside, exists, new_path, pick, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Digest = Callable[[Column], Column]


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_state(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Runs the stateful aggregation over all that `stream` (digest, doc_id, locator) offers now; state stays in `checkpoint`.

    Every micro-batch writes the entries that changed to a folder of its own number, so that a batch that runs again
    after a failure replaces its own output only.
    """
    spark = stream.sparkSession
    entries = stream.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("locator", "doc_id").alias("locator"), F.count(F.lit(1)).alias("group_size")
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch={number}")

    # a store leaves the executor's disk once its task has committed to the shared checkpoint
    how = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in how}
    for k, v in how.items():
        spark.conf.set(k, v)
    try:
        entries.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and locator (file, row) of each row of docs."""
    text = F.coalesce("text", F.lit("")).alias("text")
    if "_metadata" not in docs.columns:
        try:
            return docs.select("doc_id", text, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator"))
        except AnalysisException:  # not a scan of Parquet files
            pass
    return pick(docs, "doc_id", "text").select("doc_id", text, F.struct(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row")).alias("locator"))


def content(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """digest and text of the rows that entries (digest, locator) locate. File names are gathered, one a file."""
    at = entries.select("digest", "locator.*").where("file IS NOT NULL")
    files = [r["file"] for r in at.select("file").distinct().collect()]
    if not files:
        return entries.select("digest", F.lit("").alias("text")).limit(0)
    rows = spark.read.parquet(*files).select(F.coalesce("text", F.lit("")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(at, ["file", "row"]).select("digest", "text")


def entries_of(spark: SparkSession, log: DataFrame, state: str) -> tuple[DataFrame, DataFrame | None]:
    """The state's entry for each digest so far, and the entries that it had before this call, if any."""
    before = written(latest(spark, log, state), "before") if exists(spark, f"{state}/entries") else None
    digest_state(spark.readStream.schema(log.schema).parquet(f"{state}/log/*"), f"{state}/checkpoint", f"{state}/entries")
    return written(latest(spark, log, state), "latest"), before  # a written side lets the join deal a hot digest's rows to several tasks


def latest(spark: SparkSession, log: DataFrame, state: str) -> DataFrame:
    """digest, keep_id, locator, group_size; keep_id and group_size only rise from batch to batch."""
    kinds = f"digest {log.schema['digest'].dataType.simpleString()}, keep_id {log.schema['doc_id'].dataType.simpleString()}, locator struct<file:string,row:bigint>, group_size long, batch long"
    rows = spark.read.schema(kinds).parquet(f"{state}/entries") if exists(spark, f"{state}/entries") else log.limit(0).select("digest", F.col("doc_id").alias("keep_id"), "locator", F.lit(0).alias("group_size"), F.lit(0).alias("batch"))
    return rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max_by("locator", "batch").alias("locator"), F.max("group_size").alias("group_size"))


def clashes(rows: DataFrame, digest: Digest, entries: DataFrame, before: DataFrame | None) -> DataFrame:
    """Written table of digests whose rows differ in some byte. rows: text.

    Few hits are broadcast, and only their texts move; beyond that all texts are aggregated, least and greatest of each
    digest in part before they move, so that a hot group moves once a task.
    """
    hits = written(entries.where("group_size > 1").select("digest"), "hits")
    count = hits.count()
    texts = rows.select(digest(F.col("text")).alias("digest"), "text")
    near = beside(hits, count)
    texts = texts.join(near, "digest", "left_semi") if near is not hits else texts
    if before is not None:
        texts = texts.union(content(rows.sparkSession, before.join(hits, "digest", "left_semi")))
    return written(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").select("digest"), "clashes", hits)


def exact_dedup(docs: DataFrame, digest: Digest = sha256_digest, state: str | None = None, call: str = "only") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of docs (doc_id, text)."""
    spark, rows = docs.sparkSession, located(docs)
    state = state or new_path(spark, "state")
    at = f"{state}/log/{call}"
    made = rows.select("doc_id", digest(F.col("text")).alias("digest"), "locator")
    if not exists(spark, f"{at}/_SUCCESS"):
        made.write.mode("overwrite").option("compression", "zstd").parquet(at)
    log = spark.read.schema(made.schema).parquet(at)
    entries, before = entries_of(spark, log, state)
    found = log.drop("locator").join(entries.drop("locator"), "digest")
    bad = clashes(rows, digest, entries, before)
    if not bad.isEmpty():
        texts = rows.select("doc_id", "text", digest(F.col("text")).alias("digest")).join(bad, "digest", "left_semi")
        groups = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.join(bad, "digest", "left_anti").unionByName(texts.join(groups, ["digest", "text"]).drop("text"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns, one for each text. Copies are left out by digest and doc_id together, so they never meet in a task."""
    names = [F.col("digest").alias("__tl_digest"), F.col("doc_id").alias("__tl_id")]
    rows = written(exact_dedup(docs).where("group_size > 1").select(*names, F.col("kept").alias("__tl_kept")), "copies")
    gone = rows.where("NOT __tl_kept").select("__tl_digest", "__tl_id")
    twice = rows.where("__tl_kept").groupBy("__tl_digest", "__tl_id").agg(F.count(F.lit(1)).alias("__tl_rows")).where("__tl_rows > 1").drop("__tl_rows")
    marked = docs.withColumn("__tl_d", sha256_digest(F.coalesce(F.col("text"), F.lit(""))))
    same = (F.col("__tl_d") == F.col("__tl_digest")) & F.col("doc_id").eqNullSafe(F.col("__tl_id"))
    kept = marked.join(beside(gone, gone.count()), same, "left_anti")
    repeats = twice.count()
    if repeats:  # rows that repeat both doc_id and text
        some = beside(twice, repeats)
        kept = kept.join(some, same, "left_anti").unionByName(kept.join(some, same, "left_semi").dropDuplicates(["__tl_d", "doc_id"]))
    return kept.drop("__tl_d")
