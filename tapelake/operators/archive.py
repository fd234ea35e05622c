"""Archive: digests over ids, day manifests, and verification by one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_ids(ids: Column) -> Column:
    """Array of ids, in order, as 16 hex digits each (8 bytes, most significant first)."""
    return F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 16, "0")), "")


def id_digest(ids: Column) -> Column:
    """SHA-256 of the ids' bytes in the array's order."""
    return F.sha2(F.unhex(hex_ids(ids)), 256)


MOST_IDS = 200_000


def chunk_digests(rows: DataFrame, by: list[str], id_col: str = "id", most: int = MOST_IDS) -> DataFrame:
    """One row a chunk: rows, least and greatest id, digest of its ascending ids. A chunk of more than `most` rows is an error: split it by `part`."""
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"), F.array_sort(F.collect_list(id_col)).alias("_ids"))
    bounded = F.when(F.col("row_count") > most, F.raise_error(F.lit(f"a chunk has more than {most} rows")).cast("array<bigint>")).otherwise(F.col("_ids"))
    return found.withColumn("id_sha256", id_digest(bounded)).drop("_ids")


def part(id_col: str = "id", rows: int = 10_000) -> Column:
    """The part of an id: parts hold so many ids at most, whatever a day or a symbol has."""
    return F.floor(F.col(id_col) / rows).cast("long")


def day_digest(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Digest of the chunks' digests in order of least id, and totals."""
    ordered = F.array_sort(F.collect_list(F.struct("min_id", "id_sha256")))
    return chunks.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["id_sha256"]), "").cast("binary"), 256).alias("chunks_sha256"))


FIGURES = ("size_bytes", "sha256", "schema_sha256", "row_count", "min_id", "max_id", "id_sha256")


def verify(manifest: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Objects that are missing, unexpected or differ in a figure that the manifest has (NULL is a value); the first difference names the problem."""
    a, b = manifest.alias("a"), found.alias("b")
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    a, b = a.withColumn("_a", F.lit(True)).alias("a"), b.withColumn("_b", F.lit(True)).alias("b")
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "unexpected")
    for n in FIGURES:
        if n in manifest.columns:
            problem = problem.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), f"{n}_differs")
    return a.join(b, on, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], problem.alias("problem")).where("problem IS NOT NULL")


def manifest_totals(objects: DataFrame, rows: int, digest: str) -> DataFrame:
    """Problems of a day manifest itself: its objects' rows and the digest of their digests against its head."""
    raw = objects.where("dataset = 'raw'").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n"), F.array_sort(F.collect_list(F.struct("min_id", "id_sha256"))).alias("d"))
    whole = F.sha2(F.array_join(F.transform("d", lambda x: x["id_sha256"]), "").cast("binary"), 256)
    found = F.array_compact(F.array(F.when(F.col("n") != rows, F.lit("row_count_mismatch")), F.when(whole != digest, F.lit("identity_mismatch")), F.when(F.size("d") == 0, F.lit("no_objects"))))
    return raw.select(F.explode(found).alias("problem"))


def file_figures(files: DataFrame, id_col: str = "raw_event_id", most: int = MOST_IDS) -> DataFrame:
    """path, row_count, min_id, max_id, id_sha256 of each file of a scan, in one pass."""
    return chunk_digests(files.select(F.col("_metadata.file_path").alias("path"), id_col), ["path"], id_col, most)


def file_checksums(spark, path: str) -> DataFrame:
    """path, bytes and SHA-256 of each file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def raw_projection(events: DataFrame) -> DataFrame:
    return events.withColumnRenamed("sequence", "legacy_sequence").withColumnRenamed("payload", "payload_json").withColumn("schema_version", F.coalesce(F.nullif(F.col("schema_version"), F.lit(0)), F.lit(1)).cast("short"))
