"""What the training-data operators share: written tables in the shared folder, ranks without a hot task, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: A word is a run of bytes that are none of these; they never occur inside a multi-byte UTF-8 character.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tapelake-")
        spark.conf.set("spark.checkpoint.dir", named)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tapelake/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """df as a written Parquet table: lineage ends here, and a lost executor loses nothing. `done` are written tables that nothing else reads."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    drop(*done)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables; others are left alone."""
    for table in tables:
        if path := getattr(table, "written_at", None):
            drop_path(table.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def beside(small: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A side of a join: broadcast if its counted rows, of some 100 bytes at most, are few; else as it is."""
    return F.broadcast(small) if rows <= most else small


def total(df: DataFrame, value: Column) -> int:
    return int(df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).first()["n"])


def ranked(df: DataFrame, by: list[str], order: list[str], out: str, size: str | None = None) -> DataFrame:
    """Adds `out`: the rank from 0 by `order` within `by` (null is a group of its own); with `size`, the group's rows too.

    Range partitions on (by, order) split a hot group evenly; each partition's share of a group is counted, the
    counts are summed over the partitions (a few rows each), and no task ever holds a whole group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in [*by, *order]]
    at = written(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_part", F.shiftright("_at", 33))
    share = at.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    if size:
        share = share.withColumn(size, F.sum("_rows").over(Window.partitionBy(*by)))
    share = share.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by_{c}") for c in by], "_first", "_before", *([size] if size else []))
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = at.join(share, on).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
    return joined.drop("_at", "_part", "_p", "_first", "_before", *[f"_by_{c}" for c in by])


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut to few rows each, so that what a worker makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_count(text: Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that an input's further columns never clash with those that an operator makes."""
    return df.select(*[F.col(f"`{n}`") for n in names])
