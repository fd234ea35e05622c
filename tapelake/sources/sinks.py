"""Sinks: appends, immutable datasets, partitioned archives, idempotent inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.operators import joins

MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def insert_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the table at path doesn't have; running it again changes nothing."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    append(joins.new_rows(df, spark.read.schema(df.schema).parquet(path), key) if there else df.dropDuplicates(key), path)


def dataset(events: DataFrame, candles: DataFrame, path: str) -> None:
    """An immutable dataset: an existing one is an error."""
    events.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/events.parquet")
    candles.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/candles_1s.parquet")


def archive(df: DataFrame, path: str, clock: str = "received_at", rows_a_part: int = 10_000) -> None:
    """date= and symbol= folders, parts of bounded size in id order."""
    dated = df.withColumn("date", F.to_date(clock)).withColumn("symbol", F.translate("symbol", "/:", "--"))
    salted = dated.repartition("date", "symbol", F.expr(f"id div {50 * rows_a_part}"))  # a busy symbol's day is many tasks
    salted.sortWithinPartitions("date", "symbol", "id").write.mode("append").option("maxRecordsPerFile", rows_a_part).option("compression", "zstd").partitionBy("date", "symbol").parquet(path)


def json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).select(F.to_json(F.struct("*"), {"timestampFormat": MICROS}).alias("value")).write.text(path)


def retained(df: DataFrame, cutoff, clock: str = "received_at") -> DataFrame:
    """What stays after a bounded delete: a plan, nothing is deleted."""
    return df.where(F.col(clock) >= cutoff)
