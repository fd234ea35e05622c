"""Scans of tapes: filters are pushed to the files, columns pruned."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelake import schemas

MAX_REPLAY = 1_000_000


def tape(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.MARKET_EVENTS).format(fmt).load(path)


def check_range(start: datetime | None, end: datetime | None) -> None:
    for x in (start, end):
        if x is not None and x.tzinfo is None:
            raise ValueError("times must have a zone")
    if start is not None and end is not None and start >= end:
        raise ValueError("start must be before end")


def received(df: DataFrame, symbol: str | None = None, start: datetime | None = None, end: datetime | None = None, types: list[str] | None = None) -> DataFrame:
    """Half-open receipt range; each bound is optional."""
    check_range(start, end)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    if start is not None:
        df = df.where(F.col("received_at") >= start)
    if end is not None:
        df = df.where(F.col("received_at") < end)
    return df.where(F.col("event_type").isin(types)) if types else df


def guarded(df: DataFrame, most: int) -> DataFrame:
    """df, or an error if it has more rows; the count reads footers and the filter's columns only."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def replay(df: DataFrame, limit: int, **where) -> DataFrame:
    if not 1 <= limit <= MAX_REPLAY:
        raise ValueError(f"limit must be 1 to {MAX_REPLAY}")
    return received(df, **where).orderBy("received_at", "id").limit(limit)


def page(df: DataFrame, after: int, high: int, size: int) -> DataFrame:
    return df.where((F.col("id") > after) & (F.col("id") <= high)).orderBy("id").limit(size)


def latest(df: DataFrame, count: int, clock: str = "received_at") -> DataFrame:
    return df.orderBy(F.col(clock).desc(), F.col("id").desc()).limit(count).orderBy(clock, "id")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Archived events as JSON lines, with an error if ids don't rise strictly along each file."""
    df = spark.read.schema(schemas.MARKET_EVENTS).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    before = F.lag("id").over(Window.partitionBy("_file").orderBy("_at"))
    return df.withColumn("_ok", F.when(F.coalesce(before >= F.col("id"), F.lit(False)), F.raise_error(F.lit("ids don't rise")).cast("boolean")).otherwise(True)).where("_ok").drop("_file", "_at", "_ok")


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
