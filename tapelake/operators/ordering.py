"""Orders of a tape and checks that hold along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def receipt_order(df: DataFrame) -> DataFrame:
    """By receipt, then by raw_event_id or id; raises if neither column is there."""
    ids = [F.col(n) for n in ("raw_event_id", "id") if n in df.columns]
    if not ids:
        raise ValueError("neither raw_event_id nor id")
    return df.orderBy("received_at", F.coalesce(*ids))


def book_order(df: DataFrame) -> DataFrame:
    """By sequence, receipt and id where all rows have a sequence, by receipt and id where none has; raises when mixed."""
    seq = F.coalesce("exchange_sequence", "sequence")
    have, rows = df.agg(F.count(seq), F.count(F.lit(1))).first()
    if have not in (0, rows):
        raise ValueError("some rows have a sequence and others have none")
    return df.orderBy(*([seq] if have else []), "received_at", "id")


def file_order(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Adds the physical place of each row of a file scan: checks of file order read it, never a sort key of the data."""
    return df.select("*", F.col("_metadata.row_index").alias(name), F.col("_metadata.file_path").alias("file_path"))


def previous(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """df plus, for each named value, the last one that is not null among the earlier rows of its `by` along `order`.

    `chunk`, which never falls along `order` (an id divided by a size, a day), splits a busy group: chunks are sorted in tasks
    of their own, and what a chunk starts from comes from a table of one row a chunk.
    """
    part = [*by, "_chunk"]
    rows = df.withColumns({f"_of_{n}": v for n, v in values.items()} | {"_chunk": F.lit(0) if chunk is None else chunk})
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({n: F.last(f"_of_{n}", ignorenulls=True).over(inside) for n in values})
    if chunk is not None:
        at = F.struct(*order)
        ends = rows.groupBy(*part).agg(*[F.max_by(f"_of_{n}", F.when(F.col(f"_of_{n}").isNotNull(), at)).alias(f"_of_{n}") for n in values])
        before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = ends.select(*[F.col(c).alias(f"_at_{c}") for c in part], *[F.last(f"_of_{n}", ignorenulls=True).over(before).alias(f"_start_{n}") for n in values])
        same = F.lit(True)
        for c in part:
            same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
        found = found.join(starts, same, "left").withColumns({n: F.coalesce(n, f"_start_{n}") for n in values})
    return found.select(*df.columns, *values)


def running(df: DataFrame, by: list[str], order: list[str], name: str, value: Column, chunk: Column | None = None) -> DataFrame:
    """df plus the sum of `value` over the rows of its `by` up to this one along `order`; chunks as in `previous`."""
    part = [*by, "_chunk"]
    rows = df.withColumns({"_add": value, "_chunk": F.lit(0) if chunk is None else chunk})
    found = rows.withColumn(name, F.sum("_add").over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if chunk is not None:
        before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy(*part).agg(F.sum("_add").alias("_add")).select(*[F.col(c).alias(f"_at_{c}") for c in part], F.coalesce(F.sum("_add").over(before), F.lit(0)).alias("_start"))
        same = F.lit(True)
        for c in part:
            same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
        found = found.join(starts, same, "left").withColumn(name, F.col(name) + F.col("_start"))
    return found.select(*df.columns, name)


def fell(before: Column, clock: Column) -> Column:
    """1 where the clock is below the one before; equal clocks are in order."""
    return F.coalesce((before > clock).cast("int"), F.lit(0))


def seconds_since(before: Column, clock: Column) -> Column:
    """Seconds from the clock before, where the clock did not fall."""
    return F.when(before <= clock, clock.cast("timestamp").cast("double") - before.cast("timestamp").cast("double"))


def broken(before: Column, seq: Column, snapshot: Column) -> Column:
    """1 where a sequence is not one more than the one before, unless a snapshot starts anew; rows without one are passed over."""
    return F.coalesce((~snapshot & (seq != before + 1)).cast("int"), F.lit(0))


def jumped(before: Column, price: Column, percent: float) -> Column:
    return F.coalesce((F.abs(price / before - 1) * 100 >= percent).cast("int"), F.lit(0))


def sequence_anomalies(df: DataFrame, by: list[str], order: list[str], seq: str, snapshot: Column, chunk: Column | None = None) -> DataFrame:
    """Rows with a sequence plus `anomaly`."""
    known = previous(df.where(F.col(seq).isNotNull()), by, order, {"_before": F.col(seq)}, chunk)
    return known.withColumn("anomaly", broken(F.col("_before"), F.col(seq), snapshot)).drop("_before")


def repeated_candles(candles: DataFrame, by: list[str], clock: str) -> DataFrame:
    """Keys and clocks that stand more than once: candles of a series must rise strictly."""
    return candles.groupBy(*by, clock).count().where("count > 1")


def require_strict(candles: DataFrame, by: list[str], clock: str) -> DataFrame:
    """The candles in order of their series and clock; raises if one stands twice."""
    if not repeated_candles(candles, by, clock).isEmpty():
        raise ValueError("candles repeat a timestamp")
    return candles.orderBy(*by, clock)
