"""Joins that tapes need beyond equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, clock: str, values: list[str], tie: str = "id") -> DataFrame:
    """Each left row with the values of the last right row of its `by` at or before its clock.

    Both sides go through one shuffle by key and one sort; no pair is ever formed. Of right rows at one clock the
    largest `tie` counts. A struct carries the values, so that a NULL of the matched row stays NULL.
    """
    r = right.select(F.col(by), F.col(clock), F.col(tie).alias("_tie"), F.lit(0).alias("_side"), F.struct(F.col(clock).alias("matched_at"), *values).alias("_hit"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (by, clock)])
    empty = F.lit(None).cast(r.schema["_hit"].dataType)
    l = left.select(F.col(by), F.col(clock), F.col(tie).alias("_tie"), F.lit(1).alias("_side"), empty.alias("_hit"), *[F.col(c) for c in left.columns if c not in (by, clock)])
    w = Window.partitionBy(by).orderBy(clock, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(l).withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*left.columns, F.col("_hit.matched_at").alias("matched_at"), *[F.col(f"_hit.{v}").alias(v) for v in values])


def new_rows(incoming: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Rows of incoming whose key is not there yet, one for each key: an insert that may run again."""
    return incoming.dropDuplicates(key).join(present.select(*key), key, "left_anti")


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frames of one column: rows that only one of them has."""
    return a.exceptAll(b).select(F.lit("left").alias("side"), "*").union(b.exceptAll(a).select(F.lit("right").alias("side"), "*"))


def grid(df: DataFrame, start: Column, end: Column, step: str) -> DataFrame:
    """df's rows for each window [window_start, window_end) of step between start and end."""
    return df.select("*", F.explode(F.sequence(start, end - F.expr(f"INTERVAL {step}"), F.expr(f"INTERVAL {step}"))).alias("window_start")).withColumn("window_end", F.col("window_start") + F.expr(f"INTERVAL {step}"))


def grid_counts(windows: DataFrame, events: DataFrame, bucket: Column, counts: dict[str, Column]) -> DataFrame:
    """Counts for each window, zero where there is none. Events are counted by bucket before they meet the windows."""
    counted = events.groupBy(bucket.alias("window_start")).agg(*[e.alias(n) for n, e in counts.items()])
    return windows.join(counted, "window_start", "left").na.fill(0, list(counts))
