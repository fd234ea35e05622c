"""Window plans, reconciliation and retention. Plans only: nothing here deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.functions import classify
from tapelake.operators import joins


def window_plan(bounds: DataFrame, events: DataFrame, clock: str, step: str, unit: str, trade: Column) -> DataFrame:
    """Windows of a (start, end) row with their event and trade counts, zero included; index from 0."""
    windows = joins.grid(bounds, F.col("start"), F.col("end"), step).drop("start", "end")
    counted = joins.grid_counts(windows, events, F.date_trunc(unit, clock), {"expected_event_count": F.count(F.lit(1)), "expected_trade_count": F.count_if(trade)})
    return counted.withColumn("index", F.row_number().over(Window.orderBy("window_start")) - 1)


def checked_windows(plan: DataFrame, progress: DataFrame) -> DataFrame:
    """Planned windows with their progress; a stored window whose event count, or trade count where it has trades, is not the plan's fails.

    plan: index, dataset_id, window_start, window_end, expected_event_count, expected_trade_count. progress: index, status, event_count, checksums_ok and, if
    known, trade_count, quarantined, admission_eligible. Flags that contradict the status are an error.
    """
    have = set(progress.columns)
    more = [F.lit(None).cast(kind).alias(n) for n, kind in (("trade_count", "long"), ("quarantined", "boolean"), ("admission_eligible", "boolean")) if n not in have]
    rows = plan.join(progress.select("*", *more), "index", "left").withColumn("status", classify.checked_status(F.coalesce("status", F.lit("pending")), F.col("quarantined"), F.col("admission_eligible")))
    quarantined, eligible = classify.window_flags(F.col("status"))
    differs = F.when(~F.col("event_count").eqNullSafe(F.col("expected_event_count")), "event_count_differs")
    if "expected_trade_count" in plan.columns:
        differs = differs.when(F.col("trade_count") != F.col("expected_trade_count"), "trade_count_differs")
    rows = rows.withColumn("problem", F.when(quarantined | eligible, differs))
    return rows.withColumn("status", F.when(F.col("problem").isNotNull(), "failed_storage").otherwise(F.col("status")))


def reconcile(plan: DataFrame, progress: DataFrame) -> DataFrame:
    """One row over the windows of `checked_windows`."""
    w = Window.orderBy("index")
    quarantined, eligible = classify.window_flags(F.col("status"))
    rows = checked_windows(plan, progress).withColumn("_next", F.lead("window_start").over(w))
    n = F.coalesce("event_count", F.lit(0))
    names = F.count_distinct("dataset_id") == F.count("dataset_id") if "dataset_id" in plan.columns else F.lit(True)
    figures = rows.agg(
        F.bool_and(quarantined | eligible).alias("all_storage_complete"), F.bool_and(F.coalesce(F.col("_next") == F.col("window_end"), F.lit(True))).alias("boundary_continuity"),
        F.bool_or(F.col("status") == "failed_storage").alias("failed_storage"), F.bool_or(quarantined).alias("has_quarantined"), F.bool_and(F.coalesce("checksums_ok", F.lit(True))).alias("checksums_valid"),
        F.sum(F.when(quarantined | eligible, n).otherwise(0)).alias("storage_event_total"), F.sum(F.when(eligible, n).otherwise(0)).alias("admissible_event_total"), F.sum(F.when(quarantined, n).otherwise(0)).alias("quarantined_event_total"),
        F.sum("expected_event_count").alias("range_expected_event_count"), names.alias("unique_dataset_ids"),
    )
    stored = F.col("storage_event_total") == F.col("range_expected_event_count")
    whole = F.col("all_storage_complete") & F.col("boundary_continuity") & stored & ~F.col("failed_storage")
    admissible = F.col("all_storage_complete") & ~F.col("has_quarantined") & ~F.col("failed_storage") & (F.col("admissible_event_total") == F.col("range_expected_event_count"))
    return figures.withColumns({"storage_coverage_continuous": whole, "admissible_coverage_continuous": admissible, "status": F.when(whole & F.col("checksums_valid") & F.col("unique_dataset_ids"), "pass").otherwise("failed")})


def retention(manifests: DataFrame, cutoff: Column) -> DataFrame:
    """Candidate days (start, end, status, destination, dataset_group, row_count) with `gap`: not adjacent to the candidate before."""
    ready = manifests.where((F.col("status") == "verified") & F.col("destination").isin("s3", "pc_filesystem") & (F.col("dataset_group") == "raw_and_normalized") & (F.col("end") <= cutoff) & (F.col("end") == F.col("start") + F.expr("INTERVAL 1 DAY")))
    before = F.lag("end").over(Window.orderBy("start"))
    return ready.withColumn("gap", F.coalesce(before != F.col("start"), F.lit(False)))


def retention_summary(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("eligible_rows"), F.coalesce(F.bool_or("gap"), F.lit(False)).alias("has_gap")).withColumn("state", F.when(F.col("has_gap"), "gap").when(F.col("days") > 0, "eligible").otherwise("nothing_eligible"))
