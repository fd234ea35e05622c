"""Out-of-sample admission: chronology, splits, covered days, totals and criteria."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelake.functions import classify
from tapelake.operators import signals


@dataclass(frozen=True)
class Thresholds:
    quality_passing: int = 3
    oos_datasets: int = 2
    oos_trades: int = 30
    oos_drawdown: float = 100.0
    positive_net: bool = True
    oos_days: int = 2


def chronology(datasets: DataFrame) -> DataFrame:
    """Datasets (position, start, end) that start before the one before them ends."""
    before = F.lag("end").over(Window.orderBy("position"))
    return datasets.withColumn("previous_end", before).where("previous_end > start")


def split(datasets: DataFrame, validation: int = 1, oos: int = 2) -> DataFrame:
    order, every = Window.orderBy("start", "dataset_id"), Window.partitionBy(F.lit(1))
    return datasets.withColumn("split", classify.dataset_split(F.row_number().over(order), F.count(F.lit(1)).over(every), validation, oos))


def covered_days(ranges: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Distinct days that half-open ranges touch."""
    last = F.to_date(F.col(end) - F.expr("INTERVAL 1 MICROSECOND"))
    days = ranges.where(F.col(start) < F.col(end)).select(*by, F.explode(F.sequence(F.to_date(start), last)).alias("day")).distinct()
    return days.groupBy(*by).agg(F.count(F.lit(1)).alias("covered_days"))


def totals(trades: DataFrame) -> DataFrame:
    """One row over out-of-sample trades (exit_at, gross_pnl, fees, funding, slippage_and_latency, net_pnl)."""
    sums = [F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("gross_pnl", "fees", "funding", "slippage_and_latency", "net_pnl")]
    row = trades.agg(F.count(F.lit(1)).alias("trade_count"), *sums, F.coalesce(F.avg((F.col("net_pnl") > 0).cast("double")), F.lit(0.0)).alias("win_rate"))
    fall = signals.drawdown(trades.withColumn("_one", F.lit(1)), ["_one"], ["exit_at", "trade_id"], "net_pnl").drop("_one")
    return row.crossJoin(fall.agg(F.coalesce(F.max("maximum_drawdown"), F.lit(0.0)).alias("maximum_drawdown")))


def decide(row: DataFrame, need: Thresholds) -> DataFrame:
    """row: artifacts_valid, compatible, quality_passing, dataset_count, trade_count, maximum_drawdown, net_pnl, utc_day_count."""
    c = F.col
    criteria = {
        "all_required_artifacts_valid": c("artifacts_valid"), "compatible_replay_configuration": c("compatible"),
        "minimum_quality_passing_datasets": c("quality_passing") >= need.quality_passing, "minimum_oos_dataset_count": c("dataset_count") >= need.oos_datasets,
        "minimum_oos_trade_count": c("trade_count") >= need.oos_trades, "maximum_oos_drawdown": c("maximum_drawdown") <= need.oos_drawdown,
        "positive_oos_net_pnl_after_costs": (c("net_pnl") > 0) | F.lit(not need.positive_net), "minimum_oos_utc_days": c("utc_day_count") >= need.oos_days,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in criteria.items()]))
    return row.withColumn("failed", failed).withColumn("admitted", F.size("failed") == 0)


def inconsistent(trades: DataFrame, headers: DataFrame, by: str, tolerance: float = 1e-8) -> DataFrame:
    """Reports whose trades don't add up, overlap in time, or whose totals differ from their header's."""
    before = F.lag("exit_at").over(Window.partitionBy(by).orderBy("entry_at", *[c for c in ("trade_id",) if c in trades.columns]))
    own = F.abs(F.col("net_pnl") - (F.col("gross_pnl") - F.col("fees") - F.col("funding") - F.col("slippage_and_latency"))) > tolerance
    checked = trades.withColumn("_bad", own | (F.col("exit_at") < F.col("entry_at")) | F.coalesce(before > F.col("entry_at"), F.lit(False)))
    sums = checked.groupBy(by).agg(F.sum("net_pnl").alias("_net"), F.bool_or("_bad").alias("_bad"))
    return headers.join(sums, by, "left").where(F.coalesce("_bad", F.lit(False)) | (F.abs(F.coalesce("_net", F.lit(0.0)) - F.col("net_pnl")) > tolerance)).select(by)


def limitations(availability: DataFrame) -> DataFrame:
    """One line for each stream of a passing dataset that has no sequence. availability: dataset_id, status, streams map<string,string>."""
    each = availability.where("status = 'pass'").select("dataset_id", F.explode("streams").alias("stream", "state")).where("state = 'absent'")
    return each.select(F.concat("dataset_id", F.lit(": sequence absent for "), "stream").alias("limitation"))
