"""Signals over a price series: momentum against a rolling mean, edges, moving averages, pairing and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def momentum(prices: DataFrame, by: list[str], order: list[str], price: str = "price", window: int = 20, threshold_bps: float = 20) -> DataFrame:
    """prices plus momentum_bps and state (1, -1, 0; NULL until the window is full)."""
    frame = _order(by, order).rowsBetween(1 - window, 0)
    full = F.count(price).over(frame) == window
    bps = F.when(full, (F.col(price) / F.avg(price).over(frame) - 1) * 10_000)
    return prices.withColumn("momentum_bps", bps).withColumn("state", F.when(F.col("momentum_bps") >= threshold_bps, 1).when(F.col("momentum_bps") <= -threshold_bps, -1).when(F.col("momentum_bps").isNotNull(), 0))


def edges(states: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows where the state turns to a direction that it did not have in the full row before."""
    full = states.where("state IS NOT NULL")
    return full.withColumn("_was", F.lag("state", 1, 0).over(_order(by, order))).where("state <> 0 AND state <> _was").drop("_was")


def moving_averages(prices: DataFrame, by: list[str], order: list[str], price: str, fast: int, slow: int) -> DataFrame:
    w = _order(by, order)
    full = F.count(price).over(w.rowsBetween(1 - slow, 0)) == slow
    out = prices.withColumn("fast_ma", F.when(full, F.avg(price).over(w.rowsBetween(1 - fast, 0)))).withColumn("slow_ma", F.when(full, F.avg(price).over(w.rowsBetween(1 - slow, 0))))
    return out.withColumn("edge_bps", (F.col("fast_ma") / F.col("slow_ma") - 1) * 10_000)


def paired(signals: DataFrame, last: DataFrame, by: list[str], order: list[str], clock: str, price: str, notional: float = 1000.0) -> DataFrame:
    """Each signal closed by the next one, the last by the series' last price if that is later. last: by, last_at, last_price."""
    w = _order(by, order)
    ahead = signals.withColumn("_exit_at", F.lead(clock).over(w)).withColumn("_exit", F.lead(price).over(w)).join(last, by)
    closed = ahead.withColumn("exit_at", F.coalesce("_exit_at", F.when(F.col("last_at") > F.col(clock), F.col("last_at")))).where("exit_at IS NOT NULL")
    closed = closed.withColumn("exit_price", F.coalesce("_exit", "last_price"))
    gain = F.col("state") * (F.col("exit_price") / F.col(price) - 1)
    return closed.select(*by, F.col(clock).alias("entry_at"), "exit_at", F.col("state").alias("direction"), F.col(price).alias("entry_price"), "exit_price", gain.alias("return"), (gain * notional).alias("pnl"))


def statistics(trades: DataFrame, by: list[str]) -> DataFrame:
    n, mean, sd = F.count("return"), F.avg("return"), F.stddev_pop("return")
    return trades.groupBy(*by).agg(n.alias("trades"), F.sum("pnl").alias("pnl"), F.avg((F.col("return") > 0).cast("double")).alias("win_rate"), mean.alias("mean_return"), F.when((n > 1) & (sd > 0), mean / sd * F.sqrt(n)).otherwise(0.0).alias("sharpe"))


def drawdown(results: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Greatest fall of the running sum below its running peak (at least 0)."""
    w = _order(by, order).rowsBetween(Window.unboundedPreceding, 0)
    equity = results.withColumn("_equity", F.sum(value).over(w))
    below = equity.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_equity").over(w)) - F.col("_equity"))
    return below.groupBy(*by).agg(F.max("_fall").alias("maximum_drawdown"))


def trade_costs(direction, entry, exit_, seconds, notional: float, fee_rate: float, funding_8h: float, slippage_bps: float, latency_bps: float) -> dict:
    """Columns of a simulated trade's gross result, costs and net result."""
    quantity = F.lit(notional) / entry
    turned = F.lit(notional) + quantity * exit_
    gross = direction * quantity * (exit_ - entry)
    fees = turned * fee_rate
    slip = turned * slippage_bps / 10_000 + turned * latency_bps / 10_000
    funding = F.lit(notional * abs(funding_8h)) * F.greatest(F.lit(0.0), seconds) / 28_800
    return {"gross_pnl": gross, "fees": fees, "funding": funding, "slippage_and_latency": slip, "net_pnl": gross - fees - funding - slip}
