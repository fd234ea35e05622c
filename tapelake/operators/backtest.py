"""Baseline backtest: look-back and execution delay count rows, holding and cooldown count seconds.

What each row would do (its look-back return, its execution row, the row that would close it) is a window expression; only
which candidates are taken depends on what went before, and that is walked over the candidates alone, in segments that
don't depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.operators import signals


@dataclass(frozen=True)
class Baseline:
    lookback: int = 60
    delay: int = 1
    threshold_bps: float = 20.0
    holding_s: float = 60.0
    cooldown_s: float = 30.0
    notional: float = 1000.0
    fee_rate: float = 0.0005
    funding_8h: float = 0.0001
    slippage_bps: float = 1.0
    latency_bps: float = 0.5


def candidates(candles: DataFrame, series: str, clock: str, close: str, how: Baseline) -> DataFrame:
    """What each candle would do: its look-back return, the candle at which it would be executed, and `able`, whether it may open a position."""
    w = Window.partitionBy(series).orderBy(clock)
    seconds = F.col(clock).cast("timestamp").cast("double")
    old = F.lag(close, how.lookback).over(w)
    ahead = F.lead(F.struct(seconds.alias("at"), F.col(close).alias("price")), how.delay).over(w)
    rows = candles.select(
        F.col(series).cast("string").alias("series"), F.row_number().over(w).cast("long").alias("place"), seconds.alias("at"), F.col(close).cast("double").alias("close"),
        ((F.col(close) / old - 1) * 10_000).alias("bps"), old.isNotNull().alias("history"), ahead["at"].alias("run_at"), ahead["price"].cast("double").alias("run_price"),
    )
    return rows.withColumn("able", F.coalesce(F.col("history") & (F.abs("bps") >= how.threshold_bps) & F.col("run_at").isNotNull(), F.lit(False)))


def exits(rows: DataFrame, how: Baseline) -> DataFrame:
    """The candles that may open a position, with the candle that would close it: the first one `holding_s` after its execution, NULL if there is none.

    Candles and wanted times go through one sort, latest first, and each time takes the last candle that it has seen.
    """
    price = F.struct(F.col("place").alias("out_place"), F.col("at").alias("out_at"), F.col("close").alias("out_price"))
    own = F.struct("place", "at", "bps", "run_at", "run_price")
    candle = F.struct(F.col("at").alias("key"), F.lit(0).alias("kind"), price.alias("out"), F.when(F.lit(False), own).alias("row"))
    wanted = F.when(F.col("able"), F.struct((F.col("run_at") + how.holding_s).alias("key"), F.lit(1).alias("kind"), F.when(F.lit(False), price).alias("out"), own.alias("row")))
    both = rows.select("series", F.explode(F.array_compact(F.array(candle, wanted))).alias("e")).select("series", "e.*")
    back = Window.partitionBy("series").orderBy(F.col("key").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("out", F.last("out", ignorenulls=True).over(back))
    return found.where("kind = 1").select("series", "row.*", "out.*")


def chosen(able: DataFrame, how: Baseline) -> DataFrame:
    """Which candidates open a position: each needs the one before closed and cooled down.

    A later candidate closes no earlier, so wherever the candidate before is done in time, whatever was chosen before is: there
    a new segment begins. Segments are walked apart, as rows stream by in order, with one time in memory.
    """
    w = Window.partitionBy("series").orderBy("place")
    free = F.when(F.col("out_at").isNull(), F.lit(float("inf"))).otherwise(F.col("out_at") + how.cooldown_s)
    new = F.coalesce(F.lag(free).over(w) <= F.col("at"), F.lit(True))
    cut = able.withColumn("_new", new.cast("long")).withColumn("_segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out_at = None, None
        for batch in batches:
            keep = []
            for name, segment, at, out in zip(*(batch.column(c).to_pylist() for c in ("series", "_segment", "at", "out_at")), strict=True):
                first = (name, segment) != held
                keep.append(first or (out_at is not None and at >= out_at and at - out_at >= how.cooldown_s))
                if keep[-1]:
                    held, out_at = (name, segment), out
            yield batch.filter(pa.array(keep, pa.bool_()))

    return cut.repartition("series", "_segment").sortWithinPartitions("series", "_segment", "place").mapInArrow(walk, cut.schema).drop("_segment")


def outcomes(candles: DataFrame, series: str, clock: str, close: str, how: Baseline) -> DataFrame:
    """One row a skipped candle (its reason), signal or closed trade; only the choice among candidates is a walk, all else windows."""
    c = F.col
    rows = candidates(candles, series, clock, close, how)
    taken = chosen(exits(rows, how), how)
    marks = taken.select("series", "place", F.struct("out_place", "out_at", "out_price").alias("mine"))
    w = Window.partitionBy("series").orderBy("place")
    seen = rows.join(marks, ["series", "place"], "left").withColumn("before", F.last("mine", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    seen = seen.withColumn("last", F.last(F.struct("place", "at", "close")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    signal = c("mine").isNotNull()
    reason = (
        F.when(signal, "signal").when(c("before").isNotNull() & (c("before.out_place").isNull() | (c("place") < c("before.out_place"))), "position_open").when(~c("history"), "insufficient_history")
        .when(c("at") - c("before.out_at") < how.cooldown_s, "cooldown").when(F.abs("bps") < how.threshold_bps, "below_threshold").otherwise("execution_delay_out_of_range")
    )
    done = signal & (c("mine.out_place").isNotNull() | (c("last.at") > c("run_at")))

    def outcome(place, name, opened, ended) -> Column:
        entry = [F.when(opened, x).alias(n) for x, n in ((F.when(c("bps") > 0, 1).otherwise(-1), "direction"), (c("run_at"), "entry_at"), (c("run_price"), "entry_price"))]
        exit_ = [F.when(ended, F.coalesce(f"mine.out_{x}", f"last.{y}")).alias(f"exit_{x}") for x, y in (("at", "at"), ("price", "close"))]
        return F.struct(place.alias("place"), name.alias("outcome"), *entry, *exit_)

    own = outcome(c("place"), reason, signal, F.lit(False))
    closing = F.when(signal, outcome(F.coalesce("mine.out_place", "last.place"), F.when(done, "trade").otherwise("unclosed_at_end"), done, done))
    return seen.select("series", F.explode(F.array_compact(F.array(own, closing))).alias("o")).select("series", "o.*")


def costs(how: Baseline) -> dict[str, Column]:
    c = F.col
    return signals.trade_costs(c("direction"), c("entry_price"), c("exit_price"), c("exit_at") - c("entry_at"), how.notional, how.fee_rate, how.funding_8h, how.slippage_bps, how.latency_bps)


def trades(found: DataFrame, how: Baseline) -> DataFrame:
    return found.where("outcome = 'trade'").withColumns(costs(how))


def report(found: DataFrame, how: Baseline) -> DataFrame:
    """One row a series: counts of signals and exits, sums of results and costs, win rate, drawdown, mean holding. One pass over the outcomes."""
    trade = F.col("outcome") == "trade"
    rows = found.withColumns({n: F.when(trade, x) for n, x in costs(how).items()})
    w = Window.partitionBy("series").orderBy("exit_at", "place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_equity", F.sum("net_pnl").over(w))
    rows = rows.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_equity").over(w)) - F.col("_equity"))
    sums = [F.sum(n).alias(n) for n in ("gross_pnl", "fees", "funding", "slippage_and_latency", "net_pnl")]
    return rows.groupBy("series").agg(
        F.count_if(F.col("outcome") == "signal").alias("signals"), *sums, F.avg(F.when(trade, (F.col("net_pnl") > 0).cast("double"))).alias("win_rate"),
        F.avg(F.when(trade, F.col("exit_at") - F.col("entry_at"))).alias("average_holding_s"), F.count_if(trade).alias("exits"), F.max("_fall").alias("maximum_drawdown"),
    ).na.fill(0)


def configuration(how: Baseline) -> dict:
    return asdict(how)
