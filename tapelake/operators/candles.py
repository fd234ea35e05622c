"""Candles: bucket by exchange time (else receipt), open and close in receipt order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import extract


def candles(trades: DataFrame, price: Column, volume: Column, unit: str = "second", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """trades (keys, received_at, exchange_at, id): one bar a key and bucket. volume is NULL unless every trade has one.

    All of it is partially aggregated before the one shuffle, by key and bucket.
    """
    at = F.struct("received_at", "id")
    rows = trades.select(*keys, F.date_trunc(unit, F.coalesce("exchange_at", "received_at")).alias("timestamp"), at.alias("_at"), price.alias("_p"), volume.alias("_v")).where("_p IS NOT NULL")
    return rows.groupBy(*keys, "timestamp").agg(
        F.min_by("_p", "_at").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_at").alias("close"),
        F.when(F.count("_v") == F.count(F.lit(1)), F.sum("_v")).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )


def payload_candles(events: DataFrame, unit: str = "second") -> DataFrame:
    """Candles of the `trades` events of a tape (schema MARKET_EVENTS)."""
    trades = events.where(F.col("event_type") == "trades").withColumn("_j", extract.parsed(F.col("payload")))
    return candles(trades, extract.payload_number(F.col("_j"), extract.CANDLE_PRICE), extract.payload_number(F.col("_j"), extract.CANDLE_VOLUME), unit)
