"""Streams: normalization with exactly-once effect, candles with a watermark, order books with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tapelake import schemas
from tapelake.functions import extract
from tapelake.operators import normalize, orderbook
from tapelake.sources import sinks

TABLES = ("best_quotes", "reference_prices", "funding_estimates", "orderbook_events", "errors")


def raw_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schemas.MARKET_EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def normalize_stream(raw: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Writes five tables; a batch that runs again adds nothing, as keys that are there are left out."""

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            parts = normalize.normalize(batch)
            for name in TABLES:
                sinks.insert_new(getattr(parts, name), f"{out}/{name}", ["raw_event_id", "pipeline_version"])
        finally:
            batch.unpersist()

    writer = raw.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def candle_stream(raw: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """One-second candles by exchange time, final once the watermark has passed."""
    at = F.struct("received_at", "id")
    rows = raw.where("event_type = 'trades'").withColumn("_j", extract.parsed(F.col("payload"))).withColumn("_t", F.coalesce("exchange_at", "received_at")).withWatermark("_t", lateness)
    priced = rows.select("symbol", "_t", at.alias("_at"), extract.payload_number(F.col("_j"), extract.CANDLE_PRICE).alias("_p"), extract.payload_number(F.col("_j"), extract.CANDLE_VOLUME).alias("_v")).where("_p IS NOT NULL")
    bars = priced.groupBy("symbol", F.window("_t", "1 second").alias("_w")).agg(
        F.min_by("_p", "_at").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_at").alias("close"),
        F.when(F.count("_v") == F.count(F.lit(1)), F.sum("_v")).alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )
    return bars.select("symbol", F.col("_w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "trade_count")


def book_stream(events: DataFrame, use_local_sequence: bool = True) -> DataFrame:
    """State after each order-book event; a symbol's ladder (tens of levels) is its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ladder = orderbook.Ladder()
        if state.exists:
            connection, bids, asks, grade, fault, exchange, local = state.get
            ladder = orderbook.Ladder(connection, (dict(map(tuple, bids)), dict(map(tuple, asks))), grade, fault, (exchange, local))
        out = []
        for e in pd.concat(list(frames)).sort_values(["received_at", "raw_event_id"]).to_dict("records"):
            event = {k: None if k not in ("bids", "asks") and pd.isna(v) else v for k, v in e.items()}
            event |= {k: None if event[k] is None else int(event[k]) for k in ("exchange_sequence", "local_sequence")}
            event |= {k: [] if event[k] is None else list(event[k]) for k in ("bids", "asks")}
            ladder = orderbook.after(ladder, event, use_local_sequence)
            out.append((key[0], e["raw_event_id"], *ladder.seen()))
        state.update((ladder.connection, *(list(side.items()) for side in ladder.sides), ladder.grade, ladder.fault, *ladder.numbers))
        yield pd.DataFrame(out, columns=list(schemas.BOOK_STATE_NAMES))

    level = f"array<struct<price:{schemas.DEC},quantity:{schemas.DEC}>>"
    kept = f"connection string, bids {level}, asks {level}, grade string, fault string, exchange long, local long"
    graded = events.withColumn("grade", orderbook.grades(events))
    return graded.groupBy("symbol").applyInPandasWithState(step, schemas.BOOK_STATES, kept, "append", GroupStateTimeout.NoTimeout)
