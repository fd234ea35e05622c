"""Fixed schemas of tapes and of what is derived from them, as DDL, so that workers can import them without a session."""

from __future__ import annotations

from pyspark.sql import DataFrame

DEC = "decimal(38,18)"
BOOK_SIDE = f"array<struct<price:{DEC},quantity:{DEC}>>"


MARKET_EVENTS = (
    "id long, received_at timestamp, exchange_at timestamp, source string, event_type string, symbol string, sequence long, "
    "connection_id string, local_sequence long, exchange_sequence long, schema_version short, latency_ms double, payload string"
)
SYSTEM_EVENTS = ("id long, occurred_at timestamp, severity string, event_type string, component string, message string, details string")
PROVENANCE = (
    "raw_event_id long, received_at timestamp, available_at timestamp, exchange_at timestamp, symbol string, source string, "
    "connection_id string, local_sequence long, exchange_sequence long, raw_schema_version short, pipeline_version short, data_quality string"
)
BEST_QUOTES = (f"{PROVENANCE}, bid_price {DEC}, bid_size {DEC}, ask_price {DEC}, ask_size {DEC}")
REFERENCE_PRICES = (f"{PROVENANCE}, price_kind string, price {DEC}")
FUNDING_ESTIMATES = (f"{PROVENANCE}, estimated_rate {DEC}, next_funding_at timestamp")
ORDERBOOK_EVENTS = (f"{PROVENANCE}, message_type string, depth short, granularity {DEC}, bids {BOOK_SIDE}, asks {BOOK_SIDE}, changed_level_count short")
NORMALIZATION_ERRORS = ("raw_event_id long, received_at timestamp, event_type string, pipeline_version short, error_code string, error_detail string")
CANDLES = ("symbol string, timestamp timestamp, open double, high double, low double, close double, volume double, trade_count long")
BOOK_STATES = ("symbol string, raw_event_id long, state string, best_bid decimal(38,18), best_ask decimal(38,18), level_count int")


BOOK_STATE_NAMES = ("symbol", "raw_event_id", "state", "best_bid", "best_ask", "level_count")


def require(df: DataFrame, ddl: str) -> None:
    """Raises unless df has exactly the names and types of ddl."""
    fields = lambda x: [(f.name, f.dataType.simpleString()) for f in x.schema]
    have, want = fields(df), fields(df.sparkSession.createDataFrame([], ddl))
    if have != want:
        raise ValueError(f"schema differs: {sorted(set(have) ^ set(want))}")
