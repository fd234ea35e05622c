"""Values of JSON payloads. A payload is parsed to VARIANT once; lookups are column expressions over it.

Three rules differ on purpose: the first *present* key decides (metadata, candles, quality), or the first *valid* one
(signals, simulation); the layers searched differ; and booleans count as numbers in `price_for_quality` only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = ("$",)
ROOT_DATA = ("$", "$.data")
ROOT_DATA_TRADE = ("$", "$.data", "$.data.trade")
# fixed values: field names in order of precedence
SEQUENCE = ("sequence", "seq", "sequenceNumber")
TIME = ("timestamp", "timestampMs", "timestamp_ms", "ts", "time", "createdAt")
CANDLE_PRICE = ("price", "tradePrice", "trade_price", "p")
CANDLE_VOLUME = ("quantity", "size", "amount", "volume", "qty", "q")
SNAPSHOT = ("messageType", "type", "event", "action", "isSnapshot")
SNAPSHOT_VALUES = ("snapshot", "initial", "full")
BID, ASK = ("bidPrice", "bid_price", "bid"), ("askPrice", "ask_price", "ask")
QUALITY_PRICE = ("price", "tradePrice", "trade_price", "markPrice", "mark_price", "p")
FALLBACK_PRICE = ("markPrice", "mark_price", "price", "tradePrice")


def parsed(payload: Column) -> Column:
    return F.try_parse_json(payload)


def at(v: Column, path: str) -> Column:
    """The variant at a path: SQL NULL if absent, a null variant for JSON null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def present(v: Column, names: tuple[str, ...], layers: tuple[str, ...]) -> Column:
    """The value of the first name that is there at all, layer by layer."""
    return F.coalesce(*[at(v, f"{layer}.{n}") for layer in layers for n in names])


def number(x: Column) -> Column:
    """Double of a JSON number or numeric string; booleans and all else are NULL."""
    return F.when(kind(x).isin("BOOLEAN", "VOID"), None).otherwise(F.try_variant_get(x, "$", "double"))


def finite_positive(d: Column) -> Column:
    return F.when(~F.isnan(d) & (d > 0) & (d < float("inf")), d)


def payload_number(v: Column, names: tuple[str, ...], layers: tuple[str, ...] = ROOT_DATA_TRADE) -> Column:
    return finite_positive(number(present(v, names, layers)))


def valid_number(v: Column, names: tuple[str, ...], layers: tuple[str, ...] = ROOT_DATA) -> Column:
    """The first value that is a number above zero; infinity counts."""
    return first_positive([number(at(v, f"{layer}.{n}")) for layer in layers for n in names])


def first_positive(numbers: list[Column]) -> Column:
    """Numbers are looked up one after the other until one is above zero; each is in the generated code once."""
    return F.coalesce(*[F.get(F.filter(F.array(n), lambda d: ~F.isnan(d) & (d > 0)), 0) for n in numbers])


def price_for_quality(v: Column) -> tuple[Column, Column]:
    """Whether a price field is there, and its value if finite and above zero; true reads as 1."""
    raw = present(v, QUALITY_PRICE, ROOT_DATA_TRADE)
    value = F.when(kind(raw) == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).otherwise(number(raw))
    return raw.isNotNull(), finite_positive(value)


def mid_price(v: Column) -> Column:
    bid, ask = valid_number(v, BID), valid_number(v, ASK)
    return F.when(bid <= ask, (bid + ask) / 2).otherwise(valid_number(v, FALLBACK_PRICE))


def best_level(v: Column, sides: tuple[str, ...]) -> Column:
    """First level's price of the first side that is there: a price, an object's price, or the head of a pair."""
    layer = F.coalesce(at(v, "$.data"), v)

    found: list[Column] = []
    for name in sides:
        side = at(layer, f"$.{name}")
        head = at(F.coalesce(at(side, "$.levels"), at(side, "$.prices")), "$[0]")
        for x in (head, side, at(side, "$[0]")):
            found += [number(at(x, path)) for path in ("$.price", "$.p", "$.px", "$[0]")]
    return first_positive(found)


def sequence(v: Column) -> Column:
    raw = present(v, SEQUENCE, ROOT_DATA)
    d = F.try_variant_get(raw, "$", "double")
    whole = F.when(F.substring(kind(raw), 1, 6) == "STRING", F.try_variant_get(raw, "$", "string").try_cast("bigint")).otherwise(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)))
    return F.when(~kind(raw).isin("BOOLEAN", "VOID"), whole)


def epoch_micros(value: Column) -> Column:
    """Microseconds of an epoch number whose unit shows in its size: nano-, micro-, milliseconds or seconds."""
    size = F.abs(value)
    seconds = F.when(size >= 1e18, value / 1e9).when(size >= 1e15, value / 1e6).when(size >= 1e12, value / 1e3).otherwise(value)
    return F.when(~F.isnan(value) & (F.abs(seconds) < 253402300800.0), F.round(seconds * 1e6).cast("bigint"))


def exchange_time(v: Column) -> Column:
    raw = present(v, TIME, ROOT_DATA)
    text = F.try_variant_get(raw, "$", "string")
    words = kind(raw) == "STRING"
    value = F.when(kind(raw).isin("BOOLEAN", "VOID"), None).when(words & ~text.rlike("^[0-9]+$"), None).otherwise(F.try_variant_get(raw, "$", "double"))
    return F.coalesce(F.timestamp_micros(epoch_micros(value)), F.when(words & ~text.rlike("^[0-9]+$"), text.try_cast("timestamp")))


def marker(x: Column) -> Column:
    return F.coalesce(F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).when(kind(x) == "STRING", F.lower(F.try_variant_get(x, "$", "string")).isin(*SNAPSHOT_VALUES)), F.lit(False))


def is_snapshot_first(v: Column) -> Column:
    """The first present key says snapshot."""
    return marker(present(v, SNAPSHOT, ROOT_DATA))


def is_snapshot_any(v: Column) -> Column:
    """Some key of some layer says snapshot."""
    out = F.lit(False)
    for layer in ROOT_DATA:
        for n in SNAPSHOT:
            out = out | marker(at(v, f"{layer}.{n}"))
    return out


def canonical_json(payload: Column) -> Column:
    """Compact JSON with sorted keys; numbers lose trailing zeros and text stays unescaped."""
    return F.to_json(F.try_parse_json(payload))


def latency_ms(received: Column, exchange: Column) -> Column:
    micros = F.unix_micros(received) - F.unix_micros(exchange)
    return F.when(exchange.isNotNull(), F.greatest(F.lit(0.0), micros / 1000.0))
