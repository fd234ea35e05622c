"""Strict typed normalization: every event becomes one typed row or one error code; the first failing check names the code.

A payload is parsed once. Checks are a coalesce over CASE columns in order of precedence; rows without a code are
projected to the four typed tables. Works on batches and streams alike, as it is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import extract
from tapelake.schemas import BOOK_SIDE, DEC

PIPELINE_VERSION = 1
# fixed values: event types and the exact keys of their payloads
PLAIN_KEYS = ("data", "symbol", "topic")
BOOK_KEYS = ("data", "depth", "granularity", "messageType", "symbol", "timestamp_ms", "topic")
DATA_KEYS = {
    "ask_bid_price": ("askPrice", "askSize", "bidPrice", "bidSize"),
    "mark_price": ("markPrice",),
    "spot_price": ("spotPrice",),
    "funding_rate_estimation": ("fundingRateEstimation",),
    "orderbook": ("ask", "bid"),
}
FUNDING_KEYS = ("estimatedFundingRate", "nextFundingTimestamp")
SIDE_KEYS = ("endPrice", "levels", "startPrice")
LEVEL_KEYS = ("price", "quantity")
TYPES = tuple(DATA_KEYS)


def _j() -> Column:
    return F.col("_j")


def _json(v: Column) -> Column:
    return F.to_json(v)


def _keys_are(v: Column, names: tuple[str, ...]) -> Column:
    """An object with exactly these keys (names sorted)."""
    return F.coalesce(F.array_sort(F.json_object_keys(_json(v))) == F.array(*map(F.lit, names)), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(extract.kind(v).startswith("OBJECT"), F.lit(False))


def _amount_code(text: Column, is_text: Column, zero: bool = False, negative: bool = False) -> Column:
    """invalid_decimal, impossible_value or NULL for what must be a decimal string."""
    value = text.try_cast("decimal(38,18)")
    wrong = F.lit(False)
    if not negative:
        wrong = wrong | (value < 0)
    if not zero:
        wrong = wrong | (value == 0)
    return F.when(~F.coalesce(is_text, F.lit(False)) | value.isNull(), "invalid_decimal").when(wrong, "impossible_value")


def _field_code(path: str, zero: bool = False, negative: bool = False) -> Column:
    x = extract.at(_j(), path)
    return _amount_code(F.try_variant_get(x, "$", "string"), extract.kind(x) == "STRING", zero, negative)


def _amount(path: str) -> Column:
    return F.try_variant_get(_j(), path, "string").try_cast(DEC)


def _time_code(path: str, scale: float) -> Column:
    x = extract.at(_j(), path)
    numeric = extract.kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    value = F.try_variant_get(x, "$", "double") * scale
    return F.when(~F.coalesce(numeric, F.lit(False)) | F.isnan(value) | (value < -62135596800) | (value >= 253402300800), "invalid_timestamp")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df plus columns that are computed once a row: a generator of one row, through which no expression is copied."""
    made = F.explode(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))).alias("_made")
    return df.select("*", made).select(*df.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


CLEAN_LEVEL = "OBJECT<price: STRING, quantity: STRING>"


def _levels(side: str) -> Column:
    """Each level's shape, and its price and quantity where these are decimal strings; NULL if levels is no array."""
    levels = F.when(F.col("event_type") == "orderbook", F.try_variant_get(_j(), f"$.data.{side}.levels", "array<variant>"))
    text = lambda x, name: F.when(extract.kind(extract.at(x, f"$.{name}")) == "STRING", F.try_variant_get(x, f"$.{name}", "string")).try_cast(DEC)
    shape = lambda x: F.when(extract.kind(x) == CLEAN_LEVEL, True).otherwise(_keys_are(x, LEVEL_KEYS))
    return F.transform(levels, lambda x: F.struct(shape(x).alias("whole"), text(x, "price").alias("price"), text(x, "quantity").alias("quantity")))


def _side_code(side: str) -> Column:
    """The first failing check of a side; levels in their order, the checks of each one too."""
    prices = F.transform(F.col(f"_{side}"), lambda x: x["price"])

    def code(x: Column, k: Column) -> Column:
        return (
            F.when(~x["whole"], "payload_contract").when(x["price"].isNull(), "invalid_decimal").when(x["price"] <= 0, "impossible_value").when(F.array_position(prices, x["price"]) <= k, "duplicate_level")
            .when(x["quantity"].isNull(), "invalid_decimal").when(x["quantity"] < 0, "impossible_value")
        )

    v = extract.at(_j(), f"$.data.{side}")
    first_bad = F.get(F.filter(F.transform(F.col(f"_{side}"), code), lambda c: c.isNotNull()), 0)
    return F.coalesce(
        F.when(~_is_object(v) | ~_keys_are(v, SIDE_KEYS), "payload_contract"), _field_code(f"$.data.{side}.startPrice"), _field_code(f"$.data.{side}.endPrice"), F.when(F.col(f"_{side}").isNull(), "payload_contract"), first_bad,
    )


def _side(side: str) -> Column:
    return F.transform(F.col(f"_{side}"), lambda x: F.struct(x["price"], x["quantity"])).cast(BOOK_SIDE)


def error_code() -> Column:
    """The first failing check of an event (columns of MARKET_EVENTS, _j, the parsed payload, and _bid and _ask, its levels), or NULL."""
    t = F.col("event_type")
    data = extract.at(_j(), "$.data")
    identity = F.when(F.col("id").isNull(), "missing_identity").when(F.col("received_at").isNull(), "invalid_timestamp")
    root = F.when(t == "orderbook", _keys_are(_j(), BOOK_KEYS)).otherwise(_keys_are(_j(), PLAIN_KEYS))
    head = F.coalesce(
        F.when(~F.coalesce(t.isin(*TYPES), F.lit(False)), "unsupported_event_type"), F.when(~_is_object(_j()) | ~root, "payload_contract"),
        F.when(~(F.try_variant_get(_j(), "$.topic", "string").eqNullSafe(t) & F.try_variant_get(_j(), "$.symbol", "string").eqNullSafe(F.col("symbol"))), "identity_mismatch"),
        F.when(~_is_object(data), "payload_contract"),
    )
    shape = lambda kind: F.when(~_keys_are(data, DATA_KEYS[kind]), "payload_contract")
    quote = F.coalesce(shape("ask_bid_price"), _field_code("$.data.bidPrice"), _field_code("$.data.askPrice"), F.when(_amount("$.data.bidPrice") >= _amount("$.data.askPrice"), "crossed_quote"), identity, _field_code("$.data.bidSize", zero=True), _field_code("$.data.askSize", zero=True))
    nested = extract.at(_j(), "$.data.fundingRateEstimation")
    funding = F.coalesce(shape("funding_rate_estimation"), F.when(~_is_object(nested) | ~_keys_are(nested, FUNDING_KEYS), "payload_contract"), identity, _field_code("$.data.fundingRateEstimation.estimatedFundingRate", zero=True, negative=True), _time_code("$.data.fundingRateEstimation.nextFundingTimestamp", 1.0))
    kind = extract.at(_j(), "$.messageType")
    message = F.try_variant_get(kind, "$", "string")
    depth = extract.at(_j(), "$.depth")
    best_bid, best_ask = F.array_max(F.transform("_bid", lambda x: x["price"])), F.array_min(F.transform("_ask", lambda x: x["price"]))
    snapshot = message == "Snapshot"
    book = F.coalesce(
        F.when(~F.coalesce((extract.kind(kind) == "STRING") & message.isin("Snapshot", "Update"), F.lit(False)), "unknown_message_type"), F.when(~F.coalesce(extract.kind(depth) == "BIGINT", F.lit(False)), "payload_contract"),
        F.when(~F.try_variant_get(depth, "$", "bigint").between(1, 100), "impossible_value"), _time_code("$.timestamp_ms", 0.001), _field_code("$.granularity"), shape("orderbook"), _side_code("bid"), _side_code("ask"),
        F.when(snapshot & ((F.size("_bid") == 0) | (F.size("_ask") == 0)), "invalid_snapshot"), F.when(snapshot & (best_bid >= best_ask), "crossed_book"), identity,
    )
    price = lambda name, k: F.coalesce(shape(k), identity, _field_code(f"$.data.{name}"))
    body = F.when(t == "ask_bid_price", quote).when(t == "mark_price", price("markPrice", "mark_price")).when(t == "spot_price", price("spotPrice", "spot_price")).when(t == "funding_rate_estimation", funding).when(t == "orderbook", book)
    return F.coalesce(head, body)


@dataclass(frozen=True)
class Normalized:
    best_quotes: DataFrame
    reference_prices: DataFrame
    funding_estimates: DataFrame
    orderbook_events: DataFrame
    errors: DataFrame


def checked(events: DataFrame) -> DataFrame:
    """events plus _j, _bid, _ask and error_code, each computed once a row."""
    parsed = _once(events, _j=F.try_parse_json("payload"))
    return _once(_once(parsed, _bid=_levels("bid"), _ask=_levels("ask")), error_code=error_code())


def normalize(events: DataFrame, skip_unsupported: bool = False) -> Normalized:
    """skip_unsupported: the archive leaves events of other types out, the incremental normalizer reports them."""
    rows = checked(events)
    t = F.col("event_type")
    good = rows.where("error_code IS NULL")
    quality = F.when(t != "orderbook", "validated").when(F.col("schema_version") == 1, "best_effort_legacy").otherwise("sequence_unverified")
    keep = [
        F.col("id").alias("raw_event_id"), "received_at", F.col("received_at").alias("available_at"), "exchange_at", "symbol", "source", "connection_id", "local_sequence", "exchange_sequence",
        F.col("schema_version").alias("raw_schema_version"), F.lit(PIPELINE_VERSION).cast("short").alias("pipeline_version"), quality.alias("data_quality"),
    ]
    bids, asks = _side("bid"), _side("ask")
    failed = rows.where("error_code IS NOT NULL")
    if skip_unsupported:
        failed = failed.where("error_code <> 'unsupported_event_type'")
    next_at = F.timestamp_micros((F.try_variant_get(_j(), "$.data.fundingRateEstimation.nextFundingTimestamp", "double") * 1e6).cast("bigint"))
    return Normalized(
        good.where(t == "ask_bid_price").select(*keep, *[_amount(f"$.data.{k}").alias(n) for k, n in (("bidPrice", "bid_price"), ("bidSize", "bid_size"), ("askPrice", "ask_price"), ("askSize", "ask_size"))]),
        good.where(t.isin("mark_price", "spot_price")).select(*keep, F.when(t == "mark_price", "mark").otherwise("spot").alias("price_kind"), F.coalesce(_amount("$.data.markPrice"), _amount("$.data.spotPrice")).alias("price")),
        good.where(t == "funding_rate_estimation").select(*keep, _amount("$.data.fundingRateEstimation.estimatedFundingRate").alias("estimated_rate"), next_at.alias("next_funding_at")),
        good.where(t == "orderbook").select(*keep, F.try_variant_get(_j(), "$.messageType", "string").alias("message_type"), F.try_variant_get(_j(), "$.depth", "smallint").alias("depth"), _amount("$.granularity").alias("granularity"), bids.alias("bids"), asks.alias("asks"), (F.size(bids) + F.size(asks)).cast("short").alias("changed_level_count")),
        failed.select(F.col("id").alias("raw_event_id"), "received_at", "event_type", F.lit(PIPELINE_VERSION).cast("short").alias("pipeline_version"), "error_code", F.substring(F.concat(F.col("error_code"), F.lit(" in "), F.coalesce(t, F.lit("?"))), 1, 160).alias("error_detail")),
    )
