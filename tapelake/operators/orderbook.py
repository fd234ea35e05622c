"""Order-book reconstruction: an ordered fold over snapshots and updates.

A snapshot, a new connection and a disconnect each reset all that the fold depends on, so a symbol's events split into
segments that are folded apart; segments are numbered by running sums over chunks, so that no task sorts a whole symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapelake.operators import ordering
from tapelake.schemas import BOOK_STATE_NAMES, BOOK_STATES

# fixed values: states
WAITING, BROKEN, CROSSED = "invalid_waiting_snapshot", "invalid_sequence", "invalid_crossed"
LEGACY, VERIFIED, UNVERIFIED = "valid_best_effort_legacy", "valid_sequence_verified", "valid_sequence_unverified"
Levels = dict[Decimal, Decimal]


@dataclass
class Ladder:
    """What a symbol's events so far leave: levels of both sides, the snapshot's grade, and what is wrong with it, if anything."""

    connection: str | None = None
    sides: tuple[Levels, Levels] = field(default_factory=lambda: ({}, {}))
    grade: str = UNVERIFIED
    fault: str | None = WAITING
    numbers: tuple[int | None, int | None] = (None, None)

    def seen(self) -> tuple:
        if self.fault:
            return self.fault, None, None, 0
        bids, asks = self.sides
        return self.grade, max(bids), min(asks), len(bids) + len(asks)


def continues(last: tuple[int | None, int | None], now: tuple[int | None, int | None], use_local: bool) -> bool:
    """By the exchange's numbers where both events have one, else the collector's must rise (if used and known)."""
    (x, m), (y, n) = last, now
    if x is not None and y is not None:
        return y == x + 1
    return not use_local or m is None or n is None or n > m


def advance(ladder: Ladder, kind: str, connection: str | None, grade: str, numbers: tuple[int | None, int | None], levels: tuple, use_local: bool) -> Ladder:
    """The ladder after an event. levels: (price, quantity) of bids and asks; quantity 0 takes a level away."""
    if connection != ladder.connection:
        ladder = Ladder(connection)
    if kind == "Disconnect":
        return Ladder(connection)
    fresh = kind == "Snapshot"
    if not fresh and ladder.fault:
        return ladder
    if not fresh and not continues(ladder.numbers, numbers, use_local):
        ladder.fault = BROKEN
        return ladder
    sides = ({}, {}) if fresh else ladder.sides
    for side, changes in zip(sides, levels, strict=True):
        side.update(changes)
        for price, quantity in changes:
            if not quantity:
                side.pop(price, None)
    bids, asks = sides
    sound = bids and asks and max(bids) < min(asks)
    return Ladder(connection, sides, grade if fresh else ladder.grade, None if sound else CROSSED, numbers)


def pairs(levels: list[dict] | None) -> list[tuple[Decimal, Decimal]]:
    return [(level["price"], level["quantity"]) for level in levels or ()]


def after(ladder: Ladder, event: dict, use_local: bool) -> Ladder:
    return advance(ladder, event["message_type"], event["connection_id"], event["grade"], (event["exchange_sequence"], event["local_sequence"]), (pairs(event["bids"]), pairs(event["asks"])), use_local)


def folded(batches: Iterator[pa.RecordBatch], use_local: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Folds rows that come sorted by symbol, segment and order; one ladder is held at a time, whatever the batches' borders."""
    ladder, held = Ladder(), None
    for batch in batches:
        out = []
        for e in batch.to_pylist():
            if (e["symbol"], e["segment"]) != held:
                ladder, held = Ladder(), (e["symbol"], e["segment"])
            ladder = after(ladder, e, use_local)
            out.append((e["symbol"], e["raw_event_id"], *ladder.seen()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(BOOK_STATE_NAMES, row, strict=True)) for row in out], schema=schema)


def grades(events: DataFrame) -> Column:
    """The grade that a snapshot gives its ladder."""
    legacy = F.col("data_quality") == "best_effort_legacy" if "data_quality" in events.columns else F.col("raw_schema_version") == 1
    return F.when(legacy, LEGACY).when(F.col("exchange_sequence").isNull(), UNVERIFIED).otherwise(VERIFIED)


def segments(events: DataFrame, order: list[str], chunk: Column | None = None) -> DataFrame:
    """events plus segment: a running count of what resets the fold."""
    rows = ordering.previous(events, ["symbol"], order, {"_line": F.struct("connection_id")}, chunk)
    reset = F.col("_line").isNull() | ~F.col("connection_id").eqNullSafe(F.col("_line.connection_id")) | F.col("message_type").isin("Snapshot", "Disconnect")
    return ordering.running(rows, ["symbol"], order, "segment", F.coalesce(reset, F.lit(False)).cast("long"), chunk).drop("_line")


def reconstruct(events: DataFrame, order: list[str], use_local_sequence: bool = True, by_segment: bool = True, chunk: Column | None = None) -> DataFrame:
    """State after each event of ORDERBOOK_EVENTS rows, folded along `order`; `chunk` never falls along it and splits a busy symbol."""
    cut = segments(events, order, chunk) if by_segment else events.withColumn("segment", F.lit(0).cast("long"))
    names = ["symbol", "segment", "raw_event_id", "connection_id", "exchange_sequence", "local_sequence", "message_type", "bids", "asks"]
    kept = cut.withColumn("grade", grades(events)).select(*names, "grade", *[c for c in order if c not in names])
    schema = to_arrow_schema(StructType.fromDDL(BOOK_STATES))
    return kept.repartition("symbol", "segment").sortWithinPartitions("symbol", "segment", *order).mapInArrow(lambda batches: folded(batches, use_local_sequence, schema), BOOK_STATES)


def histogram(states: DataFrame) -> DataFrame:
    return states.groupBy("symbol", "state").count()


def final_state(states: DataFrame) -> DataFrame:
    return states.groupBy("symbol").agg(F.max_by("state", "raw_event_id").alias("state"))


def best(side: Column, highest: bool) -> Column:
    """The best price of a ladder's side held as a map of price to quantity."""
    prices = F.map_keys(side)
    return F.array_max(prices) if highest else F.array_min(prices)
