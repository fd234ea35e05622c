"""Data-quality figures of tapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import classify, extract
from tapelake.operators import ordering


def daily_quality(df: DataFrame, symbol: str = "symbol", kind: str = "event_type", exchange: str = "exchange_at", seq: str = "sequence", latency: str = "latency_ms") -> DataFrame:
    return df.groupBy(symbol, kind).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col(exchange).isNull()).alias("missing_exchange_time"), F.count_if(F.col(seq).isNull()).alias("missing_sequence"),
        F.avg(latency).alias("avg_latency_ms"), F.max(latency).alias("max_latency_ms"),
    )


def status(df: DataFrame, clock: str, now: Column, latency: str, seconds: int = 60) -> DataFrame:
    recent = F.col(clock) >= now - F.expr(f"INTERVAL {seconds} SECONDS")
    return df.agg(F.count(F.lit(1)).alias("events"), F.min(clock).alias("first_at"), F.max(clock).alias("last_at"), F.count_if(recent).alias("recent_events"), F.avg(F.when(recent, F.col(latency))).alias("recent_latency_ms"))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of rows that agree in every column."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def logical_duplicates(df: DataFrame, *key: Column) -> DataFrame:
    names = [f"k{i}" for i in range(len(key))]
    known = df.select(*[k.alias(n) for k, n in zip(key, names, strict=True)]).dropna()
    return known.groupBy(*names).count().where("count > 1").agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra_rows"))


def sequence_availability(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    have, rows = F.count(seq), F.count(F.lit(1))
    return df.groupBy(*by).agg(rows.alias("rows"), have.alias("with_sequence"), F.when(have == 0, "absent").when(have == rows, "present").otherwise("partial").alias("availability"))


def malformed(now: Column, clock: str, identity: list[str], latency: str) -> Column:
    out = F.col(clock) > now + F.expr("INTERVAL 5 MINUTES")
    for name in identity:
        out = out | F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")
    return F.coalesce(out, F.lit(False)) | F.coalesce(F.col(latency) < 0, F.lit(False))


def half_counts(df: DataFrame, clock: str, start: Column, middle: Column, end: Column) -> DataFrame:
    """Counts of the two halves of a window and their rate state, in one pass."""
    c = F.col(clock)
    counted = df.agg(F.count_if((c >= start) & (c < middle)).alias("previous_half_count"), F.count_if((c >= middle) & (c <= end)).alias("current_half_count"))
    return counted.withColumn("rate_state", classify.rate_state(F.col("current_half_count"), F.col("previous_half_count")))


VERSION = 5  # fixed value: version of the report


def identity(columns: list[str]) -> Column:
    """One value for rows that agree in every column."""
    how = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.sha2(F.to_json(F.struct(*columns), how), 256)


def report(
    df: DataFrame, order: list[str], *, by: tuple[str, ...] = (), start: Column, end: Column, received: str = "received_at", exchange: str = "exchange_at", source: str = "source", topic: str = "topic", seq: str = "sequence",
    snapshot: Column, price: Column, priced: Column, traded: Column, tolerance_s: float = 5.0, gap_s: float = 60.0, jump_percent: float = 20.0, chunk: Column | None = None, same: list[str] | None = None,
) -> DataFrame:
    """One row a dataset (`by`; without it one row, and an empty table is rejected): counts of every check, status and findings.

    Receipt order, gaps and prices follow the dataset's file order (`order`); exchange times and sequences follow it within a
    source and topic. Missing values are left out before neighbours are compared. `price` is the row's price if it is valid,
    `priced` whether it has one at all, `traded` whether it must have one. Rows that agree in the columns `same` (all) are duplicates. sequence_anomalies is NULL where no row has a sequence.
    """
    if gap_s <= 0 or jump_percent <= 0 or tolerance_s < 0:
        raise ValueError("gap_s and jump_percent must be above zero, tolerance_s not below")
    keys, r, x = list(by), F.col(received), F.col(exchange)
    slack = F.expr(f"INTERVAL {tolerance_s} SECONDS")
    rows = df.select(*keys, *[c for c in dict.fromkeys([*order, received, exchange, source, topic, seq]) if c not in keys], *([chunk.alias("_part")] if chunk is not None else []), start.alias("_start"), end.alias("_end"), snapshot.alias("_snap"), price.alias("_price"), priced.alias("_priced"), traded.alias("_traded"), identity(same or df.columns).alias("_same"))
    part = F.col("_part") if chunk is not None else None
    rows = ordering.previous(rows, keys, order, {"_r": r, "_p": F.col("_price")}, part)
    rows = ordering.previous(rows, [*keys, source, topic], order, {"_x": x, "_q": F.col(seq)}, part)
    inside, near = (x >= F.col("_start")) & (x < F.col("_end")), (x >= F.col("_start") - slack) & (x < F.col("_end") + slack)
    zero = F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), zero)
    figures = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(received).alias("first_at"), F.max(received).alias("last_at"), F.min(exchange).alias("first_exchange_at"), F.max(exchange).alias("last_exchange_at"),
        F.count_if(F.when(F.col("_priced"), F.col("_price").isNull()).otherwise(F.col("_traded"))).alias("invalid_prices"),
        total(ordering.fell(F.col("_r"), r)).alias("receipt_order"), total(ordering.fell(F.col("_x"), x)).alias("exchange_order"),
        F.count_if((r < F.col("_start")) | (r >= F.col("_end"))).alias("receipt_range"), F.count_if(~near).alias("exchange_range"), F.count_if(~inside & near).alias("excursions"),
        F.when(F.count(seq) > 0, total(ordering.broken(F.col("_q"), F.col(seq), F.col("_snap")))).alias("sequence_anomalies"),
        F.coalesce(F.max(ordering.seconds_since(F.col("_r"), r)), F.lit(0.0)).alias("largest_gap_s"), total(ordering.jumped(F.col("_p"), F.col("_price"), jump_percent)).alias("jumps"),
    )
    copies = rows.groupBy(*keys, "_same").count().groupBy(*keys).agg(F.coalesce(F.sum(F.col("count") - 1), zero).alias("duplicates"))
    name = F.concat_ws(":", F.coalesce(F.col(source), F.lit("None")), F.coalesce(F.col(topic), F.lit("None")))
    streams = sequence_availability(rows, [*keys, source, topic], seq).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "availability")))).alias("sequence_availability"), F.array_sort(F.collect_list(F.when(F.col("availability") == "partial", name))).alias("partial_streams")
    )
    for more in (copies, streams):
        figures = figures.join(more, keys) if keys else figures.crossJoin(F.broadcast(more))
    return judged(figures, gap_s, jump_percent)


def judged(figures: DataFrame, gap_s: float, jump_percent: float) -> DataFrame:
    """figures plus findings, one sentence each, and the status."""
    c = F.col
    disorder, outside = c("receipt_order") + c("exchange_order"), c("receipt_range") + c("exchange_range")
    gap, seq = c("largest_gap_s") > gap_s, F.coalesce("sequence_anomalies", F.lit(0))
    said = [  # fixed values: sentences
        (c("row_count") == 0, F.lit("Dataset contains no market events.")), (disorder > 0, F.format_string("Found %d timestamp ordering violation(s).", disorder)),
        (outside > 0, F.format_string("Found %d timestamp(s) outside the manifest range.", outside)), (c("duplicates") > 0, F.format_string("Found %d duplicate event(s).", "duplicates")),
        (c("invalid_prices") > 0, F.format_string("Found %d invalid price value(s).", "invalid_prices")), (seq > 0, F.format_string("Found %d sequence anomaly/anomalies.", seq)),
        (gap, F.format_string("Largest timestamp gap %.3fs exceeds %.3fs.", c("largest_gap_s"), F.lit(float(gap_s)))),
        (c("jumps") > 0, F.format_string("Found %d price discontinuity/discontinuities at or above %.3f%%; these may be real market moves and require review.", c("jumps"), F.lit(float(jump_percent)))),
        (F.size("partial_streams") > 0, F.format_string("Sequence metadata is partial for stream(s): %s.", F.array_join("partial_streams", ", "))),
    ]
    findings = F.array_compact(F.array(*[F.when(hit, text) for hit, text in said]))
    findings = F.when(F.size(findings) == 0, F.array(F.lit("No configured data-quality anomalies found."))).otherwise(findings)
    found = c("duplicates") + c("invalid_prices") + seq + gap.cast("int") + c("jumps")
    status = classify.quality_status(c("row_count"), disorder, outside, found, F.size("partial_streams") > 0)
    return figures.withColumns({"status": status, "findings": findings})


def payload_report(events: DataFrame, order: list[str], start: Column, end: Column, same: list[str] | None = None, **how) -> DataFrame:
    """report of an exported tape (source, topic, payload_json): prices and snapshot marks are read from the payload."""
    rows, same = events.withColumn("_j", extract.parsed(F.col("payload_json"))), same or events.columns
    there, value = extract.price_for_quality(F.col("_j"))
    rows = rows.withColumns({"_there": there, "_value": value, "_mark": (F.col("topic") == "orderbook") & F.coalesce(extract.is_snapshot_any(F.col("_j")), F.lit(False))}).drop("_j")
    return report(rows, order, start=start, end=end, same=same, snapshot=F.col("_mark"), price=F.col("_value"), priced=F.coalesce("_there", F.lit(False)), traded=F.coalesce(F.col("topic") == "trades", F.lit(False)), **how)


def gate(status: Column, version: Column, allow_warnings: bool, changed: Column) -> Column:
    """What refuses a dataset's evaluation, or `accepted`; `changed`: how many inputs are not those that were validated, the manifest included."""
    return (
        F.when(status.isNull() | version.isNull(), "missing_report").when(version != VERSION, "unsupported_version").when(F.coalesce(changed, F.lit(0)) > 0, "inputs_changed").when(status == "rejected", "rejected")
        .when((status == "warning") & F.lit(not allow_warnings), "warnings_not_allowed").when(~status.isin("pass", "warning"), "invalid_status").otherwise("accepted")
    )
