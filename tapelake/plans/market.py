"""Registered queries over a tape of payloads: normalization, lookups, scans, exports, streams.

Events become payloads of six topics by their id; k decides which of them are malformed, and how.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.functions import extract
from tapelake.operators import archive, bundles, candles, joins, normalize, ordering, quality
from tapelake.plans.catalog import K, events, query, table
from tapelake.sources import sinks, tape
from tapelake.streaming import pipelines

DAY = datetime(2024, 1, 3, tzinfo=timezone.utc)
KINDS = ("ask_bid_price", "mark_price", "spot_price", "funding_rate_estimation", "orderbook", "trades")
TAPE_SQL = f"""e AS (SELECT event_id AS id, ts, {K} AS k, event_id % 6 AS t, {K} % 16 AS c, 'U' || user_id % 7 AS symbol, event_id % 3 AS version FROM events),
    n AS (SELECT *, CASE t WHEN 0 THEN 'ask_bid_price' WHEN 1 THEN 'mark_price' WHEN 2 THEN 'spot_price' WHEN 3 THEN 'funding_rate_estimation' WHEN 4 THEN 'orderbook' ELSE 'trades' END AS event_type, CASE WHEN c IN (5, 6) OR id % 4 = 0 THEN 'Snapshot' ELSE 'Update' END AS message,
        CASE WHEN t = 5 THEN 'unsupported_event_type' WHEN c = 0 THEN 'identity_mismatch' WHEN c = 1 THEN 'payload_contract' WHEN t = 0 AND c = 2 THEN 'crossed_quote' WHEN t IN (1, 2) AND c = 2 THEN 'invalid_decimal' WHEN t = 3 AND c = 2 THEN 'invalid_timestamp' WHEN t = 4 AND c = 2 THEN 'unknown_message_type'
            WHEN t = 3 AND c = 3 THEN 'invalid_decimal' WHEN c = 3 THEN 'impossible_value' WHEN t = 4 AND c = 4 THEN 'duplicate_level' WHEN t = 4 AND c = 5 THEN 'invalid_snapshot' WHEN t = 4 AND c = 6 THEN 'crossed_book' END AS code FROM e)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder: below spark.checkpoint.dir where that is set, a temporary one in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tapelake-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def payload_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as MARKET_EVENTS."""
    k, c, t, i = F.col("k"), F.col("k") % 16, F.col("event_id") % 6, F.col("event_id")
    symbol = F.concat(F.lit("U"), F.col("user_id") % 7)
    stated = F.when(c == 0, "other").otherwise(symbol)
    text = lambda template, *cells: F.format_string(template, stated, *cells)
    low, high = (k + 100).cast("string"), (k + 101).cast("string")
    quote = text('{"topic":"ask_bid_price","symbol":"%s","data":{"bidPrice":"%s","bidSize":"1","askPrice":"%s.5","askSize":"0"}}', F.when(c == 3, F.lit("-1")).when(c == 2, high + 1).otherwise(low), high)
    price = F.when(c == 2, F.lit("12")).when(c == 3, F.lit('"0"')).otherwise(F.concat(F.lit('"'), low, F.lit('.25"')))
    mark, spot = (text(f'{{"topic":"{n}_price","symbol":"%s","data":{{"{n}Price":%s}}}}', price) for n in ("mark", "spot"))
    seconds = F.floor(F.col("ts").cast("timestamp").cast("double")).cast("bigint").cast("string")
    funding = text(
        '{"topic":"funding_rate_estimation","symbol":"%s","data":{"fundingRateEstimation":{"estimatedFundingRate":"%s","nextFundingTimestamp":%s}}}',
        F.when(c == 3, F.lit("x")).otherwise(F.concat(F.lit("-0.0"), k.cast("string"))), F.when(c == 2, F.lit("true")).otherwise(seconds),
    )
    level = lambda p, q: F.concat(F.lit('{"price":"'), p.cast("string"), F.lit('","quantity":"'), q.cast("string"), F.lit('"}'))
    bids = F.when(c == 5, F.lit("")).when(c == 4, F.concat_ws(",", level(k + 50, k + 1), level(k + 50, k + 1))).when(c == 6, level(k + 60, k + 1)).otherwise(F.concat_ws(",", level(k + 50, k + 1), level(k + 40, k + 1)))
    side = '{"startPrice":"1","endPrice":"2","levels":[%s]}'
    book = text(
        f'{{"topic":"orderbook","symbol":"%s","messageType":"%s","depth":%s,"granularity":"0.1","timestamp_ms":1704067200000,"data":{{"bid":{side},"ask":{side}}}}}',
        F.when(c == 2, "Delta").when(c.isin(5, 6) | (i % 4 == 0), "Snapshot").otherwise("Update"), F.when(c == 3, F.lit("101")).otherwise(F.lit("20")), bids, level(k + 60, F.lit(1)),
    )
    trade = text('{"topic":"trades","symbol":"%s","data":{"trade":{"price":"%s.5","quantity":%s}}}', low, F.when(k % 5 == 0, F.lit("null")).otherwise(low))
    body = F.when(c == 1, F.lit("{")).otherwise(F.when(t == 0, quote).when(t == 1, mark).when(t == 2, spot).when(t == 3, funding).when(t == 4, book).otherwise(trade))
    at = F.col("ts").cast("timestamp")
    null = lambda kind: F.lit(None).cast(kind)
    return events(spark, sf_dir).select(
        i.alias("id"), at.alias("received_at"), F.when(k % 4 != 0, at - F.make_dt_interval(secs=(k % 4).cast("decimal(18,6)"))).alias("exchange_at"), F.lit("feed").alias("source"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (t + 1).cast("int")).alias("event_type"),
        symbol.alias("symbol"), F.when(k % 3 != 0, k).alias("sequence"), F.concat(F.lit("c"), F.col("user_id") % 5).alias("connection_id"), i.alias("local_sequence"), null("long").alias("exchange_sequence"), (i % 3).cast("short").alias("schema_version"), F.col("value").alias("latency_ms"), body.alias("payload"),
    )


@query(f"WITH {TAPE_SQL} SELECT event_type, coalesce(code, 'ok') AS error_code, count(*) AS events FROM n GROUP BY ALL")
def q_error_codes(spark, sf_dir):
    return normalize.checked(payload_tape(spark, sf_dir)).groupBy("event_type", F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count(F.lit(1)).alias("events"))


@query(f"WITH {TAPE_SQL} SELECT symbol, count(*) AS rows, sum(k + 100)::BIGINT AS bids, sum(2 * (k + 101) + 1)::BIGINT AS asks2, count(*) FILTER (version = 1) AS legacy, min(id) AS first_id FROM n WHERE t = 0 AND code IS NULL GROUP BY symbol")
def q_quotes(spark, sf_dir):
    rows = normalize.normalize(payload_tape(spark, sf_dir)).best_quotes
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum("bid_price").cast("long").alias("bids"), F.sum(F.col("ask_price") * 2).cast("long").alias("asks2"), F.count_if(F.col("raw_schema_version") == 1).alias("legacy"), F.min("raw_event_id").alias("first_id"))


@query(f"WITH {TAPE_SQL} SELECT CASE t WHEN 1 THEN 'mark' ELSE 'spot' END AS price_kind, symbol, count(*) AS rows, sum(4 * (k + 100) + 1)::BIGINT AS prices4 FROM n WHERE t IN (1, 2) AND code IS NULL GROUP BY ALL")
def q_reference_prices(spark, sf_dir):
    rows = normalize.normalize(payload_tape(spark, sf_dir)).reference_prices
    return rows.groupBy("price_kind", "symbol").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("price") * 4).cast("long").alias("prices4"))


@query(f"""WITH {TAPE_SQL} SELECT symbol, count(*) AS rows, round(sum(('-0.0' || k)::DOUBLE), 6) AS rates, date_trunc('second', min(ts)) AS first_at, date_trunc('second', max(ts)) AS last_at FROM n WHERE t = 3 AND code IS NULL GROUP BY symbol""")
def q_funding(spark, sf_dir):
    rows = normalize.normalize(payload_tape(spark, sf_dir)).funding_estimates
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("estimated_rate").cast("double")), 6).alias("rates"), F.min("next_funding_at").alias("first_at"), F.max("next_funding_at").alias("last_at"))


@query(f"""WITH {TAPE_SQL} SELECT message AS message_type, CASE version WHEN 1 THEN 'best_effort_legacy' ELSE 'sequence_unverified' END AS data_quality, count(*) AS rows, sum(CASE WHEN c = 5 THEN 1 WHEN c = 6 THEN 2 ELSE 3 END)::BIGINT AS levels,
    sum(CASE WHEN c = 5 THEN 0 WHEN c = 6 THEN k + 1 ELSE 2 * (k + 1) END)::BIGINT AS quantity FROM n WHERE t = 4 AND code IS NULL GROUP BY ALL""")
def q_typed_books(spark, sf_dir):
    rows = normalize.normalize(payload_tape(spark, sf_dir)).orderbook_events
    quantity = F.aggregate("bids", F.lit(0).cast("decimal(38,18)"), lambda a, x: (a + x["quantity"]).cast("decimal(38,18)"))
    return rows.groupBy("message_type", "data_quality").agg(F.count(F.lit(1)).alias("rows"), F.sum("changed_level_count").alias("levels"), F.sum(quantity).cast("long").alias("quantity"))


@query(f"""WITH {TAPE_SQL} SELECT CASE WHEN code IS NOT NULL THEN 'errors' WHEN t = 0 THEN 'best_quotes' WHEN t IN (1, 2) THEN 'reference_prices' WHEN t = 3 THEN 'funding_estimates' ELSE 'orderbook_events' END AS "table", count(*) AS rows FROM n GROUP BY 1""")
def q_table_counts(spark, sf_dir):
    parts = normalize.normalize(payload_tape(spark, sf_dir))
    return bundles.counts(**{n: getattr(parts, n) for n in pipelines.TABLES})


@query("SELECT coalesce(max(event_id), 0) AS high_water FROM events")
def q_high_water(spark, sf_dir):
    return bundles.high_water(table(spark, sf_dir, "events"), "event_id")


@query(f"WITH {TAPE_SQL} SELECT id, event_type FROM n WHERE symbol = 'U3' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND t IN (0, 4)")
def q_received(spark, sf_dir):
    return tape.received(payload_tape(spark, sf_dir), "U3", DAY, datetime(2024, 1, 20, tzinfo=timezone.utc), ["ask_bid_price", "orderbook"]).select("id", "event_type")


@query("SELECT event_id AS id FROM events WHERE event_id > 1000 AND event_id <= 9000 ORDER BY event_id LIMIT 750")
def q_page(spark, sf_dir):
    return tape.page(tape.guarded(payload_tape(spark, sf_dir), 10_000_000), 1000, 9000, 750).select("id")


@query(f"""WITH {TAPE_SQL} SELECT id AS raw_event_id, event_type AS topic, CASE version WHEN 0 THEN 1 ELSE version END::SMALLINT AS raw_schema_version, CASE WHEN c = 1 THEN NULL WHEN t = 1 AND c NOT IN (0, 2, 3)
    THEN '{{"data":{{"markPrice":"' || (k + 100) || '.25"}},"symbol":"' || symbol || '","topic":"mark_price"}}' END AS payload FROM n WHERE t = 1 AND c NOT IN (0, 2, 3)""")
def q_export_projection(spark, sf_dir):
    rows = payload_tape(spark, sf_dir).where("event_type = 'mark_price'").withColumn("c", F.expr("regexp_extract(payload, '\"markPrice\":(.*?)}', 1)"))
    good = rows.where("payload = '{' OR (c NOT IN ('12', '\"0\"') AND payload NOT LIKE '%\"symbol\":\"other\"%')").drop("c")
    return bundles.projection(good).select("raw_event_id", "topic", "raw_schema_version", F.col("payload_json").alias("payload"))


@query(f"WITH {TAPE_SQL} SELECT id, CASE WHEN k % 3 <> 0 THEN k ELSE -1 END AS legacy_sequence, CASE version WHEN 0 THEN 1 ELSE version END::SMALLINT AS schema_version FROM n")
def q_raw_projection(spark, sf_dir):
    return archive.raw_projection(payload_tape(spark, sf_dir)).select("id", F.coalesce("legacy_sequence", F.lit(-1)).alias("legacy_sequence"), "schema_version")


@query(f"WITH {TAPE_SQL} SELECT event_type, count(*) AS rows, count(CASE WHEN k % 4 <> 0 THEN 1 END) AS timed FROM n WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05' GROUP BY event_type")
def q_sample(spark, sf_dir):
    rows = bundles.sample(payload_tape(spark, sf_dir), DAY, datetime(2024, 1, 5, tzinfo=timezone.utc), 10_000_000)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count("exchange_at").alias("timed"))


@query(f"""WITH {TAPE_SQL}, x AS (SELECT *, ts - to_seconds(k % 4) AS xt, k + 100.5 AS p FROM n WHERE t = 5 AND c <> 1)
    SELECT symbol, date_trunc('minute', xt) AS "timestamp", arg_min(p, (ts, id))::DOUBLE AS open, max(p)::DOUBLE AS high, min(p)::DOUBLE AS low, arg_max(p, (ts, id))::DOUBLE AS close, CASE WHEN count(*) FILTER (k % 5 = 0) = 0 THEN sum(k + 100)::DOUBLE END AS volume, count(*) AS trade_count FROM x GROUP BY ALL""")
def q_payload_candles(spark, sf_dir):
    return candles.payload_candles(payload_tape(spark, sf_dir), "minute")


@query(f"""WITH {TAPE_SQL}, x AS (SELECT *, date_trunc('second', ts) AS s FROM n) SELECT id, CASE k % 5 WHEN 0 THEN NULL ELSE s END AS at, CASE k % 5 WHEN 0 THEN NULL ELSE greatest(0, epoch_us(ts) - epoch_us(s)) / 1000.0::DOUBLE END AS latency_ms FROM x""")
def q_exchange_times(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "k")
    s = F.floor(F.col("ts").cast("double")).cast("bigint")
    said = F.element_at(F.array(F.lit('{"time":true}'), F.format_string('{"timestamp":%d}', s * 1000), F.format_string('{"data":{"ts":"%d"}}', s), F.format_string('{"timestampMs":%d000000000}', s), F.concat(F.lit('{"createdAt":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))), (F.col("k") % 5 + 1).cast("int"))
    at = extract.exchange_time(F.try_parse_json(said))
    return rows.withColumn("at", at).select("id", "at", extract.latency_ms(F.col("ts"), F.col("at")).alias("latency_ms"))


@query(f"""SELECT event_id AS id, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN k + 1.0 WHEN 2 THEN k + 2.0 ELSE NULL END::DOUBLE AS first_present, CASE k % 4 WHEN 0 THEN k + 2.0 WHEN 1 THEN k + 1.0 WHEN 2 THEN k + 2.0 ELSE k + 3.0 END::DOUBLE AS first_valid, k % 4 = 2 AS snapshot_first, k % 4 IN (1, 2) AS snapshot_any,
    CASE k % 4 WHEN 0 THEN k + 11.5 WHEN 1 THEN k + 1 WHEN 2 THEN k + 2 ELSE k + 3 END::DOUBLE AS mid, CASE k % 4 WHEN 1 THEN k + 5 WHEN 2 THEN k + 6 WHEN 3 THEN k + 7 END::DOUBLE AS best FROM (SELECT event_id, {K} AS k FROM events)""")
def q_lookups(spark, sf_dir):
    k = F.col("k")
    forms = [
        F.format_string('{"price":null,"data":{"price":%d,"bid":%d,"ask":%d}}', k + 2, k + 11, k + 12), F.format_string('{"price":"%d","type":"update","data":{"isSnapshot":true,"bids":[[%d,1]]}}', k + 1, k + 5),
        F.format_string('{"data":{"price":%d,"messageType":"SNAPSHOT","bid":{"levels":[{"price":"%d"}]}}}', k + 2, k + 6), F.format_string('{"price":-1,"data":{"price":%d,"bids":{"price":%d}}}', k + 3, k + 7),
    ]
    v = F.try_parse_json(F.element_at(F.array(*forms), (k % 4 + 1).cast("int")))
    rows = events(spark, sf_dir).select(F.col("event_id").alias("id"), "k").withColumn("v", v)
    v = F.col("v")
    return rows.select(
        "id", extract.payload_number(v, ("price",)).alias("first_present"), extract.valid_number(v, ("price",)).alias("first_valid"), extract.is_snapshot_first(v).alias("snapshot_first"), extract.is_snapshot_any(v).alias("snapshot_any"), extract.mid_price(v).alias("mid"),
        F.when(k % 4 != 0, extract.best_level(v, ("bid", "bids"))).alias("best"),
    )


@query(f"""WITH {TAPE_SQL} SELECT symbol, count(*) AS row_count, CASE WHEN count(CASE WHEN k % 3 <> 0 THEN 1 END) > 0 THEN TRUE END AS sequenced, count(*) FILTER (CASE WHEN c = 1 THEN t = 5 WHEN t = 5 THEN FALSE WHEN t = 1 THEN c = 3 ELSE FALSE END) AS invalid_prices FROM n WHERE t IN (0, 1, 5) GROUP BY symbol""")
def q_payload_report(spark, sf_dir):
    rows = payload_tape(spark, sf_dir).where(F.col("event_type").isin("ask_bid_price", "mark_price", "trades"))
    rows = rows.select("id", "symbol", "source", F.col("event_type").alias("topic"), "received_at", "exchange_at", "sequence", F.col("payload").alias("payload_json"))
    out = quality.payload_report(rows, ["received_at", "id"], F.lit(DAY), F.lit(datetime(2030, 1, 1, tzinfo=timezone.utc)), by=("symbol",))
    return out.select("symbol", "row_count", F.col("sequence_anomalies").isNotNull().alias("sequenced"), "invalid_prices")


@query("SELECT count(*) AS rows, 0::BIGINT AS only_left, 0::BIGINT AS only_right FROM events")
def q_insert_twice(spark, sf_dir):
    rows, out = payload_tape(spark, sf_dir), scratch(spark, "inserted")
    for _ in range(2):
        sinks.insert_new(rows, out, ["id"])
    again = tape.tape(spark, out).select("id")
    apart = joins.same_set(again, rows.select("id")).agg(F.count_if(F.col("side") == "left").alias("only_left"), F.count_if(F.col("side") == "right").alias("only_right"))
    return again.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(apart))


@query("SELECT ts::DATE::VARCHAR AS date, 'U' || user_id % 7 AS symbol, count(*) AS rows, min(event_id) AS min_id, max(event_id) AS max_id FROM events GROUP BY ALL")
def q_archived(spark, sf_dir):
    out = scratch(spark, "archive")
    sinks.archive(payload_tape(spark, sf_dir), out)
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("date").cast("string").alias("date"), "symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


@query("SELECT event_id AS id, ts AS received_at FROM events WHERE event_id % 6 = 4")
def q_json_lines(spark, sf_dir):
    out = scratch(spark, "lines")
    sinks.json_lines(payload_tape(spark, sf_dir).where("event_type = 'orderbook'"), out, ["id"])
    return tape.json_lines(spark, out).select("id", "received_at")


@query(f"""WITH {TAPE_SQL}, w AS (SELECT * FROM n WHERE symbol = 'U1' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06')
    SELECT 'u1_20240103T000000000000Z_20240106T000000000000Z_v2' AS name, (SELECT count(*) FROM w) AS events, (SELECT count(DISTINCT date_trunc('second', ts - to_seconds(k % 4))) FROM w WHERE t = 5 AND c <> 1) AS candles, 'not_validated' AS quality_status, 0::BIGINT AS problems""")
def q_dataset(spark, sf_dir):
    root = scratch(spark, "data")
    path = bundles.export(payload_tape(spark, sf_dir), "U1", DAY, datetime(2024, 1, 6, tzinfo=timezone.utc), root)
    problems = len(bundles.manifest_problems(spark, path))
    counts = F.try_variant_get(F.try_parse_json("manifest"), "$.row_counts", "map<string,bigint>")
    return bundles.datasets(spark, root).select("name", counts["events"].alias("events"), counts["candles_1s"].alias("candles"), "quality_status", F.lit(problems).cast("long").alias("problems"))


@query(f"WITH {TAPE_SQL} SELECT id, k + 100.25::DOUBLE AS price FROM n WHERE t = 1 AND c NOT IN (0, 1, 2, 3) AND k % 2 = 0")
def q_callback_replay(spark, sf_dir):
    rows = payload_tape(spark, sf_dir).where("event_type = 'mark_price' AND payload <> '{'").withColumnRenamed("payload", "payload_json").select("id", "received_at", "exchange_at", "symbol", "payload_json")

    def signal(row: dict) -> dict | None:
        price = row["payload"]["data"]["markPrice"]
        fits = row["payload"]["symbol"] == row["symbol"] and isinstance(price, str) and float(price) > 0 and int(float(price)) % 2 == 0
        return {"id": row["id"], "price": float(price)} if fits else None

    return bundles.replay(rows, signal, "id long, price double")


@query("SELECT event_type, date_trunc('minute', ts) AS \"timestamp\", count(*) AS \"count\" FROM events GROUP BY ALL HAVING count(*) > 1")
def q_repeated_candles(spark, sf_dir):
    return ordering.repeated_candles(table(spark, sf_dir, "events").select("event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("timestamp")), ["event_type"], "timestamp")


@query("SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events QUALIFY place <= 500")
def q_receipt_order(spark, sf_dir):
    rows = ordering.receipt_order(payload_tape(spark, sf_dir).select("id", "received_at")).limit(500)
    return ordering.running(rows.withColumn("_all", F.lit(1)), ["_all"], ["received_at", "id"], "place", F.lit(1).cast("long")).select("id", "place")


@query("SELECT event_id AS id FROM events WHERE event_type = 'view' ORDER BY event_id // 2, ts, event_id LIMIT 300")
def q_book_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("received_at"), F.lit(None).cast("long").alias("exchange_sequence"), F.floor(F.col("event_id") / 2).alias("sequence"))
    return ordering.book_order(rows).select("id").limit(300)


@query(f"""WITH {TAPE_SQL}, x AS (SELECT *, ts - to_seconds(k % 4) AS xt, k + 100.5 AS p FROM n WHERE t = 5 AND c <> 1)
    SELECT symbol, date_trunc('second', xt) AS "timestamp", arg_min(p, (ts, id))::DOUBLE AS open, max(p)::DOUBLE AS high, min(p)::DOUBLE AS low, arg_max(p, (ts, id))::DOUBLE AS close, CASE WHEN count(*) FILTER (k % 5 = 0) = 0 THEN sum(k + 100)::DOUBLE END AS volume, count(*) AS trade_count FROM x GROUP BY ALL""")
def q_stream_candles(spark, sf_dir):
    raw = scratch(spark, "raw")
    payload_tape(spark, sf_dir).write.parquet(raw)
    name = f"bars_{uuid.uuid4().hex}"
    writer = pipelines.candle_stream(pipelines.raw_stream(spark, raw)).writeStream.format("memory").queryName(name).outputMode("complete")
    writer.option("checkpointLocation", scratch(spark, "bars")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(f"""WITH {TAPE_SQL} SELECT CASE WHEN code IS NOT NULL THEN 'errors' WHEN t = 0 THEN 'best_quotes' WHEN t IN (1, 2) THEN 'reference_prices' WHEN t = 3 THEN 'funding_estimates' ELSE 'orderbook_events' END AS "table", count(*) AS rows FROM n GROUP BY 1""")
def q_stream_normalize(spark, sf_dir):
    raw, out = scratch(spark, "raw"), scratch(spark, "typed")
    payload_tape(spark, sf_dir).write.parquet(raw)
    for _ in range(2):  # a second stream from the start adds nothing
        pipelines.normalize_stream(pipelines.raw_stream(spark, raw), out, scratch(spark, "checkpoint")).awaitTermination()
    return bundles.counts(**{n: spark.read.parquet(f"{out}/{n}") for n in pipelines.TABLES})
