"""Stated cases: candles, books, normalization codes, signals, backtests, admission, plans and states."""

import json
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tapelake import schemas
from tapelake.functions import classify, extract, text
from tapelake.operators import admission, archive, backtest, candles, joins, normalize, orderbook, ordering, paper, planning, quality, signals
from tapelake.sources import sinks, tape
from tapelake.streaming import pipelines

T0 = datetime(2026, 7, 29, 12)
EVENT = "id long, received_at timestamp, exchange_at timestamp, source string, event_type string, symbol string, sequence long, connection_id string, local_sequence long, exchange_sequence long, schema_version short, latency_ms double, payload string"


def event(i, kind, payload, at=0.0, connection="c", exchange=None, version=2):
    return (i, T0 + timedelta(seconds=at), None, "s", kind, "X/USDT-P", None, connection, i, exchange, version, None, payload if isinstance(payload, str) else json.dumps(payload))


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def quote(**data):
    return {"topic": "ask_bid_price", "symbol": "X/USDT-P", "data": {"bidPrice": "1", "bidSize": "0", "askPrice": "2", "askSize": "1"} | data}


def book(kind="Snapshot", bids=(("9", "1"),), asks=(("11", "1"),), **more):
    side = lambda ls: {"startPrice": "1", "endPrice": "2", "levels": [{"price": p, "quantity": q} for p, q in ls]}
    return {"topic": "orderbook", "symbol": "X/USDT-P", "messageType": kind, "depth": 20, "granularity": "0.1", "timestamp_ms": 1785326400000, "data": {"bid": side(bids), "ask": side(asks)}} | more


def test_candles_keep_receipt_order_and_null_volume(spark):
    rows = [(3, 1, 102, 2), (1, 0, 100, 1), (2, 0, 101, None)]
    got = candles.payload_candles(events(spark, [event(i, "trades", {"price": p, "quantity": q} if q else {"price": p}, at=s) for i, s, p, q in rows])).orderBy("timestamp").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.trade_count) for r in got] == [(100, 101, 100, 101, None, 2), (102, 102, 102, 102, 2.0, 1)]


def test_candles_look_into_the_trade_only(spark):
    rows = [event(1, "trades", {"data": {"trade": {"price": "2000.25", "quantity": "0.50"}}}), event(2, "trades", {"data": {"other": {"price": "1"}}}, at=5), event(3, "trades", {"price": "nan"}, at=6), event(4, "trades", {"price": True}, at=7)]
    got = candles.payload_candles(events(spark, rows)).collect()
    assert [(r.open, r.volume, r.trade_count) for r in got] == [(2000.25, 0.5, 1)]


@pytest.mark.parametrize(
    ("payload", "kind", "code"),
    [
        (quote(), "ask_bid_price", None),
        (quote(), "trades", "unsupported_event_type"),
        ({"topic": "x"}, "ask_bid_price", "payload_contract"),
        ("not json", "ask_bid_price", "payload_contract"),
        (quote() | {"symbol": "Y"}, "ask_bid_price", "identity_mismatch"),
        (quote() | {"data": 1}, "ask_bid_price", "payload_contract"),
        (quote(bidPrice=1), "ask_bid_price", "invalid_decimal"),
        (quote(bidPrice="x"), "ask_bid_price", "invalid_decimal"),
        (quote(bidPrice="-1"), "ask_bid_price", "impossible_value"),
        (quote(bidPrice="2"), "ask_bid_price", "crossed_quote"),
        (quote(bidPrice="2", askSize=1), "ask_bid_price", "crossed_quote"),
        ({"topic": "mark_price", "symbol": "X/USDT-P", "data": {"markPrice": "1.5"}}, "mark_price", None),
        ({"topic": "spot_price", "symbol": "X/USDT-P", "data": {"markPrice": "1.5"}}, "spot_price", "payload_contract"),
        ({"topic": "funding_rate_estimation", "symbol": "X/USDT-P", "data": {"fundingRateEstimation": {"estimatedFundingRate": "-0.01", "nextFundingTimestamp": 1785326400}}}, "funding_rate_estimation", None),
        ({"topic": "funding_rate_estimation", "symbol": "X/USDT-P", "data": {"fundingRateEstimation": {"estimatedFundingRate": "0", "nextFundingTimestamp": True}}}, "funding_rate_estimation", "invalid_timestamp"),
        (book(), "orderbook", None),
        (book("Update", (), ()), "orderbook", None),
        (book("Delta"), "orderbook", "unknown_message_type"),
        (book(messageType=1), "orderbook", "unknown_message_type"),
        (book(depth="20"), "orderbook", "payload_contract"),
        (book(depth=101), "orderbook", "impossible_value"),
        (book(timestamp_ms="x"), "orderbook", "invalid_timestamp"),
        (book(granularity="0"), "orderbook", "impossible_value"),
        (book(bids=(("9", "1"), ("9.0", "2"))), "orderbook", "duplicate_level"),
        (book(bids=()), "orderbook", "invalid_snapshot"),
        (book(bids=(("11", "1"),)), "orderbook", "crossed_book"),
        (book("Update", bids=(("9", "-1"),)), "orderbook", "impossible_value"),
        (book("Update", bids=(("9", "0"),)), "orderbook", None),
    ],
)
def test_error_codes(spark, payload, kind, code):
    assert normalize.checked(events(spark, [event(1, kind, payload)])).first().error_code == code


def test_normalize_routes_each_event_once(spark):
    rows = events(spark, [event(1, "ask_bid_price", quote()), event(2, "orderbook", book()), event(3, "trades", {}), event(4, "orderbook", book(), version=1)])
    got = normalize.normalize(rows)
    assert got.best_quotes.first().bid_price == Decimal(1)
    assert [(r.data_quality, r.changed_level_count) for r in got.orderbook_events.orderBy("raw_event_id").collect()] == [("sequence_unverified", 2), ("best_effort_legacy", 2)]
    assert [r.error_code for r in got.errors.collect()] == ["unsupported_event_type"]
    assert normalize.normalize(rows, skip_unsupported=True).errors.count() == 0
    for df, ddl in ((got.best_quotes, schemas.BEST_QUOTES), (got.orderbook_events, schemas.ORDERBOOK_EVENTS), (got.errors, schemas.NORMALIZATION_ERRORS)):
        schemas.require(df, ddl)


def states(spark, payloads, exchange=None, **how):
    seq = exchange or [None] * len(payloads)
    rows = normalize.normalize(events(spark, [event(i + 1, "orderbook", p, at=i, exchange=s) for i, (p, s) in enumerate(zip(payloads, seq, strict=True))])).orderbook_events
    return [(r.state, r.best_bid and float(r.best_bid), r.best_ask and float(r.best_ask), r.level_count) for r in orderbook.reconstruct(rows, ["received_at", "raw_event_id"], **how).orderBy("raw_event_id").collect()]


def test_book_chain(spark):
    ok = "valid_sequence_unverified"
    start = book(bids=(("9", "1"), ("8", "1")), asks=(("11", "1"), ("12", "1")))
    steps = [start, book("Update", (), (("11", "0"),)), book("Update", (), ()), book("Update", (("12", "1"),), ()), book("Update", (), ())]
    want = [(ok, 9, 11, 4), (ok, 9, 12, 3), (ok, 9, 12, 3), ("invalid_crossed", None, None, 0), ("invalid_crossed", None, None, 0)]
    assert states(spark, steps) == want == states(spark, steps, by_segment=False)
    assert states(spark, [book("Update", (), ())])[0][0] == "invalid_waiting_snapshot"
    assert [s[0] for s in states(spark, [start, book("Update", (), ()), start], [10, 12, 13])] == ["valid_sequence_verified", "invalid_sequence", "valid_sequence_verified"]


def test_lookup_rules_differ(spark):
    row = spark.createDataFrame([('{"price": null, "data": {"price": 5, "seq": "7", "timestamp": 1785326400000}, "sequence": 3.9}',), ('{"price": true, "data": {"bid": 2, "ask": 4}}',)], "p string").withColumn("v", F.try_parse_json("p"))
    v = F.col("v")
    there, value = extract.price_for_quality(v)
    got = row.select(extract.payload_number(v, ("price",)).alias("a"), extract.valid_number(v, ("price",)).alias("b"), extract.sequence(v).alias("c"), there.alias("d"), value.alias("e"), extract.mid_price(v).alias("m"), extract.exchange_time(v).alias("t")).collect()
    assert (got[0].a, got[0].b, got[0].c, got[0].d, got[0].e, got[0].t) == (None, 5.0, 3, True, None, T0)
    assert (got[1].a, got[1].d, got[1].e, got[1].m) == (None, True, 1.0, 3.0)


def test_momentum_and_evaluation(spark):
    prices = [100, 100, 100, 103, 104, 104, 100, 97, 96]
    df = spark.createDataFrame([("s", i, T0 + timedelta(seconds=i), float(p)) for i, p in enumerate(prices)], "s string, i int, at timestamp, price double")
    found = signals.edges(signals.momentum(df, ["s"], ["i"], "price", 3, 20), ["s"], ["i"])
    assert [(r.i, r.state, round(r.momentum_bps, 2)) for r in found.orderBy("i").collect()] == [(3, 1, 198.02), (6, -1, -259.74)]
    last = spark.createDataFrame([("s", T0 + timedelta(seconds=8), 96.0)], "s string, last_at timestamp, last_price double")
    got = signals.statistics(signals.paired(found, last, ["s"], ["i"], "at", "price"), ["s"]).first()
    assert (got.trades, round(got.pnl, 7), got.win_rate, round(got.sharpe, 7)) == (2, 10.8737864, 0.5, 0.2224606)


def test_drawdown_and_costs(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([10, -4, -9, 2])], "g int, i int, v double")
    assert signals.drawdown(df, ["g"], ["i"], "v").first().maximum_drawdown == 13
    costs = signals.trade_costs(F.lit(1), F.lit(100.0), F.lit(110.0), F.lit(28800.0), 1000.0, 0.001, 0.001, 1.0, 1.0)
    got = spark.range(1).select(*[F.round(c, 6).alias(n) for n, c in costs.items()]).first()
    assert tuple(got) == (100.0, 2.1, 1.0, 0.42, 96.48)


def test_backtest_walk(spark):
    closes = [100, 100, 102, 103, 103, 101, 99, 98]
    df = spark.createDataFrame([("s", T0 + timedelta(seconds=60 * i), float(c)) for i, c in enumerate(closes)], "series string, at timestamp, close double")
    how = backtest.Baseline(lookback=1, delay=1, threshold_bps=100, holding_s=60, cooldown_s=0)
    found = backtest.outcomes(df, "series", "at", "close", how).orderBy("place", F.desc("outcome")).collect()
    assert [(r.place, r.outcome) for r in found] == [(1, "insufficient_history"), (2, "below_threshold"), (3, "signal"), (4, "position_open"), (5, "trade"), (5, "below_threshold"), (6, "signal"), (7, "position_open"), (8, "trade"), (8, "execution_delay_out_of_range")]
    assert backtest.report(backtest.outcomes(df, "series", "at", "close", how), how).first().exits == 2


def test_paper_keeps_books_and_closes(spark):
    rows = []
    for i in range(40):
        rows.append(event(2 * i, "q", {"topic": "ask_bid_price", "bid": 100 + i, "ask": 100.1 + i}, at=2 * i))
        rows.append(event(2 * i + 1, "m", {"topic": "mark_price", "price": 100 + i}, at=2 * i + 1))
    got = paper.simulate(paper.inputs(events(spark, rows)), paper.Paper(fast=2, slow=5)).first()
    assert got.net_pnl > 0 and got.open_position == 0 and got.fills == 2 and not got.halted
    assert abs(got.net_pnl - (got.realized_pnl - got.fees_paid - got.funding_paid)) < 1e-9


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "id int, k string, t int")
    right = spark.createDataFrame([(1, "a", 2, 7), (2, "a", 5, None), (3, "a", 6, 9)], "id int, k string, t int, v int")
    assert [(r.id, r.matched_at, r.v) for r in joins.asof(left, right, "k", "t", ["v"]).orderBy("id").collect()] == [(1, 5, None), (2, None, None), (3, None, None)]


def test_rate_gap_and_gates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    n = F.lit
    assert [one(classify.rate_state(n(a), n(b))) for a, b in ((30, 60), (29, 60), (30, 61), (61, 30))] == ["normal", "unknown", "low", "high"]
    assert [one(classify.gap_state(n(g))) for g in (60, 61)] == ["ok", "warning"]
    assert one(classify.days_to_threshold(n(10), n(86_399), n(1))) is None
    gib, mib = classify.GIB, classify.MIB
    assert [one(classify.resource_gate(n(f), n(r * mib), n(0))) for f, r in ((5 * gib, 100), (4 * gib - 1, 100), (3 * gib - 1, 100), (5 * gib, 128), (5 * gib, 160))] == ["run", "pause", "stop", "pause", "stop"]
    plan = lambda free, days, low: one(classify.capacity_plan(n(free), n(400.0), n(0.0), n(100.0), n(days), n(0), n(low)))
    assert (plan(8 * gib, 3, False), plan(3 * gib, 3, False), plan(8 * gib, 2, True)) == ("safe", "blocked", "warning")


def test_restart_states(spark):
    s = "struct<id:string,restarts:int,running:boolean,health:string,started_at:timestamp>"
    def state(restarts, age, healthy="healthy"):
        row = spark.createDataFrame([((("i", restarts, True, healthy, T0)), ("i", restarts, True, "healthy", T0), age)], f"a {s}, b {s}, age double")
        return row.select(classify.restart_state("a", "b", F.col("age")).alias("x")).first().x
    assert [state(*x) for x in ((1, 300.0), (1, 301.0), (3, 1800.0), (3, 1801.0), (0, 9.0), (0, -1.0))] == ["recent_restart", "historical_restart", "restart_loop", "historical_restart", "healthy_stable", "unknown"]
    assert state(0, 1.0, "starting") == "unhealthy"


def test_digest_and_verify(spark):
    df = spark.createDataFrame([("a", i) for i in (3, 1, 2)], "c string, id long")
    got = archive.chunk_digests(df, ["c"])
    assert got.first().id_sha256 == "ca73761ddabfffcbe51170be0b07f67bafcdbed202545c60707573d36dc935b4"
    assert spark.range(1).select(archive.id_digest(F.array(F.lit(3), F.lit(2), F.lit(1))).alias("x")).first().x != got.first().id_sha256
    assert [r.problem for r in archive.verify(got, archive.chunk_digests(df.where("id < 3"), ["c"]), ["c"]).collect()] == ["row_count_differs"]
    assert archive.verify(got, got, ["c"]).count() == 0


def test_ids_and_redaction(spark):
    at = F.lit("2026-07-18 00:00:00").cast("timestamp")
    got = spark.range(1).select(
        text.dataset_id(F.lit("ETH/USDT-P"), at, at + F.expr("INTERVAL 1 HOUR")).alias("i"), text.sanitize_line(F.lit("token=abc at https://h/x from 10.1.2.3")).alias("l"),
        text.sanitize_line(F.lit("  File x")).alias("n"), text.failure_stage(F.lit("Database gone")).alias("s"), text.error_class(F.lit("x ValueError: y")).alias("e"), text.sanitize_message(F.lit("see https://u:p@h.io:1/a?b\npassword: x")).alias("m"),
    ).first()
    assert got.i == "eth-usdt-p_20260718T000000000000Z_20260718T010000000000Z_v2"
    assert got.l == "token=[REDACTED] at [REDACTED] from [REDACTED]" and got.n is None and (got.s, got.e) == ("database", "ValueError")
    assert got.m == "see https://h.io:1/[PATH] password[REDACTED]"


def test_reconcile_and_retention(spark):
    w = [(i, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1), n) for i, n in enumerate((60000, 59669, 59865))]
    plan = spark.createDataFrame(w, "index int, window_start timestamp, window_end timestamp, expected_event_count long")
    progress = spark.createDataFrame([(0, "completed_admissible", 60000, True), (1, "skipped_verified", 59669, True), (2, "completed_quarantined", 59865, True)], "index int, status string, event_count long, checksums_ok boolean")
    got = planning.reconcile(plan, progress).first()
    assert (got.admissible_event_total, got.quarantined_event_total, got.storage_coverage_continuous, got.admissible_coverage_continuous, got.status) == (119669, 59865, True, False, "pass")
    late = plan.withColumn("window_start", F.when(F.col("index") == 1, F.col("window_start") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("window_start")))
    assert planning.reconcile(late, progress).first().status == "failed"
    day = [(T0 + timedelta(days=i), T0 + timedelta(days=i + 1), "verified", "s3", "raw_and_normalized", 2) for i in range(2)]
    days = spark.createDataFrame(day, "start timestamp, end timestamp, status string, destination string, dataset_group string, row_count long")
    assert tuple(planning.retention_summary(planning.retention(days, F.lit(T0 + timedelta(days=9)))).select("state", "eligible_rows").first()) == ("eligible", 4)
    assert planning.retention_summary(planning.retention(days.withColumn("destination", F.lit("filesystem")), F.lit(T0 + timedelta(days=9)))).first().state == "nothing_eligible"


def test_admission(spark):
    sets = spark.createDataFrame([(f"d{i}", T0 + timedelta(days=i)) for i in range(4)], "dataset_id string, start timestamp")
    assert [r.split for r in admission.split(sets).orderBy("start").collect()] == ["training", "validation", "out_of_sample", "out_of_sample"]
    trades = spark.createDataFrame([(1, T0, 20.0), (2, T0 + timedelta(days=1), -10.0)], "trade_id int, exit_at timestamp, net_pnl double").selectExpr("*", "net_pnl gross_pnl", "0D fees", "0D funding", "0D slippage_and_latency")
    row = admission.totals(trades).withColumns({"artifacts_valid": F.lit(True), "compatible": F.lit(True), "quality_passing": F.lit(4), "dataset_count": F.lit(2), "utc_day_count": F.lit(2)})
    got = admission.decide(row, admission.Thresholds(oos_trades=3, oos_drawdown=5)).first()
    assert got.maximum_drawdown == 10 and got.failed == ["minimum_oos_trade_count", "maximum_oos_drawdown"] and not got.admitted


def test_sequences_and_orders(spark):
    df = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate([(100, True), (101, False), (50, True), (51, False), (53, False)])], "i int, k long, snap boolean").withColumn("g", F.lit(1))
    assert ordering.sequence_anomalies(df, ["g"], ["i"], "k", F.col("snap")).agg(F.sum("anomaly")).first()[0] == 1
    mixed = spark.createDataFrame([(1, T0, 1, None), (2, T0, None, None)], "id long, received_at timestamp, exchange_sequence long, sequence long")
    with pytest.raises(ValueError):
        ordering.book_order(mixed)
    assert quality.exact_duplicates(spark.createDataFrame([(1,), (1,), (2,)], "a int")).first().duplicate_rows == 1


def test_sources_and_sinks(spark, tmp_path):
    rows = events(spark, [event(i, "trades", {"price": i + 1}, at=i) for i in range(20)])
    out = f"file://{tmp_path}/t"
    sinks.insert_new(rows, out, ["id"])
    sinks.insert_new(rows, out, ["id"])
    again = tape.tape(spark, out)
    assert again.count() == 20 and tape.page(again, 3, 9, 2).count() == 2
    assert [r.id for r in tape.latest(again, 3).collect()] == [17, 18, 19]
    with pytest.raises(ValueError):
        tape.guarded(again, 5)
    with pytest.raises(ValueError):
        tape.replay(again, 0)
    sinks.archive(rows.select("id", "received_at", "symbol"), f"file://{tmp_path}/a")
    assert spark.read.parquet(f"file://{tmp_path}/a").where("date = '2026-07-29' AND symbol = 'X-USDT-P'").count() == 20


def test_streams(spark, tmp_path):
    raw = events(spark, [event(1, "orderbook", book()), event(2, "orderbook", book("Update", (), (("11", "0"), ("12", "1"))), at=1), event(3, "nope", {}, at=2), event(4, "trades", {"price": 5, "quantity": 1}, at=3)])
    path, out = f"{tmp_path}/raw", f"file://{tmp_path}/out"
    raw.write.parquet(path)
    for n in range(2):  # a new checkpoint reads all again: nothing is added
        pipelines.normalize_stream(pipelines.raw_stream(spark, path), out, f"{tmp_path}/c{n}").awaitTermination()
    assert spark.read.parquet(f"{out}/orderbook_events").count() == 2 and spark.read.parquet(f"{out}/errors").count() == 2
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/orderbook_events").schema).parquet(f"{out}/orderbook_events")
    q = pipelines.book_stream(stream).writeStream.format("memory").queryName("books").option("checkpointLocation", f"{tmp_path}/cb").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.state, float(r.best_ask)) for r in spark.table("books").orderBy("raw_event_id").collect()] == [("valid_sequence_unverified", 11.0), ("valid_sequence_unverified", 12.0)]
    q = pipelines.candle_stream(pipelines.raw_stream(spark, path)).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cc").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.open, r.volume) for r in spark.table("bars").collect()] == [(5.0, 1.0)]


def test_operations(spark):
    from tapelake.operators import operations

    rows = spark.createDataFrame([("a", 1, 5, False), ("a", 2, 6, True), ("b", 1, 5, True), ("b", 2, None, False), ("b", 3, 6, False), ("b", 4, 6, False), ("c", 1, 1, True), ("c", 2, 3, False)], "c string, i int, k long, snap boolean")
    got = {r.c: (r.i, r.reason) for r in operations.desyncs(rows, "c", ["i"], "k", F.col("snap")).collect()}
    assert got == {"a": (1, "missing_snapshot"), "b": (4, "sequence_regression"), "c": (2, "sequence_gap")}
    details = spark.createDataFrame([('{"a": [{"api_key": 1, "b": 2}], "Password": {"x": 1}}',), ("no json",), (None,)], "d string")
    assert [r[0] for r in details.select(operations.redact_details(F.col("d"))).collect()] == ['{"Password": "[REDACTED]", "a": [{"api_key": "[REDACTED]", "b": 2}]}', None, None]
    plan = spark.createDataFrame([("x", T0, T0, 2, 1), ("y", T0, T0, 2, 1), ("z", T0, T0, 2, 1)], "dataset_id string, window_start timestamp, window_end timestamp, expected_event_count long, expected_trade_count long")
    remote = spark.createDataFrame([("x", T0, T0, True, False, 2, 1), ("y", T0, T0, True, False, 3, 1)], "dataset_id string, window_start timestamp, window_end timestamp, quarantined boolean, admission_eligible boolean, event_count long, trade_count long")
    assert [r.verdict for r in operations.adoption(plan, remote).orderBy("dataset_id").collect()] == ["adopted", "event_count_differs", "absent"]
