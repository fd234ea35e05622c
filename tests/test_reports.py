"""Quality reports, neighbours over chunks, redaction, datasets on disk, plans and records."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tapelake.functions import classify, text
from tapelake.operators import archive, bundles, operations, orderbook, ordering, planning, quality

T0 = datetime(2026, 7, 18, tzinfo=timezone.utc)
TAPE = "source string, topic string, raw_event_id long, received_at timestamp, exchange_at timestamp, sequence long, payload_json string"


def rows_of(prices=(100, 101, 102), **change):
    out = [{"source": "f", "topic": "trades", "raw_event_id": k + 1, "received_at": T0 + timedelta(seconds=k), "exchange_at": T0 + timedelta(seconds=k), "sequence": k + 1, "payload_json": json.dumps({"topic": "trades", "price": p})} for k, p in enumerate(prices)]
    for k, cells in change.items():
        out[int(k[1:])] |= cells
    return out


def report(spark, rows, chunk=None, **how):
    df = spark.createDataFrame([(n, *(r[c.split()[0]] for c in TAPE.split(", "))) for n, r in enumerate(rows)], f"n int, {TAPE}")
    same = [c.split()[0] for c in TAPE.split(", ")]
    got = quality.payload_report(df, ["n"], F.lit(T0), F.lit(T0 + timedelta(minutes=1)), same=same, chunk=chunk, **how).collect()
    assert len(got) == 1
    return got[0]


@pytest.mark.parametrize("size", [None, 1, 2])
def test_stated_reports(spark, size):
    chunk = None if size is None else F.floor(F.col("n") / size)
    look = lambda rows, **how: report(spark, rows, chunk, **how)
    clean = look(rows_of())
    assert (clean.status, clean.row_count, clean.sequence_anomalies, clean.sequence_availability, clean.findings) == ("pass", 3, 0, {"f:trades": "present"}, ["No configured data-quality anomalies found."])
    twice = rows_of((100, 101))
    twice = look([*twice, twice[-1]])
    assert (twice.status, twice.duplicates) == ("warning", 1)
    one, two, three = rows_of()
    swapped = look([two, one, three])
    assert (swapped.status, swapped.receipt_order, swapped.exchange_order) == ("rejected", 1, 1)
    early = rows_of(_0={"exchange_at": T0 - timedelta(seconds=10)})
    assert (look(early).status, look(early).exchange_range) == ("rejected", 1)
    edge = rows_of(_0={"exchange_at": T0 - timedelta(seconds=1)})
    assert (look(edge).status, look(edge).excursions, look(edge).exchange_range) == ("pass", 1, 0)
    assert (look(edge, tolerance_s=0).status, look(edge, tolerance_s=0).excursions, look(edge, tolerance_s=0).exchange_range) == ("rejected", 0, 1)
    partial = look(rows_of(_1={"sequence": None}))
    assert (partial.status, partial.sequence_availability, partial.sequence_anomalies, partial.partial_streams) == ("warning", {"f:trades": "partial"}, 1, ["f:trades"])
    none = look(rows_of(**{f"_{k}": {"sequence": None} for k in range(3)}))
    assert (none.status, none.sequence_anomalies, none.sequence_availability) == ("pass", None, {"f:trades": "absent"})
    books = rows_of((100, 101, 102, 103), **{f"_{k}": {"topic": "orderbook", "sequence": s, "payload_json": json.dumps({"topic": "orderbook", "messageType": "snapshot" if k in (0, 2) else "update"})} for k, s in enumerate((100, 101, 50, 51))})
    assert (look(books).status, look(books).sequence_anomalies) == ("pass", 0)
    late = rows_of(_1={"exchange_at": None}, _2={"exchange_at": T0 - timedelta(seconds=2)})
    assert (look(late).exchange_order, look(late).status) == (1, "rejected")
    gap = look(rows_of((100, None, 150)))
    assert (gap.invalid_prices, gap.jumps, gap.status) == (1, 1, "warning")
    empty = look([])
    assert (empty.status, empty.row_count, empty.sequence_anomalies, empty.duplicates, empty.largest_gap_s) == ("rejected", 0, None, 0, 0.0)
    assert empty.findings == ["Dataset contains no market events."]
    mixed = rows_of((100, 101, 102, 103), **{f"_{k}": {"topic": "orderbook", "exchange_at": T0 + timedelta(seconds=k - (1.5 if k else 0)), "payload_json": "{}"} for k in (0, 2)}, **{f"_{k}": {"topic": "mark_price", "exchange_at": None, "sequence": None} for k in (1, 3)})
    assert (look(mixed).receipt_order, look(mixed).exchange_order) == (0, 0)


def test_neighbours_do_not_depend_on_chunks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.randint(0, 50)]), rng.choice([None, "x", "y"])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, v int, s string").repartition(4)
    values = {"pv": F.col("v"), "ps": F.struct("s")}
    look = lambda chunk: sorted(map(str, ordering.running(ordering.previous(df, ["g"], ["i"], values, chunk), ["g"], ["i"], "t", F.coalesce("v", F.lit(0)), chunk).collect()))
    whole = look(None)
    assert len(whole) == 300 and all(look(F.floor(F.col("i") / n)) == whole for n in (1, 7, 1000))


def events_of(spark, steps):
    level = "array<struct<price:decimal(38,18),quantity:decimal(38,18)>>"
    kinds = f"symbol string, raw_event_id long, connection_id string, exchange_sequence long, local_sequence long, raw_schema_version short, data_quality string, message_type string, bids {level}, asks {level}"
    from decimal import Decimal as D

    side = lambda ls: [(D(p), D(q)) for p, q in ls]
    return spark.createDataFrame([("s", k, c, x, n, 2, q, kind, side(b), side(a)) for k, (kind, c, x, n, q, b, a) in enumerate(steps)], kinds)


def test_book_grades_and_resets(spark):
    snap = lambda c="c", x=None, n=None, q="sequence_unverified": ("Snapshot", c, x, n, q, [(9, 1)], [(11, 1)])
    move = lambda c="c", x=None, n=None, b=(), a=(): ("Update", c, x, n, "sequence_unverified", b, a)
    steps = [snap(n=1), move(x=5, n=2), snap(q="best_effort_legacy"), move(), ("Disconnect", "c", None, None, None, (), ()), move(), snap("d", x=10), move("d", x=11), move("d", x=13), snap("d", x=20), move("d", b=[(12, 1)]), snap("d", n=7), move("d", n=7), move("e", n=9)]
    want = ["valid_sequence_unverified", "valid_sequence_unverified", "valid_best_effort_legacy", "valid_best_effort_legacy", "invalid_waiting_snapshot", "invalid_waiting_snapshot", "valid_sequence_verified", "valid_sequence_verified", "invalid_sequence"]
    want += ["valid_sequence_verified", "invalid_crossed", "valid_sequence_unverified", "invalid_sequence", "invalid_waiting_snapshot"]
    for chunk in (None, F.floor(F.col("raw_event_id") / 3)):
        got = orderbook.reconstruct(events_of(spark, steps), ["raw_event_id"], chunk=chunk).orderBy("raw_event_id").collect()
        assert [r.state for r in got] == want
    loose = orderbook.reconstruct(events_of(spark, steps), ["raw_event_id"], use_local_sequence=False, by_segment=False).orderBy("raw_event_id").collect()
    assert loose[12].state == "valid_sequence_unverified" and loose[12].level_count == 2
    level = spark.range(1).select(F.expr("map(1.5, 2, 3.0, 1)").alias("m"))
    assert tuple(map(float, level.select(orderbook.best(F.col("m"), True), orderbook.best(F.col("m"), False)).first())) == (3.0, 1.5)


MESSAGES = {
    "see https://u:p@h.io:1/a?b\npassword: x": "see https://h.io:1/[PATH] password[REDACTED]", "postgres://user:pw@db_host/x": "[REDACTED_URI]", "https://u:p@[::1]:5432/db": "https://[::1]:5432/[PATH]", "https://h.io:1": "https://h.io:1",
    "HTTPS://Example.COM/?q=1 and ftp://a.b/c d": "https://example.com/ and ftp://a.b/[PATH] d", "x https://h:99999/ y": "x [REDACTED_URI] y", "https://h:ab/": "[REDACTED_URI]", "Bearer abc.def then": "[REDACTED] then", "\r\n": "Error", "https:///nohost": "[REDACTED_URI]",
    "ordinary connection failure\nretry": "ordinary connection failure retry", "a://b@c@d.e/f": "a://d.e/[PATH]",
}


def test_addresses_and_secrets_go(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "m string")
    assert [r[0] for r in df.select(text.sanitize_message(F.col("m"))).collect()] == list(MESSAGES.values())
    assert [operations.safe_text(m) for m in MESSAGES] == list(MESSAGES.values())
    details = spark.createDataFrame([('{"access_token": "s", "token_count": 3, "nested": ["https://u:p@h.io/x", {"API-KEY": [1]}], "n": null}',), ("7",), ("{",)], "d string")
    assert [r[0] for r in details.select(operations.redact_details(F.col("d"))).collect()] == ['{"access_token": "[REDACTED]", "n": null, "nested": ["https://h.io/[PATH]", {"API-KEY": "[REDACTED]"}], "token_count": 3}', "7", None]


def test_datasets_are_exported_validated_and_refused(spark, tmp_path):
    kinds = "id long, received_at timestamp, exchange_at timestamp, source string, event_type string, symbol string, sequence long, connection_id string, local_sequence long, exchange_sequence long, schema_version short, latency_ms double, payload string"
    tape = spark.createDataFrame([(k, T0 + timedelta(seconds=k), None, "f", "trades", "ETH/USDT-P" if k < 9 else "X", k, None, None, None, None, 1.0, f'{{"quantity": 1, "price": {100 + k}}}') for k in range(1, 12)], kinds)
    root = f"file://{tmp_path}/data"
    path = bundles.export(tape, "ETH/USDT-P", T0, T0 + timedelta(minutes=1), root)
    assert path.endswith("/eth-usdt-p_20260718T000000000000Z_20260718T000100000000Z_v2") and bundles.manifest_problems(spark, path) == []
    rows = spark.read.parquet(f"{path}/events.parquet")
    assert rows.columns[1] == "topic" and rows.where("raw_schema_version = 1").count() == 8 and rows.orderBy("raw_event_id").first().payload_json == '{"price":101,"quantity":1}'
    with pytest.raises(FileExistsError):
        bundles.export(tape, "ETH/USDT-P", T0, T0 + timedelta(minutes=1), root)
    with pytest.raises(ValueError, match="missing_report"):
        bundles.require_quality(spark, path)
    found = bundles.validate(spark, path)
    assert (found["status"], found["row_count"], found["quality_report_version"]) == ("pass", 8, 5) and bundles.require_quality(spark, path)["status"] == "pass"
    assert [(r.name, r.quality_status) for r in bundles.datasets(spark, root).collect()] == [(path.rpartition("/")[2], "pass")]
    digest = __import__("tapelake.operators.manifests", fromlist=["x"]).logical_digest(bundles.get(spark, f"{path}/quality_report.json"))
    assert bundles.restore(spark, path, digest)["status"] == "verified" and bundles.restore(spark, path, "0")["status"] == "failed"
    got = bundles.replay(rows, lambda r: {"i": r["raw_event_id"], "p": float(r["payload"]["price"])} if r["raw_event_id"] % 2 else None, "i long, p double").collect()
    assert [(r.i, r.p) for r in got] == [(1, 101.0), (3, 103.0), (5, 105.0), (7, 107.0)]
    strange = tmp_path / "data" / path.rpartition("/")[2] / "events.parquet" / "part-9.parquet"
    strange.write_bytes(b"x")
    with pytest.raises(ValueError, match="inputs_changed"):
        bundles.require_quality(spark, path)
    assert bundles.manifest_problems(spark, path) == ["unexpected: events.parquet/part-9.parquet"] and bundles.restore(spark, path)["status"] == "failed"
    strange.unlink()
    jumpy = tape.withColumn("payload", F.when(F.col("id") > 4, F.lit('{"price": 500}')).otherwise(F.col("payload")))
    path = bundles.export(jumpy, "ETH/USDT-P", T0, T0 + timedelta(minutes=2), root)
    bundles.validate(spark, path)
    with pytest.raises(ValueError, match="warnings_not_allowed"):
        bundles.require_quality(spark, path)
    assert bundles.require_quality(spark, path, allow_warnings=True)["jumps"] == 1 and [r.quality_status for r in bundles.datasets(spark, root).collect()] == ["warning", "pass"]


def test_markers_plans_and_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    for _ in range(2):
        bundles.mark_incomplete(spark, root, "d", "a1", ["k"], "lost")
    bundles.mark_completed(spark, root, "d", "a2")
    with pytest.raises(Exception):  # noqa: B017
        bundles.mark_completed(spark, root, "d", "a3")
    bundles.write_plan(spark, f"{root}/plan", {"plan_id": "p"})
    assert bundles.read_plan(spark, f"{root}/plan") == {"plan_id": "p"}
    (tmp_path / "plan" / "plan.json").write_text("{}")
    (tmp_path / "plan" / ".plan.json.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        bundles.read_plan(spark, f"{root}/plan")
    bundles.quarantine(spark.createDataFrame([("d",)], "dataset_id string"), f"{root}/registry")
    bundles.quarantine(spark.createDataFrame([("e",)], "dataset_id string"), f"{root}/registry")
    assert spark.read.json(f"{root}/registry").where("NOT admission_eligible").count() == 2
    windows = [{"index": k, "status": s, "expected_event_count": 5} for k, s in enumerate(["completed_admissible", "running", "pending", "pending"])]
    done = lambda w: {"status": "completed_admissible", "event_count": 5, "bytes": 10}
    assert (bundles.run_windows(windows, done, 2, 100)["status"], bundles.run_windows(windows, done, 9, 10)["processed"], bundles.run_windows(windows, done, 9, 99)["status"]) == ("partial", 1, "completed")
    bad = bundles.run_windows(windows, lambda w: done(w) | {"event_count": 4}, 9, 99)
    assert (bad["status"], bad["processed"], bundles.run_windows(bad["windows"], done, 9, 99)["error"]) == ("failed", 1, "prior window failure")
    chunks = archive.chunk_digests(spark.range(1, 8).withColumn("p", archive.part("id", 3)), ["p"])
    head = bundles.day_manifest(chunks, T0, T0 + timedelta(days=1), "s", "s3")
    assert (head["raw_row_count"], head["min_raw_event_id"], head["max_raw_event_id"]) == (7, 1, 7) and bundles.checkpoint(chunks, T0, T0, "s")["last_raw_event_id"] == 7
    objects = chunks.withColumn("dataset", F.lit("raw"))
    assert archive.manifest_totals(objects, 7, head["raw_id_sha256"]).count() == 0 and [r.problem for r in archive.manifest_totals(objects, 8, "x").collect()] == ["row_count_mismatch", "identity_mismatch"]
    with pytest.raises(Exception, match="more than 3 rows"):
        archive.chunk_digests(spark.range(9), [], most=3).collect()
    spark.range(5).withColumnRenamed("id", "raw_event_id").write.parquet(f"{root}/files")
    assert archive.file_figures(spark.read.parquet(f"{root}/files")).agg(F.sum("row_count")).first()[0] == 5
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "h")], "path string, row_count long, sha256 string")
    assert [tuple(r) for r in archive.verify(a, a.withColumn("sha256", F.lit("h")), ["path"]).collect()] == [("x", "sha256_differs")] and archive.verify(a, a, ["path"]).count() == 0
    assert bundles.high_water(spark.range(0)).first()[0] == 0 and [tuple(r) for r in bundles.counts(a=spark.range(3), b=spark.range(0)).collect()] == [("a", 3), ("b", 0)]


def test_windows_are_held_to_their_plan(spark):
    plan = spark.createDataFrame([(k, f"d{k}", T0 + timedelta(hours=k), T0 + timedelta(hours=k + 1), 100, 10) for k in range(3)], "index int, dataset_id string, window_start timestamp, window_end timestamp, expected_event_count long, expected_trade_count long")
    kinds = "index int, status string, event_count long, checksums_ok boolean, trade_count long, quarantined boolean, admission_eligible boolean"
    good = [(k, "completed_admissible", 100, True, 10, False, True) for k in range(3)]
    look = lambda rows: spark.createDataFrame(rows, kinds)
    assert planning.reconcile(plan, look(good)).first().status == "pass"
    moved = [(0, "completed_admissible", 105, True, 10, None, None), (1, "completed_admissible", 95, True, None, None, None), good[2]]
    assert planning.reconcile(plan, look(moved)).first().status == "failed"
    trades = [(0, "completed_admissible", 100, True, 9, None, None), *good[1:]]
    assert [(r["index"], r.problem) for r in planning.checked_windows(plan, look(trades)).where("problem IS NOT NULL").collect()] == [(0, "trade_count_differs")]
    assert not planning.reconcile(plan.withColumn("dataset_id", F.lit("d")), look(good)).first().unique_dataset_ids
    for row in ((0, "completed_admissible", 100, True, 10, True, None), (0, "skipped_quarantined", 100, True, 10, None, True)):
        with pytest.raises(Exception, match="contradict"):
            planning.reconcile(plan, look([row])).collect()


def test_records_and_rows(spark):
    good = {"timestamp": "2026-07-18T00:00:00Z", "exit_code": 1, "restart_count": 0, "failure_stage": "stream", "error_class": "ValueError", "stderr_lines": ["x"], "oom_killed": 0, "revision": "unknown"}
    bad = [{"exit_code": 256}, {"exit_code": True}, {"extra": 1}, {"stderr_lines": ["x" * 161]}, {"stderr_lines": ["x"] * 13}, {"failure_stage": "other"}, {"error_class": "oops"}, {"revision": "abc"}, {"timestamp": "2026-07-18"}, {"oom_killed": 2}, {"stderr_lines": [1]}]
    df = spark.createDataFrame([(json.dumps(good | b),) for b in ({}, {"stderr_lines": []}, {"revision": "a" * 40}, *bad)] + [("no",)], "r string")
    assert [r[0] for r in df.select(operations.failure_record_ok(F.col("r"))).collect()] == [True] * 3 + [False] * (len(bad) + 1)
    row = dict.fromkeys(operations.METRICS, 1) | {"collector_health": 2, "collector_restart_loop": 0, "failure_oom_killed": 0, "collector_restart_count": 0, "failure_exit_code": 0, "failure_summary_age_seconds": 5, "collector_restart_state": "healthy_stable", "storage_state": "ready"}
    cases = [({}, True), ({"readiness": 2}, False), ({"readiness": 2, "swap_safe": 0}, True), ({"readiness": -1}, False), ({"readiness": -1, "storage_state": "unknown"}, True), ({"runtime_safe": 0}, False), ({"ports_safe": 0}, False), ({"ports_safe": 0, "runtime_safe": 0, "readiness": 0}, True)]
    cases += [({"failure_summary_state": 0}, False), ({"failure_summary_state": 0, "failure_exit_code": -1, "failure_oom_killed": -1, "failure_summary_age_seconds": -1}, True), ({"disk_safe": 3}, False), ({"disk_safe": None}, False), ({"collector_restart_count": -2}, False)]
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in row.items())
    df = spark.createDataFrame([tuple((row | c).values()) for c, _ in cases], kinds)
    assert [r[0] for r in df.select(operations.metric_row_ok()).collect()] == [ok for _, ok in cases]
    candles = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, t int")
    assert ordering.require_strict(candles, ["s"], "t").count() == 3
    with pytest.raises(ValueError):
        ordering.require_strict(candles.union(candles.limit(1)), ["s"], "t")
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    at = F.lit("2026-07-18 00:00:00").cast("timestamp")
    assert one(text.plan_id(F.lit("ETH/USDT-P"), at, at + F.expr("INTERVAL 1 DAY"), 3600)) == "batch_eth-usdt-p_20260718T000000000000Z_20260719T000000000000Z_w3600"
    daily = classify.daily_bytes(F.lit(1_000_000), F.lit(10_000), F.lit(1_000))
    assert (one(daily), one(daily * 7), one(classify.headroom_days(F.lit(10_000_000_000), daily, 3_000_000_000)), one(classify.daily_bytes(F.lit(1), F.lit(999), F.lit(1_000)))) == (86_400_000, 604_800_000, 81.02, None)
