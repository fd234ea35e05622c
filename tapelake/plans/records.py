"""Registered queries over states, texts, records, admission and archives, each against SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapelake.functions import classify, text
from tapelake.operators import admission, archive, manifests, operations, orderbook, planning, quality
from tapelake.plans.catalog import K, events, query, table

c = F.col


def choose(key, *options):
    """The option that the remainder of a key names."""
    return F.element_at(F.array(*options), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


@query(f"""SELECT event_id, CASE WHEN k * 2 <= 60 THEN 'ok' ELSE 'warning' END AS gap, CASE WHEN free <= 3221225472 THEN 'critical' WHEN k < 10 THEN 'unknown' WHEN days <= 7 THEN 'warning' ELSE 'ok' END AS forecast, CASE WHEN age > 30 OR age < 0 THEN 'stale' ELSE 'fresh' END AS fresh,
        CASE WHEN greatest(age, 0) <= 30 THEN 'healthy' ELSE 'stale' END AS collector, CASE WHEN free < 3221225472 OR k >= 80 THEN 'stop' WHEN free - 1073741824 < 4294967296 OR k >= 64 THEN 'pause' ELSE 'run' END AS gate
    FROM (SELECT event_id, k, k * 107374182 AS free, (k - 5)::DOUBLE AS age, greatest(k * 107374182 - 3221225472, 0) / (500000000000 / 10.0) AS days FROM (SELECT event_id, {K} AS k FROM events))""")
def q_stream_states(spark, sf_dir):
    k = c("k")
    free, age = k * 107_374_182, (k - 5).cast("double")
    days = classify.days_to_threshold(F.lit(500_000_000_000), F.when(k < 10, F.lit(1)).otherwise(F.lit(864_000)), free)
    return events(spark, sf_dir).select(
        "event_id", classify.gap_state(k * 2).alias("gap"), classify.forecast_state(days, free).alias("forecast"), classify.freshness(age).alias("fresh"), classify.collector_health(age).alias("collector"),
        classify.resource_gate(free, k * 2 * classify.MIB, F.lit(classify.GIB)).alias("gate"),
    )


@query(f"""SELECT event_id, CASE WHEN k = 0 THEN 'unknown' WHEN k % 11 = 0 OR k > 90 OR k % 13 = 0 THEN 'critical' WHEN k % 7 = 0 OR k > 60 OR k % 5 = 1 THEN 'warning' ELSE 'pass' END AS stream, CASE WHEN k % 3 = 0 THEN 'unsupported_version' WHEN k % 4 = 0 THEN 'rejected' WHEN k % 4 = 1 THEN 'warning_not_allowed' ELSE 'allowed' END AS upload,
    k % 5 IN (0, 2) AS active, CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'inconsistent' WHEN 2 THEN 'not_applicable' WHEN 3 THEN 'required_path_missing' ELSE 'ready' END AS storage FROM (SELECT event_id, {K} AS k FROM events)""")
def q_operational_states(spark, sf_dir):
    k = c("k")
    none = F.lit(None).cast("array<string>")
    pair, other, empty = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a")), F.array().cast("array<string>")
    stream = classify.stream_status(k != 0, F.when(k % 11 == 0, 0).otherwise(5), F.when(k > 90, "stale").otherwise("fresh"), F.lit(0), F.when(k % 13 == 0, 2), F.when(k % 7 == 0, 1), F.when(k > 60, "warning").otherwise("ok"), F.when(k % 5 == 1, "high").otherwise("normal"), F.lit("ok"))
    return events(spark, sf_dir).select(
        "event_id", stream.alias("stream"), classify.upload_gate(F.when(k % 3 == 0, 4).otherwise(5), choose(k, F.lit("rejected"), F.lit("warning"), F.lit("pass"), F.lit("pass"))).alias("upload"),
        classify.contract_active(choose(k, F.lit("live"), F.lit("halted"), F.lit("OPEN"), F.lit("closed"), F.lit(None))).alias("active"),
        classify.storage_state(choose(k, none, pair, empty, pair, pair), choose(k, pair, F.array(F.lit("a")), empty, other, other), k % 5 != 3, F.lit(True)).alias("storage"),
    ).withColumn("active", F.coalesce("active", F.lit(False)))


@query(f"""SELECT event_id, CASE WHEN k % 9 = 0 THEN 'unhealthy' WHEN k % 5 = 4 THEN 'unknown' WHEN k % 7 = 0 THEN 'restart_loop' WHEN n >= 3 AND k * 40 <= 1800 THEN 'restart_loop' WHEN n > 0 AND k * 40 <= 300 THEN 'recent_restart' WHEN n > 0 THEN 'historical_restart' ELSE 'healthy_stable' END AS restart,
    CASE WHEN k % 8 = 0 THEN 'unknown' WHEN k < 20 OR k * 1000 > 90000 THEN 'sustained' ELSE 'inactive' END AS memory, CASE WHEN k % 6 = 0 THEN -1 WHEN k % 4 = 0 OR k < 10 THEN 0 WHEN k % 2 = 1 THEN 1 ELSE 2 END AS ready FROM (SELECT event_id, k, k % 5 AS n FROM (SELECT event_id, {K} AS k FROM events))""")
def q_host_states(spark, sf_dir):
    k = c("k")
    state = "struct<id:string,restarts:bigint,running:boolean,health:string,started_at:timestamp>"
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    sample = lambda restarts, name, health: F.struct(name.alias("id"), restarts.cast("bigint").alias("restarts"), F.lit(True).alias("running"), health.alias("health"), at.alias("started_at")).cast(state)
    memory = lambda available, pages: F.struct(available.alias("available"), F.lit(0).alias("swap"), F.lit(0.0).alias("pressure"), F.lit(0).alias("pages_in"), pages.alias("pages_out"))
    rows = events(spark, sf_dir).withColumns({
        "a": sample(F.when(k % 5 == 4, 9).otherwise(k % 5), F.when(k % 7 == 0, "x").otherwise("y"), F.lit("healthy")), "b": sample(k % 5, F.lit("y"), F.when(k % 9 == 0, "starting").otherwise("healthy")),
        "m": memory(F.when(k % 8 == 0, -1).otherwise(100), F.lit(0)), "w": memory(F.when(k < 20, 1).otherwise(100), k),
    })
    gates = [F.when(k % 6 == 0, -1).otherwise(1), F.when(k % 4 == 0, 0).otherwise(1)]
    return rows.select(
        "event_id", classify.restart_state("a", "b", (k * 40).cast("double")).alias("restart"), classify.memory_pressure("m", "w", 50, 90_000, 1.0, 1000).alias("memory"),
        classify.readiness(gates, k % 2, F.when(k < 10, 1).otherwise(100), F.lit("inactive"), 50).alias("ready"),
    )


TEXTS = (
    "login failed: password=hunter2 at https://user:pw@host.io:8443/a/b?c=d", "RuntimeError: websocket closed", "  File \"x.py\", line 1", "Traceback (most recent call last):", "postgres://u:p@db_host/x is down",
    "see /var/log/app.log from 10.20.30.40", "disk full\tOSError: no space", "api-key: abc Authorization=zzz",
)
LINES = (
    "login failed: password=[REDACTED] at [REDACTED]", "RuntimeError: websocket closed", None, None, "[REDACTED] is down", "see [REDACTED] from [REDACTED]", "disk full OSError: no space", "api-key:[REDACTED] Authorization=[REDACTED]",
)
SAFE = (
    "login failed: password[REDACTED] at https://host.io:8443/[PATH]", "RuntimeError: websocket closed", "File \"x.py\", line 1", "Traceback (most recent call last):", "[REDACTED_URI] is down", "see /var/log/app.log from 10.20.30.40",
    "disk full\tOSError: no space", "api-key[REDACTED] Authorization[REDACTED]",
)
ERRORS = ("unknown", "RuntimeError", "unknown", "unknown", "unknown", "unknown", "OSError", "unknown")
STAGES = ("unknown", "stream", "unknown", "unknown", "database", "unknown", "storage", "unknown")


def listed(values) -> str:
    quoted = ["''" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"list_extract([{', '.join(quoted)}], (event_id % {len(values)} + 1)::INT)"


@query(f"SELECT event_id, {listed(LINES)} AS line, {listed(SAFE)} AS message, {listed(ERRORS)} AS error, {listed(STAGES)} AS stage FROM events")
def q_sanitized(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", choose(c("event_id"), *[F.lit(t) for t in TEXTS]).alias("t"))
    return rows.select("event_id", F.coalesce(text.sanitize_line(c("t")), F.lit("")).alias("line"), text.sanitize_message(c("t")).alias("message"), text.error_class(c("t")).alias("error"), text.failure_stage(c("t")).alias("stage"))


@query("""SELECT event_id, '{"access_token": "[REDACTED]", "id": ' || event_id || ', "nested": [{"Password": "[REDACTED]"}, "https://h.io/[PATH]"], "token_count": 2}' AS details FROM events""")
def q_redacted_details(spark, sf_dir):
    raw = F.concat(F.lit('{"nested":[{"Password":{"x":1}},"https://u:p@h.io/x"],"token_count":2,"access_token":"s","id":'), c("event_id"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", operations.redact_details(raw).alias("details"))


@query("""SELECT o_orderkey, 'ETH-USDT-' || o_custkey AS slug, 'batch_eth-usdt_' || strftime(o_orderdate, '%Y%m%dT%H%M%S%fZ') || '_' || strftime(o_orderdate + INTERVAL 1 DAY, '%Y%m%dT%H%M%S%fZ') || '_w3600' AS plan, o_orderkey % 3 > 0 AS version FROM orders""")
def q_identifiers(spark, sf_dir):
    start = c("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.slug(F.concat(F.lit("ETH/USDT:"), c("o_custkey"))).alias("slug"), text.plan_id(F.lit("ETH/USDT"), start, start + F.expr("INTERVAL 1 DAY"), 3600).alias("plan"), text.is_version(F.concat(F.lit("v"), c("o_orderkey") % 3)).alias("version"),
    )


@query("SELECT o_custkey, max(o_orderkey % 40) + 1 AS next FROM orders GROUP BY o_custkey")
def q_next_version(spark, sf_dir):
    names = F.concat(F.lit("v"), c("o_orderkey") % 40, F.lit("_20240101"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(text.next_version(names).cast("long").alias("next"))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS exit_at, l_quantity - 25 AS g, l_linenumber * 0.25::DOUBLE AS f FROM lineitem GROUP BY ALL), u AS (SELECT *, g - f AS n FROM t), e AS (SELECT *, sum(n) OVER (ORDER BY exit_at, id, n) AS q FROM u), d AS (SELECT greatest(0, max(q) OVER (ORDER BY exit_at, id, n)) - q AS fall FROM e)
    SELECT count(*) AS trade_count, round(sum(g), 2) AS gross_pnl, round(sum(f), 2) AS fees, round(sum(n), 2) AS net_pnl, round(avg((n > 0)::INT), 6) AS win_rate, (SELECT round(max(fall), 2) FROM d) AS maximum_drawdown FROM u""")
def q_oos_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_shipdate").alias("exit_at"), (c("l_quantity") - 25).alias("gross_pnl"), (c("l_linenumber") * 0.25).alias("fees")).distinct()
    rows = rows.withColumns({"net_pnl": c("gross_pnl") - c("fees"), "funding": F.lit(0.0), "slippage_and_latency": F.lit(0.0)}).withColumn("trade_id", F.struct("id", "net_pnl"))
    out = admission.totals(rows)
    return out.select("trade_count", *[F.round(n, 2).alias(n) for n in ("gross_pnl", "fees", "net_pnl")], F.round("win_rate", 6).alias("win_rate"), F.round("maximum_drawdown", 2).alias("maximum_drawdown"))


@query("""WITH r AS (SELECT s_suppkey, s_suppkey % 2 = 0 AS valid, s_suppkey % 3 <> 0 AS same, s_suppkey % 5 AS q, s_suppkey % 4 AS d, s_suppkey % 50 AS t, s_acctbal AS n, s_suppkey % 6 AS u, abs(s_acctbal) / 50 AS f FROM supplier)
    SELECT s_suppkey, array_to_string(list_filter([CASE WHEN NOT valid THEN 'all_required_artifacts_valid' END, CASE WHEN NOT same THEN 'compatible_replay_configuration' END, CASE WHEN q < 3 THEN 'minimum_quality_passing_datasets' END, CASE WHEN d < 2 THEN 'minimum_oos_dataset_count' END, CASE WHEN t < 30 THEN 'minimum_oos_trade_count' END,
        CASE WHEN f > 100 THEN 'maximum_oos_drawdown' END, CASE WHEN n <= 0 THEN 'positive_oos_net_pnl_after_costs' END, CASE WHEN u < 2 THEN 'minimum_oos_utc_days' END], lambda x: x IS NOT NULL), ',') AS failed,
        valid AND same AND q >= 3 AND d >= 2 AND t >= 30 AND f <= 100 AND n > 0 AND u >= 2 AS admitted FROM r""")
def q_admission(spark, sf_dir):
    k = c("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumns({
        "artifacts_valid": k % 2 == 0, "compatible": k % 3 != 0, "quality_passing": k % 5, "dataset_count": k % 4, "trade_count": k % 50, "net_pnl": c("s_acctbal"), "utc_day_count": k % 6, "maximum_drawdown": F.abs("s_acctbal") / 50,
    })
    return admission.decide(rows, admission.Thresholds()).select("s_suppkey", F.array_join("failed", ",").alias("failed"), "admitted")


@query("SELECT position FROM (SELECT o_orderkey AS position, o_orderdate AS s, lag(o_orderdate + to_days((o_orderkey % 9)::INT)) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE p > s")
def q_chronology(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("position"), c("o_orderdate").alias("start"), F.expr("o_orderdate + make_interval(0, 0, 0, cast(o_orderkey % 9 as int))").alias("end"))
    return admission.chronology(rows).select("position")


@query("SELECT 'd' || s_suppkey || ': sequence absent for ' || s AS limitation FROM supplier, (VALUES ('f:trades', 0), ('f:mark', 1)) AS v(s, r) WHERE s_suppkey % 3 = 0 AND s_suppkey % 2 = r")
def q_limitations(spark, sf_dir):
    k = c("s_suppkey")
    state = lambda r: F.when(k % 2 == r, "absent").otherwise("present")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), k).alias("dataset_id"), F.when(k % 3 == 0, "pass").otherwise("warning").alias("status"), F.create_map(F.lit("f:trades"), state(0), F.lit("f:mark"), state(1)).alias("streams"))
    return admission.limitations(rows)


@query("SELECT l_returnflag AS dataset, count(*) AS objects, sum(l_linenumber)::BIGINT AS rows, sum(l_orderkey)::BIGINT AS bytes FROM lineitem GROUP BY 1")
def q_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("dataset"), c("l_linenumber").cast("long").alias("row_count"), c("l_orderkey").alias("bytes"))
    return operations.sizes_by_dataset(rows, ["dataset"])


@query("""SELECT o_orderkey AS dataset_id, CASE WHEN o_orderkey % 10 = 0 THEN 'absent' WHEN o_orderkey % 10 = 1 THEN 'range_differs' WHEN o_orderkey % 10 = 2 THEN 'not_quarantined' WHEN o_orderkey % 10 = 3 THEN 'event_count_differs' WHEN o_orderkey % 10 = 4 THEN 'trade_count_differs' ELSE 'adopted' END AS verdict FROM orders""")
def q_adoption(spark, sf_dir):
    k = c("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders")
    plan = rows.select(c("o_orderkey").alias("dataset_id"), c("o_orderdate").alias("window_start"), c("o_orderdate").alias("window_end"), F.lit(5).alias("expected_event_count"), F.lit(2).alias("expected_trade_count"))
    remote = rows.where(k != 0).select(
        c("o_orderkey").alias("dataset_id"), c("o_orderdate").alias("window_start"), F.when(k == 1, c("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(c("o_orderdate")).alias("window_end"), (k != 2).alias("quarantined"), F.lit(False).alias("admission_eligible"),
        F.when(k == 3, 6).otherwise(5).alias("event_count"), F.when(k == 4, 1).otherwise(2).alias("trade_count"),
    )
    return operations.adoption(plan, remote).select("dataset_id", "verdict")


@query("SELECT DISTINCT 'd' || o_custkey AS dataset_id FROM orders WHERE o_orderkey % 4 = 1")
def q_incomplete_attempts(spark, sf_dir):
    name = F.when(c("o_orderkey") % 4 == 1, "INCOMPLETE").otherwise("events.parquet")
    keys = F.concat(F.lit("archives/d"), c("o_custkey"), F.lit("/attempts/a"), c("o_orderkey"), F.lit("/"), name)
    return manifests.incomplete_attempts(table(spark, sf_dir, "orders").select(keys.alias("key")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def q_checkpoints(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 5 != 0, "ETH").alias("symbol"), F.when(c("o_orderkey") % 7 == 0, 2).otherwise(1).alias("pipeline_version"))
    return manifests.incompatible_checkpoints(rows, symbol="ETH", pipeline_version=1).select("o_orderkey")


@query("""SELECT 'p' || o_orderkey AS path, CASE o_orderkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'unexpected' WHEN 2 THEN 'bytes_differ' ELSE 'sha256_differs' END AS problem FROM orders WHERE o_orderkey % 6 < 4""")
def q_changed_inputs(spark, sf_dir):
    k = c("o_orderkey") % 6
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), c("o_orderkey")).alias("path"), F.lit(5).alias("bytes"), F.lit("h").alias("sha256"), k.alias("k"))
    found = files.where("k <> 0").withColumns({"bytes": F.when(c("k") == 2, 6).otherwise(5), "sha256": F.when(c("k") == 3, "g").otherwise("h")})
    return manifests.changed_inputs(files.where("k <> 1"), found)


RECORD = '{"timestamp":"2024-01-01T00:00:00Z","exit_code":%d,"restart_count":0,"failure_stage":"%s","error_class":"%s","stderr_lines":["%s"],"oom_killed":%s,"revision":"unknown"}'


@query(f"SELECT event_id, k * 3 <= 255 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AS ok FROM (SELECT event_id, {K} AS k FROM events)")
def q_failure_records(spark, sf_dir):
    k = c("k")
    record = F.format_string(RECORD, k * 3, F.when(k % 5 == 0, "elsewhere").otherwise("stream"), F.when(k % 7 == 0, "oops").otherwise("ValueError"), F.repeat(F.lit("x"), F.when(k % 11 == 0, 161).otherwise(160)), F.lit("0"))
    return events(spark, sf_dir).select("event_id", operations.failure_record_ok(record).alias("ok"))


@query(f"""SELECT event_id, NOT (k % 3 = 0 AND k % 2 = 0) AND k % 5 <> 0 AND (k % 7 <> 0 OR k % 2 = 0) AS ok FROM (SELECT event_id, {K} AS k FROM events)""")
def q_metric_rows(spark, sf_dir):
    """Ready rows whose disk isn't safe, rows with a value that isn't allowed, and rows whose runtime figure is not that of its parts."""
    k = c("k")
    ready = k % 2 == 0
    figures = dict.fromkeys(operations.METRICS, F.lit(1)) | {
        "collector_health": F.lit(2), "collector_restart_loop": F.lit(0), "failure_oom_killed": F.lit(0), "collector_restart_count": F.lit(0), "failure_exit_code": F.lit(0), "failure_summary_age_seconds": F.lit(9), "readiness": F.when(ready, 1).otherwise(0),
        "disk_safe": F.when(k % 3 == 0, 0).otherwise(1), "swap_safe": F.when(k % 5 == 0, 4).otherwise(1), "ports_safe": F.when((k % 7 == 0) & ~ready, 0).otherwise(1), "collector_restart_state": F.lit("healthy_stable"), "storage_state": F.lit("ready"),
    }
    return events(spark, sf_dir).withColumns(figures).select("event_id", operations.metric_row_ok().alias("ok"))


@query(f"""SELECT event_id, CASE WHEN k % 9 = 0 THEN 'missing_report' WHEN k % 8 = 0 THEN 'unsupported_version' WHEN k % 7 = 0 THEN 'inputs_changed' WHEN k % 4 = 0 THEN 'rejected' WHEN k % 4 = 1 THEN 'warnings_not_allowed' WHEN k % 4 = 2 THEN 'invalid_status' ELSE 'accepted' END AS verdict FROM (SELECT event_id, {K} AS k FROM events)""")
def q_quality_gate(spark, sf_dir):
    k = c("k")
    status = F.when(k % 9 != 0, choose(k, F.lit("rejected"), F.lit("warning"), F.lit("odd"), F.lit("pass")))
    return events(spark, sf_dir).select("event_id", quality.gate(status, F.when(k % 8 == 0, 4).otherwise(5), False, F.when(k % 7 == 0, 1).otherwise(0)).alias("verdict"))


@query("""SELECT "index", problem FROM (SELECT o_orderkey AS "index", CASE o_orderkey % 4 WHEN 0 THEN 'event_count_differs' WHEN 1 THEN 'trade_count_differs' END AS problem FROM orders WHERE o_orderkey % 8 <> 5) WHERE problem IS NOT NULL""")
def q_window_problems(spark, sf_dir):
    k = c("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    plan = rows.select(k.alias("index"), F.lit(9).cast("long").alias("expected_event_count"), F.lit(3).cast("long").alias("expected_trade_count"))
    status = F.when(k % 8 == 5, "pending").when(k % 3 == 0, "completed_quarantined").otherwise("completed_admissible")
    progress = rows.select(k.alias("index"), status.alias("status"), F.when(k % 4 == 0, 8).otherwise(9).cast("long").alias("event_count"), F.when(k % 4 == 1, 2).otherwise(3).cast("long").alias("trade_count"), F.lit(True).alias("checksums_ok"))
    return planning.checked_windows(plan, progress).where("problem IS NOT NULL").select("index", "problem")


@query("""SELECT s_suppkey, CASE WHEN r >= 1000 AND d >= 300 THEN ceil(r / d * 86400 * (1000000.0::DOUBLE / r))::BIGINT ELSE -1 END AS daily, CASE WHEN r >= 1000 AND d >= 300 THEN round(greatest(10000000000 - 3000000000, 0) / ceil(r / d * 86400 * (1000000.0::DOUBLE / r)), 2) ELSE -1 END AS days
    FROM (SELECT s_suppkey, (s_suppkey * 37 + 900)::DOUBLE AS r, (s_suppkey % 7 * 100 + 100)::DOUBLE AS d FROM supplier)""")
def q_growth(spark, sf_dir):
    rows, span = (c("s_suppkey") * 37 + 900).cast("double"), (c("s_suppkey") % 7 * 100 + 100).cast("double")
    daily = classify.daily_bytes(F.lit(1_000_000.0), rows, span)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(daily, F.lit(-1)).cast("long").alias("daily"), F.coalesce(classify.headroom_days(F.lit(10_000_000_000), daily, 3_000_000_000), F.lit(-1.0)).alias("days"))


@query("SELECT l_suppkey, max(l_quantity) AS bid, min(l_quantity) AS ask FROM lineitem GROUP BY l_suppkey")
def q_best_levels(spark, sf_dir):
    side = F.map_from_entries(F.array_sort(F.collect_set(F.struct(c("l_quantity").alias("p"), F.lit(1).alias("q")))))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(side.alias("s")).select("l_suppkey", orderbook.best(c("s"), True).alias("bid"), orderbook.best(c("s"), False).alias("ask"))


@query("SELECT event_type, count(*) AS files, sum(n)::BIGINT AS rows, 0::BIGINT AS problems FROM (SELECT event_type, event_id // 10000 AS part, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def q_archive_files(spark, sf_dir):
    """Parts written to files, and the figures read back from each file held to those of the rows that went in."""
    from tapelake.plans.market import scratch

    out = scratch(spark, "parts")
    rows = table(spark, sf_dir, "events").select(c("event_id").alias("raw_event_id"), "event_type", archive.part("event_id").alias("part"))
    rows.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "raw_event_id").write.partitionBy("event_type", "part").parquet(out)
    files = spark.read.parquet(out)
    place = [F.regexp_extract("path", rf"/{n}=([^/]*)/", 1).alias(n) for n in ("event_type", "part")]
    found = archive.file_figures(files).select(*place, "row_count", "min_id", "max_id", "id_sha256").withColumn("part", c("part").cast("long"))
    manifest = archive.chunk_digests(rows, ["event_type", "part"], "raw_event_id")
    bad = archive.verify(manifest, found, ["event_type", "part"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("problems"))
    counts = found.groupBy("event_type").agg(F.count(F.lit(1)).alias("files"), F.sum("row_count").alias("rows"))
    return counts.join(bad, "event_type", "left").withColumn("problems", F.coalesce("problems", F.lit(0).cast("long")))


@query(f"SELECT event_id, CASE WHEN {K} % 4 = 0 THEN 'pending' WHEN {K} % 4 = 1 THEN 'failed_storage' ELSE 'completed_admissible' END AS status FROM events")
def q_recovered(spark, sf_dir):
    k = c("k")
    return events(spark, sf_dir).select("event_id", manifests.recovered(choose(k, F.lit("running"), F.lit("failed_storage"), F.lit("completed_admissible"), F.lit("completed_admissible"))).alias("status"))
