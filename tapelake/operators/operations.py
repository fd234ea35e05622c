"""Operational records: collector sequence checks, failure records, adopted archives, redaction of details."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.functions import text


def desyncs(events: DataFrame, connection: str, order: list[str], seq: str, snapshot: Column) -> DataFrame:
    """The event at which each connection loses its order book, and why: missing_snapshot, sequence_gap or sequence_regression.

    A snapshot starts anew, a missing sequence is passed over, a duplicate is a regression. A connection ends at its
    first desync; the offending event stays in the tape.
    """
    w = Window.partitionBy(connection).orderBy(*order)
    rows = events.withColumn("_snap", snapshot).withColumn("_seen", F.sum(F.col("_snap").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("previous", F.last(seq, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n, p = F.col(seq), F.col("previous")
    reason = F.when(F.col("_snap"), None).when(F.col("_seen") == 0, "missing_snapshot").when(n > p + 1, "sequence_gap").when(n <= p, "sequence_regression")
    bad = rows.withColumn("reason", reason).where("reason IS NOT NULL").withColumn("_nth", F.row_number().over(w))
    return bad.where("_nth = 1").select(*events.columns, "previous", "reason")


def newest(records: DataFrame, by: list[str], clock: str, keep: int = 20) -> DataFrame:
    """The newest `keep` records of each group."""
    w = Window.partitionBy(*by).orderBy(F.col(clock).desc())
    return records.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def sizes_by_dataset(objects: DataFrame, by: list[str], rows: str = "row_count", size: str = "bytes") -> DataFrame:
    return objects.groupBy(*by).agg(F.count(F.lit(1)).alias("objects"), F.sum(rows).alias("rows"), F.sum(size).alias("bytes"))


def adoption(plan: DataFrame, remote: DataFrame) -> DataFrame:
    """Whether a quarantined remote archive may stand for a planned window; the first mismatch names the reason."""
    r = remote.select(F.col("dataset_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("window_start", "window_end", "quarantined", "admission_eligible", "event_count", "trade_count")])
    differs = lambda mine, theirs: ~F.col(mine).eqNullSafe(F.col(theirs))
    reason = (
        F.when(F.col("_id").isNull(), "absent").when(differs("window_start", "_window_start") | differs("window_end", "_window_end"), "range_differs")
        .when(~F.coalesce("_quarantined", F.lit(False)) | F.coalesce("_admission_eligible", F.lit(True)), "not_quarantined")
        .when(differs("expected_event_count", "_event_count"), "event_count_differs").when(differs("expected_trade_count", "_trade_count"), "trade_count_differs").otherwise("adopted")
    )
    return plan.join(r, plan["dataset_id"] == r["_id"], "left").select(*plan.columns, reason.alias("verdict"))


RECORD = ("timestamp", "exit_code", "restart_count", "failure_stage", "error_class", "stderr_lines", "oom_killed", "revision")  # fixed values: keys of a failure record
MOST_LINES, MOST_CHARS = 12, 160


def failure_record_ok(record: Column) -> Column:
    """Whether JSON is a failure record: exactly its keys, types, bounds and patterns."""
    v = F.try_parse_json(record)
    at = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    whole = lambda name, low, high: (kind(name) == "BIGINT") & at(name, "bigint").between(low, high)
    said = lambda name, pattern: (kind(name) == "STRING") & at(name, "string").rlike(pattern)
    lines = F.try_variant_get(v, "$.stderr_lines", "array<variant>")
    ok = (
        (F.array_sort(F.json_object_keys(record)) == F.array(*[F.lit(k) for k in sorted(RECORD)]))
        & said("timestamp", r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$") & whole("exit_code", 0, 255) & whole("restart_count", 0, 1_000_000) & whole("oom_killed", 0, 1)
        & at("failure_stage", "string").isin(*[stage for stage, _ in text.STAGE_WORDS], "unknown") & said("error_class", r"^(?:unknown|[A-Z][A-Za-z0-9_]{0,79}(?:Error|Exception))$")
        & said("revision", r"^(?:unknown|[0-9a-f]{40})$")
        & (F.size(lines) <= MOST_LINES) & F.forall(lines, lambda x: (F.schema_of_variant(x) == "STRING") & (F.char_length(F.try_variant_get(x, "$", "string")) <= MOST_CHARS))
    )
    return F.coalesce(ok, F.lit(False))


# fixed values: what a monitor row's figures may be
METRICS = {
    "backup_fresh": (-1, 0, 1), "collector_health": (-1, 0, 1, 2), "collector_restart_loop": (-1, 0, 1), "dashboard_disabled": (-1, 0, 1), "data_paths_writable": (-1, 0, 1, 2), "disk_safe": (-1, 0, 1),
    "failure_oom_killed": (-1, 0, 1), "failure_summary_state": (-1, 0, 1), "ports_safe": (-1, 0, 1), "postgres_health": (-1, 0, 1), "readiness": (-1, 0, 1, 2), "runtime_safe": (-1, 0, 1), "swap_safe": (-1, 0, 1),
}
BOUNDED = {"collector_restart_count": 1_000_000, "failure_exit_code": 255, "failure_summary_age_seconds": 31_536_000}
RESTART_STATES = ("healthy_stable", "recent_restart", "historical_restart", "restart_loop", "unhealthy", "unknown")
STORAGE_STATES = ("ready", "not_applicable", "required_path_missing", "required_path_unwritable", "inconsistent", "unknown")


def metric_row_ok(restart_state: str = "collector_restart_state", storage_state: str = "storage_state") -> Column:
    """Whether a monitor row's columns agree with each other: values allowed, runtime_safe and readiness as their parts say."""
    c = F.col
    ok = c(restart_state).isin(*RESTART_STATES) & c(storage_state).isin(*STORAGE_STATES)
    for name, allowed in METRICS.items():
        ok = ok & c(name).isin(*allowed)
    for name, most in BOUNDED.items():
        ok = ok & c(name).between(-1, most)
    failure = [c(n) for n in ("failure_exit_code", "failure_summary_age_seconds", "failure_oom_killed")]
    ok = ok & F.when(c("failure_summary_state") == 1, F.least(*failure) >= 0).otherwise((F.least(*failure) == -1) & (F.greatest(*failure) == -1))
    runtime = F.when((c("dashboard_disabled") == -1) | (c("ports_safe") == -1), -1).otherwise(((c("dashboard_disabled") == 1) & (c("ports_safe") == 1)).cast("int"))
    gates = (
        (c("postgres_health") == 1) & (c("collector_health") == 2) & (c("collector_restart_loop") == 0) & c("data_paths_writable").isin(1, 2) & (c("backup_fresh") == 1) & (c("disk_safe") == 1)
        & (c("dashboard_disabled") == 1) & (c("ports_safe") == 1)
    )
    unknown = (F.least(*[c(n) for n in METRICS if n not in ("readiness", "failure_oom_killed", "failure_summary_state")]) == -1) | (c(restart_state) == "unknown") | (c(storage_state) == "unknown")
    ready = F.when(c("readiness") == -1, unknown).when(c("readiness") == 1, gates & (c("swap_safe") == 1)).when(c("readiness") == 2, gates & (c("swap_safe") == 0)).otherwise(True)
    return F.coalesce(ok & (c("runtime_safe") == runtime) & ready, F.lit(False))


def redact_details(details: Column) -> Column:
    """JSON with the values of sensitive fields replaced at any depth and all other texts made safe; text that is no JSON becomes NULL."""
    return F.pandas_udf(_redacted, "string")(details)


def _host(found: re.Match) -> str:
    try:
        parts = urlsplit(found[0])
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "[REDACTED_URI]"
    if not re.fullmatch(r"[a-zA-Z0-9.:-]+", host):
        return "[REDACTED_URI]"
    place = (f"[{host}]" if ":" in host else host) + (f":{port}" if port is not None else "")
    return f"{parts.scheme}://{place}" + (parts.path if parts.path in ("", "/") else "/[PATH]")


def safe_text(message: str, limit: int = 500) -> str:
    """What `text.sanitize_message` makes of a message."""
    flat = re.sub(text.URI, _host, message.replace("\r", " ").replace("\n", " ").strip())
    flat = re.sub(text.BEARER, "[REDACTED]", re.sub(text.SECRET_MESSAGE, r"\1[REDACTED]", flat))
    return (flat or "Error")[:limit]


def _redacted(details: pd.Series) -> pd.Series:
    sensitive = re.compile(text.SENSITIVE_FIELD)

    def walk(x):
        if isinstance(x, dict):
            return {k: "[REDACTED]" if sensitive.fullmatch(k) else walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        return safe_text(x) if isinstance(x, str) else x

    def one(row):
        try:
            return json.dumps(walk(json.loads(row)), sort_keys=True)
        except (TypeError, ValueError):
            return None

    return details.map(one)
