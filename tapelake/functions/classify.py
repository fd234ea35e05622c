"""States as CASE expressions over figures. NULL figures are unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1 << 30
MIB = 1 << 20
c = F.col


def quality_status(rows: Column, ordering: Column, out_of_range: Column, findings: Column, partial: Column) -> Column:
    """rejected (empty, disordered or out of range), else warning (some finding, a gap or a partial sequence), else pass."""
    return F.when((rows == 0) | (ordering > 0) | (out_of_range > 0), "rejected").when((findings > 0) | partial, "warning").otherwise("pass")


def rate_state(current: Column, previous: Column, least: int = 30) -> Column:
    ratio = current / F.nullif(previous, F.lit(0))
    return F.when(current.isNull() | previous.isNull() | (current < least) | (previous < least), "unknown").when(ratio < 0.5, "low").when(ratio > 2.0, "high").otherwise("normal")


def gap_state(seconds: Column, limit: float = 60) -> Column:
    return F.when(seconds.isNull(), "unknown").when(seconds <= limit, "ok").otherwise("warning")


def daily_bytes(normalized: Column, rows: Column, span_seconds: Column) -> Column:
    """Bytes a day at the measured rate, rounded up; NULL for samples under 1,000 rows or 300 seconds."""
    return F.when((rows >= 1000) & (span_seconds >= 300) & (normalized > 0), F.ceil(rows / span_seconds * 86_400 * (normalized / rows)))


def headroom_days(free: Column, daily: Column, floor: int = 3 * GIB) -> Column:
    """Days until free space meets the floor, with two decimals."""
    return F.when(daily > 0, F.round(F.greatest(free - floor, F.lit(0)) / daily, 2))


def days_to_threshold(database_bytes: Column, span_seconds: Column, free: Column, floor: int = 3 * GIB, least_span: int = 86_400) -> Column:
    growth = F.when(span_seconds >= least_span, database_bytes / (span_seconds / 86_400))
    return F.when(growth > 0, F.greatest(free - floor, F.lit(0)) / growth)


def forecast_state(days: Column, free: Column, floor: int = 3 * GIB) -> Column:
    return F.when(free <= floor, "critical").when(days.isNull(), "unknown").when(days <= 7, "warning").otherwise("ok")


def stream_status(known: Column, recent: Column, freshness: Column, disordered: Column, malformed: Column, duplicates: Column, gap: Column, rate: Column, capacity: Column) -> Column:
    critical = (recent == 0) | (freshness == "stale") | (F.coalesce(disordered, F.lit(0)) > 0) | (F.coalesce(malformed, F.lit(0)) > 0) | (capacity == "critical")
    warning = (F.coalesce(duplicates, F.lit(0)) > 0) | (gap == "warning") | rate.isin("low", "high") | capacity.isin("warning", "unknown")
    return F.when(~known, "unknown").when(critical, "critical").when(warning, "warning").otherwise("pass")


def freshness(age: Column, limit: float = 30) -> Column:
    return F.when(age.isNull(), "unknown").when((age >= 0) & (age <= limit), "fresh").otherwise("stale")


def collector_health(age: Column, limit: float = 30) -> Column:
    return F.when(F.greatest(age, F.lit(0.0)) <= limit, "healthy").otherwise("stale")


def resource_gate(free: Column, rss: Column, estimate: Column, stop_free: int = 3 * GIB, pause_free: int = 4 * GIB, stop_rss: int = 160 * MIB, pause_rss: int = 128 * MIB) -> Column:
    return F.when((free < stop_free) | (rss >= stop_rss), "stop").when((free - estimate < pause_free) | (rss >= pause_rss), "pause").otherwise("run")


def capacity_plan(free: Column, raw_mib: Column, normalized_mib: Column, wal_mib: Column, raw_days: Column, normalized_days: Column, degraded: Column, reserve: int = 3 * GIB) -> Column:
    """blocked / warning / safe for the hot window that is asked for."""
    raw, norm, wal = raw_mib * MIB, normalized_mib * MIB, wal_mib * MIB
    usable = F.greatest(free - reserve, F.lit(0))
    hot = F.floor(raw * raw_days + norm * normalized_days)
    affordable = F.when(raw > 0, F.floor(usable / raw)).otherwise(0)
    growth = raw + norm + wal
    days = F.when(growth > 0, usable / growth)
    blocked = (hot > usable) | (affordable < raw_days) | (raw_days == 0) | (free <= reserve + GIB)
    return F.when(blocked, "blocked").when(degraded | F.coalesce(days <= 7, F.lit(False)), "warning").otherwise("safe")


def dataset_split(place: Column, count: Column, validation: int, oos: int) -> Column:
    """place from 1 by time: the last `oos` are out of sample, the `validation` before them validation, the rest training."""
    return F.when(place > count - oos, "out_of_sample").when(place > count - oos - validation, "validation").otherwise("training")


def upload_gate(version: Column, status: Column, allow_warnings: bool = False, expected: int = 5) -> Column:
    return F.when(version != expected, "unsupported_version").when(status == "rejected", "rejected").when((status == "warning") & F.lit(not allow_warnings), "warning_not_allowed").otherwise("allowed")


def window_flags(status: Column) -> tuple[Column, Column]:
    """(quarantined, admission eligible). A bundle with warnings has a state of its own and is neither."""
    return status.isin("completed_quarantined", "skipped_quarantined"), status.isin("completed_admissible", "skipped_verified")


def checked_status(status: Column, quarantined: Column, admission: Column) -> Column:
    """The status, or an error where the window's own flags say the opposite of it; flags that are missing say nothing."""
    held, let = window_flags(status)
    against = ((held & (~quarantined | admission)) | (let & (quarantined | ~admission)))
    return F.when(F.coalesce(against, F.lit(False)), F.raise_error(F.concat(F.lit("window flags contradict the status "), status))).otherwise(status)


def restart_state(first: str, second: str, age: Column) -> Column:
    """Two samples (struct columns with id, restarts, running, health, started_at) and the second's age in seconds."""
    a, b = F.col(first), F.col(second)
    sick = lambda s: ~s["running"] | (s["health"] != "healthy")
    n = b["restarts"]
    return (
        F.when(sick(a) | sick(b), "unhealthy").when(n < a["restarts"], "unknown").when((a["id"] != b["id"]) | (n > a["restarts"]), "restart_loop").when((b["started_at"] != a["started_at"]) | (age < 0), "unknown")
        .when((n >= 3) & (age <= 1800), "restart_loop").when((n > 0) & (age <= 300), "recent_restart").when(n > 0, "historical_restart").otherwise("healthy_stable")
    )


def readiness(gates: list[Column], swap: Column, available: Column, pressure: Column, least: int) -> Column:
    """-1 unknown, 0 critical, 1 ready, 2 warning. gates: 1 if passed, 0 if not, -1 if unknown."""
    unknown = swap == -1
    passed = F.lit(True)
    for g in gates:
        unknown, passed = unknown | (g == -1), passed & (g == 1)
    unknown = unknown | available.isNull() | (available < 0) | ~pressure.isin("inactive", "sustained")
    return F.when(unknown, -1).when(~passed | (available < least) | (pressure == "sustained"), 0).when(swap == 1, 1).when(swap == 0, 2).otherwise(-1)


def memory_pressure(first: str, second: str, least: int, most_swap: int, most_pressure: float, page: int = 4096) -> Column:
    a, b = F.col(first), F.col(second)
    bad = (a["available"] < 0) | (b["available"] < 0) | (a["swap"] < 0) | (b["swap"] < 0) | (b["pages_in"] < a["pages_in"]) | (b["pages_out"] < a["pages_out"]) | (a["pressure"] < 0) | (b["pressure"] < 0) | F.isnan(a["pressure"]) | F.isnan(b["pressure"])
    moved = (b["pages_in"] - a["pages_in"] + b["pages_out"] - a["pages_out"]) * page
    return F.when(F.coalesce(bad, F.lit(True)), "unknown").when((b["available"] < least) | (b["swap"] - a["swap"] > most_swap) | (moved > most_swap) | (F.greatest(a["pressure"], b["pressure"]) > most_pressure), "sustained").otherwise("inactive")


def storage_state(required: Column, configured: Column, exists: Column, writable: Column) -> Column:
    """required and configured: arrays of targets; exists and writable: of all required ones."""
    return F.when(required.isNull() | configured.isNull(), "unknown").when(F.array_sort(required) != F.array_sort(configured), "inconsistent").when(F.size(required) == 0, "not_applicable").when(~exists, "required_path_missing").when(~writable, "required_path_unwritable").otherwise("ready")


def contract_active(status: Column) -> Column:
    return F.upper(status).isin("ACTIVE", "LIVE", "NORMAL", "OPEN")


def book_match(seconds_apart: Column, bid: Column, ask: Column, quote_bid: Column, quote_ask: Column, tolerance: float = 2.0) -> Column:
    """not_comparable without both or beyond the tolerance, else match or mismatch."""
    known = bid.isNotNull() & ask.isNotNull() & quote_bid.isNotNull() & quote_ask.isNotNull() & (F.abs(seconds_apart) <= tolerance)
    return F.when(~F.coalesce(known, F.lit(False)), "not_comparable").when((bid == quote_bid) & (ask == quote_ask), "match").otherwise("mismatch")
