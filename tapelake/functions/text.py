"""Identifiers and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyyMMdd'T'HHmmssSSSSSS'Z'"
# fixed values: patterns
SECRET = r"(?i)(password|passwd|token|secret|api[_-]?key|authorization)\s*([=:])\s*[^\s,;]+"
SECRET_MESSAGE = r"(?i)(api[_-]?key|authorization|token|secret|password)\s*[:=]\s*\S+"
BEARER = r"(?i)bearer\s+\S+"
URI = r"(?i)\b[a-z][a-z0-9+.-]*://\S+"
URL = r"(?i)\b(?:[a-z][a-z0-9+.-]*://)[^\s]+"
PATH = r"(?:[A-Za-z]:\\|/)[^\s:]+"
ADDRESS = r"(?i)\b(?:\d{1,3}\.){3}\d{1,3}\b|\b[a-z0-9][a-z0-9.-]*\.(?:com|net|org|io|dev|local|internal)\b"
CONTROL = r"[\x00-\x1f\x7f]+"
ERROR_CLASS = r"\b([A-Z][A-Za-z0-9_]{0,79}(?:Error|Exception))\b"
STAGE_WORDS = (
    ("startup", ("startup", "configuration", "config")),
    ("database", ("postgres", "database", "sqlalchemy")),
    ("stream", ("websocket", "stream", "subscribe")),
    ("storage", ("storage", "write failure", "disk")),
)
SENSITIVE_FIELD = r"(?i)(?:api[_-]?key|authorization|access[_-]?token|token|secret|password)"
VERSION = r"^v[1-9][0-9]*$"


def slug(symbol: Column) -> Column:
    return F.translate(symbol, "/:", "--")


def dataset_id(symbol: Column, start: Column, end: Column, version: int = 2) -> Column:
    return F.concat(F.lower(F.translate(symbol, "/", "-")), F.lit("_"), F.date_format(start, STAMP), F.lit("_"), F.date_format(end, STAMP), F.lit(f"_v{version}"))


def plan_id(symbol: Column, start: Column, end: Column, window_s: int) -> Column:
    """Id of a plan that cuts a range into windows of so many seconds."""
    return F.concat(F.lit("batch_"), F.lower(F.translate(symbol, "/", "-")), F.lit("_"), F.date_format(start, STAMP), F.lit("_"), F.date_format(end, STAMP), F.lit(f"_w{window_s}"))


def is_version(text: Column) -> Column:
    return text.rlike(VERSION)


def next_version(names: Column) -> Column:
    """Aggregate: one more than the greatest N of names vN_..."""
    return F.coalesce(F.max(F.regexp_extract(names, r"^v(\d+)_", 1).try_cast("int")), F.lit(0)) + 1


def sanitize_line(line: Column, limit: int = 160) -> Column:
    """A line of error output without secrets, addresses and paths; NULL for frames, headers and blank lines."""
    text = F.trim(F.regexp_replace(line, CONTROL, " "))
    clean = F.regexp_replace(text, SECRET, "$1$2[REDACTED]")
    for pattern in (URL, PATH, ADDRESS):
        clean = F.regexp_replace(clean, pattern, "[REDACTED]")
    return F.when(line.startswith("  File ") | (text == "") | text.startswith("Traceback"), None).otherwise(F.substring(clean, 1, limit))


def safe_uri(uri: Column) -> Column:
    """Of an address scheme, host and port, and whether it has a path; [REDACTED_URI] where host or port don't parse."""
    rest = F.regexp_replace(uri, r"^[^:]*://", "")
    place = F.substring_index(F.regexp_extract(rest, r"^[^/?#]*", 0), "@", -1)  # credentials end at the last @
    plain = place.rlike(r"^[a-zA-Z0-9.-]+(?::[0-9]{0,5})?$")
    numbered = place.rlike(r"^\[[0-9a-fA-F.]*:[0-9a-fA-F.]*:[0-9a-fA-F:.]*\](?::[0-9]{0,5})?$")
    port = F.regexp_extract(place, r":([0-9]{1,5})$", 1)
    closed = F.regexp_extract(place, r"\]:([0-9]{1,5})$", 1)
    port = F.when(numbered, closed).otherwise(port)
    host = F.lower(F.when(numbered, F.regexp_extract(place, r"^\[[^\]]*\]", 0)).otherwise(F.regexp_extract(place, r"^[^:]*", 0)))
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    shown = F.concat(F.lower(F.regexp_extract(uri, r"^([^:]*):", 1)), F.lit("://"), host, F.when(port != "", F.concat(F.lit(":"), port.cast("int").cast("string"))).otherwise(""), F.when(path.isin("", "/"), path).otherwise("/[PATH]"))
    return F.when((plain | numbered) & F.coalesce(port.try_cast("int") <= 65535, F.lit(True)), shown).otherwise("[REDACTED_URI]")


def sanitize_message(message: Column, limit: int = 500) -> Column:
    """One line without secrets; of every address only what `safe_uri` shows."""
    flat = F.trim(F.translate(message, "\r\n", "  "))
    found = F.transform(F.regexp_extract_all(flat, F.lit(URI), F.lit(0)), safe_uri)
    around = F.split(flat, URI, -1)
    flat = F.array_join(F.transform(around, lambda text, k: F.concat(text, F.coalesce(F.get(found, k), F.lit("")))), "")
    flat = F.regexp_replace(F.regexp_replace(flat, SECRET_MESSAGE, "$1[REDACTED]"), BEARER, "[REDACTED]")
    return F.substring(F.when(flat == "", F.lit("Error")).otherwise(flat), 1, limit)


def error_class(text: Column) -> Column:
    found = F.regexp_extract(text, ERROR_CLASS, 1)
    return F.when(found == "", F.lit("unknown")).otherwise(found)


def failure_stage(text: Column) -> Column:
    low, out = F.lower(text), None
    for stage, words in STAGE_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, stage) if out is None else out.when(hit, stage)
    return out.otherwise("unknown")
