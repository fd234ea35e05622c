"""Immutable datasets: export, manifest, quality gate, restore check, attempts, plans, listing and replay.

Tables are written and read by Spark; documents (manifest, report, markers, plans) are small texts that go through the
same file systems. Nothing is overwritten: a document or dataset that is there already is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.functions import extract
from tapelake.operators import archive, candles, manifests, ordering, quality
from tapelake.sources import tape

SUPPORTED = (1, 2)  # fixed value: schema versions of a dataset
TABLES = {"events": "events.parquet", "candles_1s": "candles_1s.parquet"}
MANIFEST, REPORT, COMPLETED, INCOMPLETE = "manifest.json", "quality_report.json", "COMPLETED", "INCOMPLETE"  # fixed values: file names
PART_ROWS = 1_000_000


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document; one that is there is an error."""
    fs, at = _path(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> str | None:
    """A small document's text; None if it isn't there."""
    if not exists(spark, path):
        return None
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def document(content: dict) -> str:
    return json.dumps(content, indent=2, sort_keys=True) + "\n"


def utc(at: datetime) -> str:
    if at.tzinfo is None:
        raise ValueError("times must have a zone")
    return at.astimezone(timezone.utc).isoformat()


def dataset_id(symbol: str, start: datetime, end: datetime, version: int = 2) -> str:
    stamp = lambda t: t.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    return f"{symbol.lower().replace('/', '-')}_{stamp(start)}_{stamp(end)}_v{version}"


def projection(events: DataFrame) -> DataFrame:
    """A tape's rows as a dataset holds them: topic, raw_event_id, canonical payload, version 1 where there is none."""
    return events.select(
        "source", F.col("event_type").alias("topic"), "symbol", F.col("id").alias("raw_event_id"), "exchange_at", "sequence", "connection_id", "local_sequence", "exchange_sequence",
        F.coalesce(F.nullif(F.col("schema_version"), F.lit(0)), F.lit(1)).cast("short").alias("raw_schema_version"), "received_at", "latency_ms", extract.canonical_json(F.col("payload")).alias("payload_json"),
    )


def sample(events: DataFrame, start: datetime, end: datetime, rows: int) -> DataFrame:
    """A bounded sample that shows neither ids nor payloads, in receipt order."""
    return tape.received(events, start=start, end=end).select("received_at", "exchange_at", "source", "event_type", "symbol", "sequence", "latency_ms").orderBy("received_at").limit(rows)


def high_water(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The greatest id, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("high_water"))


def counts(**tables: DataFrame) -> DataFrame:
    """table and rows of each named table, empty ones too."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.union(one)
    return out


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path below the dataset, bytes and sha256 of each of its data files."""
    files = archive.file_checksums(spark, path)
    name = F.substring_index(F.col("path"), f"/{path.rstrip('/').rpartition('/')[2]}/", -1)
    return files.select(name.alias("path"), "bytes", "sha256").where(F.col("path").endswith(".parquet"))


def export(events: DataFrame, symbol: str, start: datetime, end: datetime, root: str) -> str:
    """Writes events, candles and, last, the manifest of a symbol's receipt range; returns the dataset's path."""
    spark, name = events.sparkSession, dataset_id(symbol, start, end)
    path = f"{root.rstrip('/')}/{name}"
    if exists(spark, path):
        raise FileExistsError(path)
    rows = tape.received(events, symbol, start, end)
    tables = {"events": projection(rows).orderBy("received_at", "raw_event_id"), "candles_1s": candles.payload_candles(rows).drop("symbol").orderBy("timestamp")}
    for key, df in tables.items():
        df.write.mode("errorifexists").option("compression", "zstd").option("maxRecordsPerFile", PART_ROWS).parquet(f"{path}/{TABLES[key]}")
    found = {key: spark.read.schema(df.schema).parquet(f"{path}/{TABLES[key]}") for key, df in tables.items()}
    last = found["events"].agg(F.max(F.unix_micros("received_at"))).first()[0]
    exported = end if last is None else datetime.fromtimestamp(last / 1e6, timezone.utc)
    put(spark, f"{path}/{MANIFEST}", document({
        "schema_version": 2, "dataset_id": name, "symbol": symbol, "start_utc": utc(start), "end_utc": utc(end), "exported_at_utc": utc(exported),
        "row_counts": {key: df.count() for key, df in found.items()}, "checksums": {r["path"]: {"size_bytes": r["bytes"], "sha256": r["sha256"]} for r in checksums(spark, path).collect()},
    }))
    return path


def manifest_problems(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a dataset's manifest and files; none if all is as it was exported."""
    text = get(spark, f"{path}/{MANIFEST}")
    if text is None:
        return ["missing_manifest"]
    try:
        m = json.loads(text)
    except ValueError:
        return ["unreadable_manifest"]
    if m.get("schema_version") not in SUPPORTED:
        return ["unsupported_version"]
    out = [] if m.get("dataset_id") == path.rstrip("/").rpartition("/")[2] else ["id_differs_from_folder"]
    try:
        again = dataset_id(str(m["symbol"]), datetime.fromisoformat(m["start_utc"]), datetime.fromisoformat(m["end_utc"]), int(m["schema_version"]))
    except (KeyError, TypeError, ValueError):
        return [*out, "invalid_metadata"]
    out += [] if again == m.get("dataset_id") else ["id_inconsistent"]
    rows = m.get("row_counts")
    if not isinstance(rows, dict) or not all(type(rows.get(k)) is int and rows[k] >= 0 for k in TABLES):
        out.append("invalid_row_counts")
    sums = m.get("checksums")
    if not isinstance(sums, dict) or {k.partition("/")[0] for k in sums} - set(TABLES.values()):
        return [*out, "invalid_checksums"]
    wanted = spark.createDataFrame([(k, v["size_bytes"], v["sha256"]) for k, v in sums.items()], "path string, bytes long, sha256 string")
    return out + sorted(f"{r['problem']}: {r['path']}" for r in manifests.changed_inputs(wanted, checksums(spark, path)).collect())


def require_manifest(spark: SparkSession, path: str) -> dict:
    problems = manifest_problems(spark, path)
    if problems:
        raise ValueError("; ".join(problems))
    return json.loads(get(spark, f"{path}/{MANIFEST}"))


def validate(spark: SparkSession, path: str, now: datetime | None = None, write: bool = True, **how) -> dict:
    """The quality report of a dataset in the order of its files; written beside it unless asked not to."""
    m = require_manifest(spark, path)
    rows = ordering.file_order(spark.read.parquet(f"{path}/{TABLES['events']}"))
    at = lambda key: F.lit(datetime.fromisoformat(m[key]))
    row = quality.payload_report(rows, ["file_path", "row_index"], at("start_utc"), at("end_utc"), same=[c for c in rows.columns if c not in ("file_path", "row_index")], **how)
    report = json.loads(manifests.canonical_report(row)) | {
        "quality_report_version": quality.VERSION, "dataset_version": m["dataset_id"], "manifest_sha256": hashlib.sha256(get(spark, f"{path}/{MANIFEST}").encode()).hexdigest(),
        "parquet_inputs": m["checksums"], "validated_at_utc": utc(now or datetime.now(timezone.utc)),
    }
    if write:
        put(spark, f"{path}/{REPORT}", document(report))
    return report


def require_quality(spark: SparkSession, path: str, allow_warnings: bool = False) -> dict:
    """A dataset's report, if nothing has changed since and its status lets it be evaluated; else an error that says why."""
    text, manifest = get(spark, f"{path}/{REPORT}"), get(spark, f"{path}/{MANIFEST}")
    try:
        report = json.loads(text) if text else {}
    except ValueError:
        report = {}
    changed = 0
    if report and (manifest is None or report.get("manifest_sha256") != hashlib.sha256(manifest.encode()).hexdigest()):
        changed = 1
    elif report:
        wanted = spark.createDataFrame([(k, v["size_bytes"], v["sha256"]) for k, v in report.get("parquet_inputs", {}).items()], "path string, bytes long, sha256 string")
        changed = manifests.changed_inputs(wanted, checksums(spark, path)).count()
    row = spark.range(1).select(F.lit(report.get("status")).cast("string").alias("s"), F.lit(report.get("quality_report_version")).cast("int").alias("v"))
    verdict = row.select(quality.gate(F.col("s"), F.col("v"), allow_warnings, F.lit(changed)).alias("x")).first()["x"]
    if verdict != "accepted":
        raise ValueError(verdict)
    return report


def restore(spark: SparkSession, path: str, logical: str | None = None, **how) -> dict:
    """A copy's check: files and manifest as exported, the report's content as recorded, and quality computed again without writing."""
    problems = manifest_problems(spark, path)
    if problems:
        return {"status": "failed", "error": "physical checksum verification failed", "problems": problems}
    recorded = get(spark, f"{path}/{REPORT}")
    if logical is not None and (recorded is None or manifests.logical_digest(recorded) != logical):
        return {"status": "failed", "error": "logical checksum verification failed", "problems": []}
    return {"status": "verified", "quality_status": validate(spark, path, write=False, **how)["status"], "problems": []}


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """name, manifest, quality_status and quality_reason of each dataset below root, newest name first; unreadable manifests are passed over."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    rows = texts.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "UTF-8").alias("text"))
    rows = rows.withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL")
    one = rows.groupBy("name").agg(F.max(F.when(F.col("file") == MANIFEST, F.col("text"))).alias("manifest"), F.max(F.when(F.col("file") == REPORT, F.col("text"))).alias("report")).where("manifest IS NOT NULL")
    report = F.try_parse_json("report")
    reason = F.when(F.col("report").isNull(), "Not validated").otherwise(F.coalesce(F.try_variant_get(report, "$.findings[0]", "string"), F.lit("No findings")))
    return one.select("name", "manifest", F.coalesce(F.try_variant_get(report, "$.status", "string"), F.lit("not_validated")).alias("quality_status"), reason.alias("quality_reason")).orderBy(F.desc("name"))


def replay(events: DataFrame, callback: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """What a callback makes of each row (its payload parsed), rows in receipt order; None is left out.

    The order is kept within and across partitions; a callback that remembers rows sees those of its own partition.
    """
    if not {"exchange_at", "received_at", "payload_json"} <= set(events.columns):
        raise ValueError("a replay needs exchange_at, received_at and payload_json")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(",")]
        for frame in frames:
            made = (callback(row | {"payload": json.loads(row["payload_json"])}) for row in frame.to_dict("records"))
            yield pd.DataFrame([m for m in made if m is not None], columns=names)

    return ordering.receipt_order(events).mapInPandas(run, schema)


def attempt_key(root: str, dataset: str, attempt: str, name: str) -> str:
    return f"{root.rstrip('/')}/archives/{dataset}/attempts/{attempt}/{name}"


def mark_incomplete(spark: SparkSession, root: str, dataset: str, attempt: str, uploaded: list[str], error: str | None) -> None:
    """An attempt's marker of failure; a second one changes nothing."""
    key = attempt_key(root, dataset, attempt, INCOMPLETE)
    if not exists(spark, key):
        put(spark, key, document({"status": INCOMPLETE, "dataset_id": dataset, "attempt_id": attempt, "uploaded_keys": uploaded, "error": error}))


def mark_completed(spark: SparkSession, root: str, dataset: str, attempt: str, **more) -> None:
    """The dataset's one marker of completion: a second attempt is an error."""
    put(spark, f"{root.rstrip('/')}/archives/{dataset}/{COMPLETED}", document({"status": COMPLETED, "dataset_id": dataset, "attempt_id": attempt} | more))


def quarantine(records: DataFrame, path: str) -> None:
    """Appends records to the registry of quarantined datasets, JSON lines; none of them is eligible."""
    records.withColumn("admission_eligible", F.lit(False)).write.mode("append").json(path)


def write_plan(spark: SparkSession, path: str, plan: dict) -> str:
    """A plan and the digest beside it; a plan that is there is an error."""
    text = document(plan)
    put(spark, f"{path}/plan.json", text)
    digest = hashlib.sha256(text.encode()).hexdigest()
    put(spark, f"{path}/plan.sha256", digest + "\n")
    return digest


def read_plan(spark: SparkSession, path: str) -> dict:
    """A plan that still has the digest beside it."""
    text, digest = get(spark, f"{path}/plan.json"), get(spark, f"{path}/plan.sha256")
    if text is None or digest is None:
        raise ValueError("plan or its digest is missing")
    if hashlib.sha256(text.encode()).hexdigest() != digest.strip():
        raise ValueError("plan changed")
    return json.loads(text)


def checkpoint(chunks: DataFrame, start: datetime, end: datetime, symbol: str) -> dict:
    """Where an export stands: the interval, the last id and the rows so far."""
    last, rows = chunks.agg(F.max("max_id"), F.coalesce(F.sum("row_count"), F.lit(0))).first()
    return {"interval_start_utc": utc(start), "interval_end_utc": utc(end), "symbol": symbol, "last_raw_event_id": last, "row_count": rows}


def day_manifest(chunks: DataFrame, start: datetime, end: datetime, symbol: str, destination: str) -> dict:
    """The head of a day's manifest over its chunks (row_count, min_id, max_id, id_sha256); an empty day is an error."""
    day = archive.day_digest(chunks.withColumn("_day", F.lit(1)), ["_day"]).first()
    if day is None:
        raise ValueError("archive interval is empty")
    return {
        "dataset_group": "raw_and_normalized", "interval_start_utc": utc(start), "interval_end_utc": utc(end), "symbol": symbol, "min_raw_event_id": day["min_id"], "max_raw_event_id": day["max_id"],
        "raw_row_count": day["row_count"], "raw_id_sha256": day["chunks_sha256"], "destination": destination, "verification_status": "verified",
    }


def run_windows(windows: list[dict], archive_one: Callable[[dict], dict], most_windows: int, most_bytes: int) -> dict:
    """Archives the pending windows of a plan one after the other, within budgets; a failure ends the run and blocks the next one.

    windows: index, status and the plan's counts, in order; `archive_one` returns status, event_count and bytes. Their number is the plan's, not the data's.
    """
    done, used = 0, 0
    if any(w["status"] == "failed_storage" for w in windows):
        return {"status": "failed", "error": "prior window failure", "processed": 0, "bytes": 0, "windows": windows}
    out = [w | {"status": "pending" if w["status"] == "running" else w["status"]} for w in windows]
    for k, w in enumerate(out):
        if w["status"] != "pending":
            continue
        if done >= most_windows or used >= most_bytes:
            return {"status": "partial", "processed": done, "bytes": used, "windows": out}
        got = archive_one(w)
        if got.get("event_count") != w["expected_event_count"]:
            got = got | {"status": "failed_storage"}
        out[k] = w | got
        done, used = done + 1, used + got.get("bytes", 0)
        if out[k]["status"] == "failed_storage":
            return {"status": "failed", "processed": done, "bytes": used, "windows": out}
    return {"status": "completed", "processed": done, "bytes": used, "windows": out}

