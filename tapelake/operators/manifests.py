"""Manifest and progress checks: canonical reports, logical digests, compatible checkpoints, incomplete attempts, window recovery."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLATILE = ("manifest_sha256", "validated_at_utc")  # fixed values: report fields that name the export, not its content


def canonical_report(row: DataFrame) -> str:
    """A report of one row as JSON with sorted keys and an indent of 2; more or fewer rows are an error."""
    found = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).take(2)
    if len(found) != 1:
        raise ValueError("a report is one row")
    return json.dumps(json.loads(found[0]["j"]), indent=2, sort_keys=True) + "\n"


def logical_digest(report: str) -> str:
    """SHA-256 of a quality report's content, whatever the export that it was made for."""
    kept = {k: v for k, v in json.loads(report).items() if k not in VOLATILE}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def changed_inputs(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem (missing, unexpected, bytes_differ, sha256_differs) of files whose bytes or sha256 are not the manifest's."""
    a, b = manifest.alias("a"), found.alias("b")
    problem = (
        F.when(F.col("b.path").isNull(), "missing").when(F.col("a.path").isNull(), "unexpected")
        .when(~F.col("a.bytes").eqNullSafe(F.col("b.bytes")), "bytes_differ").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "sha256_differs")
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def incompatible_checkpoints(checkpoints: DataFrame, **wanted) -> DataFrame:
    """Checkpoints whose named columns differ from the wanted values, null included."""
    same = F.lit(True)
    for name, value in wanted.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return checkpoints.where(~same)


def incomplete_attempts(objects: DataFrame, key: str = "key", root: str = "archives") -> DataFrame:
    """dataset_id, once each, of a listing's datasets with the marker of an incomplete attempt."""
    dataset = F.regexp_extract(key, rf"^{root}/([^/]+)/attempts/(?:.*/)?INCOMPLETE$", 1)
    return objects.select(dataset.alias("dataset_id")).where("dataset_id != ''").distinct()


def recovered(status: Column) -> Column:
    """A window's state after a restart: what was running is pending again."""
    return F.when(status == "running", "pending").otherwise(status)
