"""Stated cases of manifest and progress checks."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tapelake.operators import manifests


def test_canonical_report(spark):
    row = spark.range(1).select(F.lit(2).alias("b"), F.lit(None).cast("string").alias("a"))
    assert manifests.canonical_report(row) == '{\n  "a": null,\n  "b": 2\n}\n'
    with pytest.raises(ValueError, match="one row"):
        manifests.canonical_report(spark.range(2))


def test_logical_digest_ignores_the_export():
    report = {"status": "pass", "manifest_sha256": "x", "validated_at_utc": "t"}
    assert manifests.logical_digest(json.dumps(report)) == manifests.logical_digest(json.dumps({"validated_at_utc": "u", "status": "pass"})) == hashlib.sha256(b'{"status":"pass"}').hexdigest()
    assert manifests.logical_digest(json.dumps(report)) != manifests.logical_digest(json.dumps(report | {"status": "fail"}))


def test_changed_inputs(spark):
    kind = "path string, bytes long, sha256 string"
    a = spark.createDataFrame([("same", 1, "x"), ("gone", 1, "x"), ("size", 1, "x"), ("sum", 1, "x")], kind)
    b = spark.createDataFrame([("same", 1, "x"), ("new", 1, "x"), ("size", 2, "y"), ("sum", 1, None)], kind)
    got = {tuple(r) for r in manifests.changed_inputs(a, b).collect()}
    assert got == {("gone", "missing"), ("new", "unexpected"), ("size", "bytes_differ"), ("sum", "sha256_differs")}


def test_progress(spark):
    points = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "id int, symbol string, version int")
    assert {r.id for r in manifests.incompatible_checkpoints(points, symbol="a", version=1).collect()} == {2, 3}
    keys = spark.createDataFrame([("archives/x/attempts/1/INCOMPLETE",), ("archives/x/attempts/2/INCOMPLETE",), ("archives/y/COMPLETED",), ("archives/z/attempts/1/part",), ("archives/w/attempts/1/NOT_INCOMPLETE",), (None,)], "key string")
    assert [r.dataset_id for r in manifests.incomplete_attempts(keys).collect()] == ["x"]
    states = spark.createDataFrame([("running",), ("failed_storage",), (None,)], "s string")
    assert [r.s for r in states.select(manifests.recovered(F.col("s")).alias("s")).collect()] == ["pending", "failed_storage", None]
