"""Decoders fail closed: what is not sound raises or carries a reason, and is never guessed."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import decoders, releases

GOOD = {"type": "FeatureCollection", "numberReturned": 2, "features": [{"id": "a", "properties": json.dumps({"site": "1", "unit": "ft^3/s", "t": 5, "value": "10", "approval_status": "Approved"})}, {"id": "b", "properties": json.dumps({"site": "1", "unit": "ft^3/s", "t": 6, "value": None, "approval_status": "Approved"})}]}


def page(spark, body: dict | str, sha: str | None = None, site: int = 1):
    text = body if isinstance(body, str) else json.dumps(body)
    return spark.createDataFrame([(site, sha or hashlib.sha256(text.encode()).hexdigest(), text)], "site long, sha256 string, body string")


def test_continuous(spark):
    out = decoders.continuous(page(spark, GOOD)).orderBy("row_index").collect()
    assert [(r.feature_id, r.exclusion, r.usable) for r in out] == [("a", None, True), ("b", "missing_value", False)]
    assert out[0].value_si == pytest.approx(0.28316846592) and out[1].value_si is None
    assert out[0].record_id.endswith(":0")


@pytest.mark.parametrize(
    ("change", "message"),
    [({"numberReturned": 3}, "unsound"), ({"type": "x"}, "unsound"), ({"features": None}, "unsound")],
)
def test_unsound_pages_raise(spark, change, message):
    with pytest.raises(Exception, match=message):
        decoders.continuous(page(spark, GOOD | change)).collect()


def test_wrong_hash_site_value_raise(spark):
    with pytest.raises(Exception, match="hash mismatch"):
        decoders.continuous(page(spark, GOOD, sha="00")).collect()
    with pytest.raises(Exception, match="identity"):
        decoders.continuous(page(spark, GOOD, site=2)).collect()
    bad = GOOD | {"features": [{"id": "a", "properties": GOOD["features"][0]["properties"].replace('"10"', '"-1"')}], "numberReturned": 1}
    with pytest.raises(Exception, match="invalid value"):
        decoders.continuous(page(spark, bad)).collect()


def test_collection_problems(spark):
    bodies = ["{", json.dumps(GOOD), json.dumps(GOOD)[:-1] + ', "type": "FeatureCollection"}', "[1]"]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert [r.p for r in df.select(decoders.collection_problem(F.col("body")).alias("p")).collect()] == ["invalid_json", None, "duplicate_key", "invalid_json"]


def test_quality_classes(spark):
    cases = [('{"approval_status":"Approved"}', "approved_unknown_qualifier"), ('{"approval_status":"Approved","qualifier":null}', "approved_unflagged"), ('{"approval_status":"Approved","qualifier":"ESTIMATED"}', "approved_unknown_qualifier"), ('{"approval_status":["Approved"],"qualifier":["ESTIMATED"]}', "approved_estimated"), ('{"qualifier":[]}', "unknown_approval"), ('{"approval_status":"Working"}', "not_approved_or_unknown_status")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert [r.q for r in df.select("i", decoders.strict_quality("x").alias("q")).orderBy("i").collect()] == [q for _, q in cases]


def test_tables(spark, tmp_path):
    with pytest.raises(Exception, match="conflicting rows"):
        decoders.exact_rows(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "k").collect()
    assert decoders.exact_rows(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), "k").count() == 1
    with pytest.raises(Exception, match="unknown provider"):
        decoders.route(spark.createDataFrame([("x", 1)], "provider string, v int"), {"a": lambda d: d}).collect()
    records = spark.createDataFrame([("A", "flood_stage_minor_m", 1, 3.048), ("A", "flood_stage_minor_m", 1, 4.0)], "provider string, parameter string, site int, value_si double")
    with pytest.raises(Exception, match="conflicting thresholds"):
        decoders.thresholds(records, "A").collect()
    assert decoders.thresholds(records.limit(1), "A").first().value_raw == 10.0
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    assert decoders.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int", "a").collect() == [(1, 2)]
    with pytest.raises(Exception):
        decoders.read_csv(spark, str(tmp_path / "x.csv"), "a int, c int", "a").collect()


def test_release(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/r")
    declared = releases.manifest(spark, f"{tmp_path}/r")
    from tidemark.functions.shared import written

    declared = written(declared, "declared")
    first = sorted((tmp_path / "r").glob("part-*"))[0]
    (tmp_path / "r" / f".{first.name}.crc").unlink()
    first.write_bytes(b"changed")
    (tmp_path / "r" / "part-extra").write_bytes(b"x")
    assert sorted(r.status for r in releases.verify(declared, releases.manifest(spark, f"{tmp_path}/r")).collect()) == ["changed", "ok", "ok", "undeclared"]
