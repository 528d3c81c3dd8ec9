"""Exact display, handoff archives and replay sets."""

from __future__ import annotations

import hashlib
import io
import os
import random
import tarfile
from datetime import date
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tidemark.functions.digits import fraction_text
from tidemark.operators import panels
from tidemark.sources import archives, replays


def test_fraction_text_is_that_of_decimal(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 10 ** rng.randint(1, 30)), rng.choice([1, 3, 7, 12, 1200, 999, 2**40, 10**9, rng.randint(1, 10**17)])) for _ in range(600)]
    rows += [(0, 7), (10**25, 1), (999999, 1000000), (2, 3), (-5, 3), (1, 10**17), (10**17 - 1, 10**17), (7, None), (None, 3), (1, 0), (5, -1), (25, 2)]
    df = spark.createDataFrame([(None if n is None else Decimal(n), d) for n, d in rows], "n decimal(38,0), d long")
    for precision in (50, 12):
        found = [r.t for r in df.select(fraction_text(F.col("n"), F.col("d"), precision).alias("t")).collect()]
        for (n, d), text in zip(rows, found, strict=True):
            if n is None or d is None or d <= 0:
                assert text is None
                continue
            if len(str(abs(n) // d)) >= precision:
                continue  # beyond what is promised
            with localcontext() as context:
                context.prec = precision
                assert text == format(Decimal(n) / Decimal(d), "f"), (n, d)


def members(spark, rows):
    return spark.createDataFrame(rows, "name string, content string").repartition(3)


def test_archive_is_a_tar_and_the_same_each_time(spark, tmp_path):
    rows = [(f"a/{i}.csv", "é" * (i * 37) + "\n") for i in range(60)] + [("empty", ""), ("none", None), ("block", "x" * 512), ("long", "y" * 70_000)]
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    digest = archives.pack(members(spark, rows), one, volume_bytes=20_000)
    assert digest == archives.pack(members(spark, rows[::-1]), two, volume_bytes=20_000)

    def volumes(path):
        return sorted(hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(f"{path}/volumes") for f in fs if f.startswith("part-"))

    assert volumes(one) == volumes(two) and len(volumes(one)) > 2
    seen = {}
    for d, _, files in os.walk(f"{one}/volumes"):
        for f in files:
            if f.startswith("part-"):
                with tarfile.open(fileobj=io.BytesIO(open(os.path.join(d, f), "rb").read())) as tar:
                    assert [m.name for m in tar] == sorted(m.name for m in tar)
                    seen |= {m.name: tar.extractfile(m).read().decode() for m in tar}
    assert seen == {n: c or "" for n, c in rows}
    assert {r.status for r in archives.verify_archive(spark, one, digest).collect()} == {"ok"}


def test_archive_names_what_was_tampered_with(spark, tmp_path):
    rows = [(f"{i}.txt", f"text {i} " * 50) for i in range(20)]
    path, other = f"{tmp_path}/archive", f"{tmp_path}/other"
    digest = archives.pack(members(spark, rows), path)
    archives.pack(members(spark, [(n, c + "!" if n == "3.txt" else c) for n, c in rows if n != "5.txt"] + [("new.txt", "n")]), other)
    found = {r.name: r.status for r in archives.verify_archive(spark, other, digest, archives.read_index(spark, path)).collect()}
    assert {n: s for n, s in found.items() if s != "ok"} == {"3.txt": "changed", "5.txt": "missing", "new.txt": "undeclared"}
    with pytest.raises(ValueError, match="index"):
        archives.verify_archive(spark, other, digest)
    volume = next(os.path.join(d, f) for d, _, fs in os.walk(f"{path}/volumes") for f in fs if f.startswith("part-"))
    raw = bytearray(open(volume, "rb").read())
    raw[100] ^= 1  # the mode in the first header no longer fits its sum
    with open(volume, "wb") as f:
        f.write(raw)
    crc = os.path.join(os.path.dirname(volume), f".{os.path.basename(volume)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    broken = {r.name: r.status for r in archives.verify_archive(spark, path, digest).collect()}
    assert broken["volume=0"] == "broken" and "missing" in broken.values()


@pytest.mark.parametrize("rows", [[("a", "x"), ("a", "y")], [(None, "x")], [("é", "x")], [("n" * 101, "x")]])
def test_archive_refuses_names(spark, tmp_path, rows):
    with pytest.raises(Exception, match="name"):
        archives.pack(members(spark, rows), f"{tmp_path}/a")


def test_empty_archive(spark, tmp_path):
    digest = archives.pack(members(spark, []), f"{tmp_path}/a")
    assert archives.verify_archive(spark, f"{tmp_path}/a", digest).count() == 0


def test_replay_set(spark, tmp_path):
    manifest, out = f"{tmp_path}/manifest.json", f"{tmp_path}/results/set"
    with open(manifest, "w") as f:
        f.write('{"a": 1}')

    def derive(_):
        return {"rows": spark.range(5), "labels": spark.range(3).withColumn("x", F.lit("y"))}

    def replace(path):
        with open(path, "w") as f:
            f.write('{"a": 2}')
        return derive(path)

    def fail(path):
        return derive(path) | {"broken": spark.range(2).select(F.raise_error(F.lit("stop")).alias("x"))}

    def left():
        return sorted(x for x in os.listdir(f"{tmp_path}/results") if not x.endswith(".crc")) if os.path.exists(f"{tmp_path}/results") else []

    with pytest.raises(Exception, match="stop"):
        replays.write_replay_set(spark, manifest, fail, out)
    assert left() == []
    with pytest.raises(ValueError, match="manifest changed"):
        replays.write_replay_set(spark, manifest, replace, out)
    assert left() == []
    replays.write_replay_set(spark, manifest, derive, out)
    assert left() == ["set"]
    with pytest.raises(FileExistsError):
        replays.write_replay_set(spark, manifest, derive, out)
    assert left() == ["set"] and spark.read.json(f"{out}/rows").count() == 5
    found = {r.name: r.status for r in replays.verify_replay_set(spark, out, manifest).collect()}
    assert set(found.values()) == {"ok"} and "manifest" in found and any(n.startswith("labels/") for n in found)
    with open(manifest, "w") as f:
        f.write('{"a": 3}')
    assert {r.name for r in replays.verify_replay_set(spark, out, manifest).collect() if r.status != "ok"} == {"manifest"}


def test_pairs_of_cells_that_both_have(spark):
    """A site without a threshold in one lane has no pair with it, as in SQL; a repeated label raises."""
    cells = [("primary", "primary"), ("unflagged", "primary")]
    day = date(2024, 1, 20)
    rows = [(site, *cell, day, 24, "negative", "armed") for site in (1, 2) for cell in cells if (site, cell[0]) != (2, "unflagged")]
    kind = "site long, ref_lane string, lane string, issue_date date, horizon int, status string, issue_state string"
    assert [r.site for r in panels.paired(spark.createDataFrame(rows, kind), cells).collect()] == [1]
    with pytest.raises(Exception, match="repeats a key"):
        panels.paired(spark.createDataFrame([*rows, rows[0]], kind), cells).collect()
