"""Files of a run: all or none of them, with BOM, in place of what they replace; places in an order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import crawl, ranks, search
from docquarry.sources import sinks


def listed(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_files_are_written_whole_with_a_bom(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.rtf").write_bytes(b"old")
    (tmp_path / "a" / "2.txt").write_bytes(b"older")
    rows = [("a/1.txt", "текст", "a/1.rtf"), ("a/2.txt", "новый", "a/2.txt"), ("b/c/3.txt", "", None), ("b/4.txt", None, "b/none.rtf")]
    sinks.write_files(spark.createDataFrame(rows, "target string, content string, replaces string").repartition(3), str(tmp_path), bom=True)
    assert listed(tmp_path) == ["a/1.txt", "a/2.txt", "b/4.txt", "b/c/3.txt"]
    assert (tmp_path / "a/1.txt").read_bytes() == "﻿текст".encode() and (tmp_path / "a/2.txt").read_text(encoding="utf-8-sig") == "новый" and (tmp_path / "b/4.txt").read_bytes() == b"\xef\xbb\xbf"
    sinks.write_files(spark.createDataFrame([("x.bin", b"\x00\xff")], "target string, content binary"), f"file://{tmp_path}")
    assert (tmp_path / "x.bin").read_bytes() == b"\x00\xff"
    sinks.write_files(spark.createDataFrame([], "target string, content string"), str(tmp_path))
    assert len(listed(tmp_path)) == 5


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    (tmp_path / "t1.txt").write_bytes(b"before")
    rows = spark.range(6, numPartitions=3).select(F.concat(F.lit("t"), "id", F.lit(".txt")).alias("target"), F.when(F.col("id") == 5, F.raise_error(F.lit("broken"))).otherwise("new").alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format(sinks.Files.name()).mode("append").option("path", str(tmp_path)).save()
    assert listed(tmp_path) == ["t1.txt"] and (tmp_path / "t1.txt").read_bytes() == b"before" and os.listdir(tmp_path) == ["t1.txt"]


def test_two_rows_for_a_target_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="same target"):
        sinks.write_files(spark.createDataFrame([("a", "1"), ("a", "2")], "target string, content string"), str(tmp_path))
    assert listed(tmp_path) == []


def test_error_log_opens_with_a_bom(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("реестр", 'с "кавычками"\nи строкой', "ERROR", "x"), ("r", "t", "OK_PDF", "")]
    assert sinks.write_error_log(spark.createDataFrame(rows, "registry string, title string, status string, error string"), path)
    files = [f for f in listed(path) if f.startswith("part-")]
    assert files and all(open(os.path.join(path, f), "rb").read(11) == b"\xef\xbb\xbfregistry" for f in files)
    got = sinks.read_error_log(spark, path).collect()
    assert [(r["registry"], r["title"], r["status"], r["note"] if "note" in r else "") for r in got] == [("реестр", 'с "кавычками"\nи строкой', "ERROR", "")]


@pytest.mark.parametrize(("start", "stop"), [(0, 5), (0, None), (17, 60), (495, 505), (498, None), (500, 510), (250, 251)])
def test_places_equal_a_sorted_list(spark, start, stop):
    r = random.Random(start)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), k) for k in range(500)]
    r.shuffle(rows)
    got = ranks.slice_of(spark.createDataFrame(rows, "a int, k int").repartition(5), [F.col("a").desc(), F.col("k")], start, stop).collect()
    want = sorted(rows, key=lambda x: (-(x[0] or 0), x[1]))[start:stop]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_deep_pages_and_items(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 7 * 20 - 10).cast("int").alias("points"), F.lit(1).alias("mode_ord"), (F.col("id") % 100).alias("page_ord"), F.col("id").alias("anchor_ord"))
    near = [tuple(r) for r in search.page_of(rows, 40, 7).collect()]
    monkeypatch.setattr(search, "NEAR", 0)
    assert [tuple(r) for r in search.page_of(rows, 40, 7).collect()] == near and len(near) == 7
    items = spark.range(90).select(F.col("id").alias("ord"), (F.col("id") % 4).cast("string").alias("num"))
    assert sorted(r["ord"] for r in crawl.select_items(items, ["1", "2"], start=3, limit=4).collect()) == [5, 6, 9, 10]
    assert crawl.select_items(items, None, start=81).count() == 10 and crawl.select_items(items).count() == 90


def test_no_stage_sees_all_rows(spark):
    """A slice is read from its ranges' files alone."""
    rows = spark.range(100_000).select(F.col("id").alias("k"))
    got = ranks.slice_of(rows, [F.col("k")], 70_000, 70_005)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((_part" in plan.replace("isnotnull(_part#", "") or "_part" in plan
    assert "Exchange" not in plan and "Window" not in plan and sorted(r["k"] for r in got.collect()) == list(range(70_000, 70_005))
