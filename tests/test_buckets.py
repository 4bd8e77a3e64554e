"""Bucketed tables: only touched buckets are read and written, and a manifest makes a run's rows the table."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issue_signals.sources import buckets

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("l", T.StringType()), T.StructField("v", T.DoubleType())])
KEYS = ["k", "l"]


def order():
    return [F.desc("v")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(spark, path, run):
    return sorted(map(tuple, buckets.read_buckets(spark, path, run, SCHEMA).collect()), key=str)


def files(path):
    found = [os.path.join(d, f) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")]
    return {f: os.stat(f).st_mtime_ns for f in found}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def test_a_merge_writes_only_its_buckets(spark, path):
    first = frame(spark, [(k, "a", float(k)) for k in range(500)])
    assert buckets.merge_into(first, path, 0, KEYS, order(), SCHEMA, ["k"], 16) == list(range(16))
    before = files(path)
    changes = [(3, "a", -1.0), (3, "a", -2.0), (700, "b", 7.0)]
    touched = buckets.merge_into(frame(spark, changes), path, 1, KEYS, order(), SCHEMA, ["k"], 16)
    own = spark.createDataFrame([(3,), (700,)], "k long").select(buckets.bucket_of(["k"], 16)).collect()
    assert touched == sorted({r[0] for r in own})
    after = files(path)
    assert all(after[f] == t for f, t in before.items())
    assert {os.path.basename(os.path.dirname(f)) for f in after.keys() - before.keys()} == {f"bucket={b}" for b in touched}
    want = {(k, "a"): float(k) for k in range(500)} | {(3, "a"): -1.0, (700, "b"): 7.0}
    assert rows_of(spark, path, 2) == sorted(((*k, v) for k, v in want.items()), key=str)
    assert rows_of(spark, path, 1) == sorted(((k, "a", float(k)) for k in range(500)), key=str)  # the table as it was


def test_merging_the_same_rows_writes_nothing(spark, path):
    rows = [(k, None if k % 3 == 0 else "a", None if k % 5 == 0 else float(k)) for k in range(50)] + [(None, None, 1.0)]
    buckets.merge_into(frame(spark, rows), path, 0, KEYS, order(), SCHEMA, ["k"], 4)
    before = files(path)
    assert buckets.merge_into(frame(spark, rows), path, 1, KEYS, order(), SCHEMA, ["k"], 4) == []
    assert files(path) == before and rows_of(spark, path, 2) == rows_of(spark, path, 1) == sorted(rows, key=str)


def test_a_failed_run_changes_nothing_and_can_be_repeated(spark, path, monkeypatch):
    buckets.merge_into(frame(spark, [(1, "a", 1.0), (2, "a", 2.0)]), path, 0, KEYS, order(), SCHEMA, None, 4)
    monkeypatch.setattr(buckets, "_close", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    new = frame(spark, [(1, "a", 5.0), (3, "c", 3.0)])
    with pytest.raises(RuntimeError):
        buckets.merge_into(new, path, 1, KEYS, order(), SCHEMA, None, 4)
    monkeypatch.undo()
    assert rows_of(spark, path, 1) == [(1, "a", 1.0), (2, "a", 2.0)] and rows_of(spark, path, 2) == []
    for _ in range(2):
        buckets.merge_into(new, path, 1, KEYS, order(), SCHEMA, None, 4)
        assert rows_of(spark, path, 2) == [(1, "a", 5.0), (2, "a", 2.0), (3, "c", 3.0)]


def test_an_insert_adds_files_and_reads_keys_of_its_buckets(spark, path, monkeypatch):
    buckets.insert_into(frame(spark, [(k, "a", float(k)) for k in range(200)]), path, 0, KEYS, order(), SCHEMA, ["k"], 8)
    before, seen = files(path), []
    real = buckets._read
    monkeypatch.setattr(buckets, "_read", lambda s, p, parts, schema: seen.append({b for b, _, _ in parts}) or real(s, p, parts, schema))
    incoming = frame(spark, [(5, "a", 99.0), (900, "a", 1.0), (900, "a", 2.0), (None, "a", 3.0)])
    buckets.insert_into(incoming, path, 1, KEYS, order(), SCHEMA, ["k"], 8)
    assert len(seen[0]) <= 3 and all(files(path)[f] == t for f, t in before.items())
    want = [(k, "a", float(k)) for k in range(200)] + [(900, "a", 2.0), (None, "a", 3.0)]
    assert rows_of(spark, path, 2) == sorted(want, key=str)
    assert buckets.insert_into(incoming, path, 2, KEYS, order(), SCHEMA, ["k"], 8) == [] and rows_of(spark, path, 3) == rows_of(spark, path, 2)


def test_a_large_bucket_is_written_by_several_tasks(spark, path, monkeypatch):
    monkeypatch.setattr(buckets, "ROWS_PER_FILE", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which puts so few rows in one task
    rows = frame(spark, [(1, str(k), 1.0) for k in range(400)])  # one bucket: all rows share k
    buckets.merge_into(rows, path, 0, KEYS, order(), SCHEMA, ["k"], 8)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = {os.path.basename(f).split("-")[1] for f in files(path)}
    assert len(rows_of(spark, path, 1)) == 400 and len(tasks) > 2 and len(files(path)) >= 8


def test_a_table_that_was_never_written_and_empty_runs(spark, path):
    assert rows_of(spark, path, 0) == []
    assert buckets.merge_into(frame(spark, []), path, 0, KEYS, order(), SCHEMA) == [] and rows_of(spark, path, 1) == []
    assert buckets.insert_into(frame(spark, []), path, 1, KEYS, order(), SCHEMA) == [] and rows_of(spark, path, 2) == []
