"""Landing by the state of met keys: the stored table is not read, and the first arrival wins."""

import json
import os
import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from issue_signals.sources import landing, schemas
from issue_signals.streaming import ingest


def landed(path, number, rows):
    """One file of rows, some seconds younger than those before it."""
    path.mkdir(exist_ok=True)
    file = path / f"{number}.json"
    file.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(file, (time.time() + 10 * number - 1000,) * 2)


def start(spark, source, table, mark):
    raw = ingest.raw_stream(spark, str(source), schemas.RAW_ISSUES)
    query = ingest.land_stream(raw, landing.issue_rows, str(table), schemas.ISSUES, "issue_id", str(mark))
    query.awaitTermination()
    return query


def titles(spark, table):
    return sorted((r.issue_id if r.issue_id is not None else -1, r.title) for r in landing.read_table(spark, str(table), schemas.ISSUES).collect())


def test_history_is_not_read_again(spark, tmp_path, monkeypatch):
    source, table, mark = tmp_path / "in", tmp_path / "issues", tmp_path / "mark"
    reads = []
    real = ingest.read_table
    monkeypatch.setattr(ingest, "read_table", lambda session, path, *more: reads.append(path) or real(session, path, *more))
    states = []
    for number in range(4):
        new = [{"id": number * 100 + k, "title": f"t{number}"} for k in range(100)]
        old = [{"id": k, "title": "late"} for k in range(number * 100)]
        landed(source, number, new + old)
        query = start(spark, source, table, mark)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert reads == [str(table)]  # once, at the first start, for ids of other writers: there were none
    assert states == [100, 200, 300, 400]
    assert titles(spark, table) == [(k, f"t{k // 100}") for k in range(400)]
    written = [r.run_id for r in spark.read.parquet(str(table)).groupBy("run_id").count().orderBy("run_id").collect()]
    assert written == [f"batch-{k}" for k in range(4)]


def test_the_first_of_many_arrivals_wins(spark, tmp_path):
    source, table = tmp_path / "in", tmp_path / "issues"
    landed(source, 2, [{"id": 5, "title": "second"}] * 300 + [{"id": 6, "title": "only"}, {"title": "no id"}])
    landed(source, 1, [{"id": 5, "title": "first"}] * 300)
    start(spark, source, table, tmp_path / "mark")
    landed(source, 3, [{"id": 5, "title": "third"}, {"title": "no id again"}])
    start(spark, source, table, tmp_path / "mark")
    assert titles(spark, table) == [(-1, "no id"), (5, "first"), (6, "only")]


def test_ids_of_an_older_table_are_adopted(spark, tmp_path):
    source, table, mark = tmp_path / "in", tmp_path / "issues", tmp_path / "mark"
    older = spark.createDataFrame([(1, "old"), (2, "old")], "issue_id long, title string")
    ingest.append_run(older, str(table), schemas.ISSUES, "by-hand")
    landed(source, 1, [{"id": 1, "title": "new"}, {"id": 3, "title": "new"}])
    start(spark, source, table, mark)
    landed(source, 2, [{"id": k, "title": "late"} for k in (1, 2, 3, 4)])
    start(spark, source, table, mark)
    assert titles(spark, table) == [(1, "old"), (2, "old"), (3, "new"), (4, "late")]


def test_rows_come_back_as_they_were(spark, tmp_path):
    kinds = T._parse_datatype_string(
        "id string, landed_at timestamp, n decimal(20,3), at timestamp, day date, flag boolean, x double, list array<struct<a:int,b:string>>, m struct<c:binary,d:array<long>>, big long"
    )
    rows = spark.range(6).select(
        F.when(F.col("id") != 3, F.concat(F.lit("k\n\"ü"), "id")).alias("id"), F.timestamp_micros(F.col("id") + 1_700_000_000_000_001).alias("landed_at"),
        F.lit("12345678901234567.125").cast("decimal(20,3)").alias("n"), F.timestamp_micros(F.col("id") + 1_600_000_000_123_456).alias("at"), F.lit("1960-02-29").cast("date").alias("day"),
        F.when(F.col("id") > 2, True).alias("flag"), F.when(F.col("id") == 1, F.lit(float("nan"))).otherwise(F.lit(0.1)).alias("x"),
        F.when(F.col("id") < 4, F.array(F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b")))).alias("list"),
        F.when(F.col("id") < 5, F.struct(F.lit(b"\x00\xff").alias("c"), F.array(F.lit(None).cast("long"), F.lit(2**62)).alias("d"))).alias("m"), F.lit(2**60 + 1).alias("big"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.first_arrivals(spark.readStream.schema(kinds).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start().awaitTermination()
    one, two = (sorted(map(str, df.select(*rows.columns).collect())) for df in (spark.read.schema(kinds).parquet(str(tmp_path / "in")), spark.table("arrived")))
    assert one == two and len(one) == 6


def test_large_ids_beside_a_missing_one_stay_apart(spark, tmp_path):
    """Before, ids were doubles beside a NULL, and a call of Python was made for each key of a batch."""
    source, table = tmp_path / "in", tmp_path / "issues"
    ids = [2**60 + k for k in range(40)]
    landed(source, 1, [{"title": "none"}, *({"id": k, "title": "first"} for k in ids)])
    query = start(spark, source, table, tmp_path / "mark")
    assert titles(spark, table) == [(-1, "none"), *((k, "first") for k in ids)]
    assert query.lastProgress["stateOperators"][0]["operatorName"] == "dedupe"  # Spark's own, no state in Python
