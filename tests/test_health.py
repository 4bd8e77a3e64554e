"""Criteria health: partials that runs add to, gaps, periods, late mentions."""

import os
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import types as T

from issue_signals.plans import health
from issue_signals.sources import buckets
from issue_signals.streaming import ingest

MENTIONS = T.StructType(
    [T.StructField("criteria", T.StringType()), T.StructField("created_at", T.TimestampType()), T.StructField("semantic", T.StringType()),
     T.StructField("similarity_score", T.DoubleType())]
)


def mention(criteria, day, score=0.5, semantic="+"):
    return (criteria, None if day is None else datetime(2024, 1, 1) + timedelta(days=day, hours=5), semantic, score)


def frame(spark, rows):
    return spark.createDataFrame(rows, MENTIONS)


def table(spark, path, run):
    return {(r.day, r.criteria): tuple(r)[2:] for r in buckets.read_buckets(spark, path, run, health.HEALTH).collect()}


def files(path):
    found = [os.path.join(d, f) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")]
    return {f: os.stat(f).st_mtime_ns for f in found}


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "health")


def test_a_late_mention_changes_only_its_day(spark, path):
    first = [mention(c, d) for d in range(40) for c in ("license", "usability")]
    health.add_mentions(frame(spark, first), path, 0, 16)
    before, old = files(path), table(spark, path, 1)
    written = health.add_mentions(frame(spark, [mention("license", 3, 0.25, "-")]), path, 1, 16)
    own = spark.createDataFrame([(date(2024, 1, 4),)], "day date").select(buckets.bucket_of(["day"], 16)).first()[0]
    after = files(path)
    assert written == [own] and all(after[f] == t for f, t in before.items())
    assert {os.path.basename(os.path.dirname(f)) for f in after.keys() - before.keys()} == {f"bucket={own}"}
    new = table(spark, path, 2)
    assert {k for k in new if new[k] != old.get(k)} == {(date(2024, 1, 4), "license")}
    assert [float(x) for x in new[date(2024, 1, 4), "license"]] == [2, 1, 2, 0.75]


def test_a_repeated_run_adds_once(spark, path):
    rows = frame(spark, [mention("license", d % 5, d / 8) for d in range(30)])
    health.add_mentions(rows, path, 0, 4)
    once = table(spark, path, 1)
    health.add_mentions(rows, path, 0, 4)
    assert table(spark, path, 1) == once
    health.add_mentions(frame(spark, []), path, 1, 4)
    assert table(spark, path, 2) == once


def test_nulls_and_scores_that_are_no_numbers(spark, path):
    odd = [mention(None, 1), mention("license", None), mention("license", 1, float("nan")), mention("license", 1, None, None), mention("license", 1, float("inf"))]
    health.add_mentions(frame(spark, odd), path, 0, 4)
    health.add_mentions(frame(spark, odd), path, 1, 4)
    rows = table(spark, path, 2)
    assert [float(x) for x in rows[date(2024, 1, 2), None]] == [2, 2, 2, 1.0]
    assert [float(x) for x in rows[date(2024, 1, 2), "license"]] == [6, 4, 0, 0]
    report = health.criteria_health(buckets.read_buckets(spark, path, 2, health.HEALTH), 7).collect()
    assert sorted((str(r.criteria), r.mentions, r.mean_score) for r in report) == [("None", 2, 0.5), ("license", 6, None)]
    assert health.criteria_health(buckets.read_buckets(spark, path, 0, health.HEALTH)).count() == 0


def test_report_against_a_plain_version(spark, path):
    rows = [mention(c, d, (d % 7) / 8, "+" if d % 3 else "-") for c, step in (("license", 2), ("usability", 9), ("late", 25)) for d in range(5, 60, step) for _ in range(d % 4 + 1)]
    for run in range(3):
        health.add_mentions(frame(spark, rows[run::3]), path, run, 8)
    got = {(r.criteria, r.day): r for r in health.criteria_health(buckets.read_buckets(spark, path, 3, health.HEALTH), 7).collect()}
    by_day = defaultdict(list)
    for criteria, at, semantic, score in rows:
        by_day[criteria, at.date()].append((semantic, score))
    days = [date(2024, 1, 6) + timedelta(days=k) for k in range(max(d for _, d in by_day).toordinal() - date(2024, 1, 6).toordinal() + 1)]
    assert len(got) == 3 * len(days)
    for criteria in ("license", "usability", "late"):
        for k, day in enumerate(days):
            own, r = by_day[criteria, day], got[criteria, day]
            recent = [m for d in days[max(0, k - 6) : k + 1] for m in by_day[criteria, d]]
            preceding = [m for d in days[max(0, k - 13) : max(0, k - 6)] for m in by_day[criteria, d]]
            assert (r.mentions, r.recent, r.preceding) == (len(own), len(recent), len(preceding))
            assert r.mean_score == (pytest.approx(sum(s for _, s in own) / len(own)) if own else None)
            assert r.recent_positive_share == (pytest.approx(sum(m == "+" for m, _ in recent) / len(recent)) if recent else None)
            assert r.change == (pytest.approx(len(recent) / len(preceding) - 1) if preceding else None)


def test_a_stream_keeps_the_partials(spark, tmp_path):
    rows = [mention(c, d) for d in range(12) for c in ("license", "usability")]
    for n in range(3):
        frame(spark, rows[n::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MENTIONS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.health_stream(stream, str(tmp_path / "health"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert {k: v[0] for k, v in table(spark, str(tmp_path / "health"), 3).items()} == {(date(2024, 1, 1) + timedelta(days=d), c): 1 for d in range(12) for c in ("license", "usability")}
