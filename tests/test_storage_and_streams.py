import json

import pytest
from pyspark.sql import functions as F

from issue_signals import session
from issue_signals.operators.progress import above_tracker
from issue_signals.sources import landing, schemas, sinks
from issue_signals.streaming import ingest


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


RAW = {
    "id": 7, "url": "u/7", "project_id": 1, "repository_id": 2, "number": 3, "title": "t", "state": "open", "locked": False,
    "user": {"login": "ann", "type": "User", "id": 5, "extra": 1}, "labels": [{"name": "bug", "color": "f00"}],
    "comments": 1, "created_at": "2020-01-01T00:00:00Z", "reactions": {"+1": 2}, "body_text": "b",
}


def test_issue_json_to_rows(spark, tmp_path):
    bare = {"id": 8, "project_id": 1, "user": None}
    lines(tmp_path / "in" / "a.json", [RAW, bare])
    rows = {r.issue_id: r for r in landing.issue_rows(landing.read_raw_issues(spark, str(tmp_path / "in"))).collect()}
    assert list(rows[7].asDict()) == schemas.ISSUES.names and len(schemas.ISSUES.names) == 24
    assert (rows[7].owner, rows[7].owner_type, rows[7].owner_id) == ("ann", "User", 5)
    assert json.loads(rows[7].labels) == RAW["labels"] and json.loads(rows[7].reactions) == RAW["reactions"]
    assert rows[7].created_at.isoformat() == "2020-01-01T00:00:00" and rows[7].closed_at is None
    assert (rows[8].owner, rows[8].labels, rows[8].reactions) == (None, "[]", "{}")


def test_comment_json_to_rows(spark, tmp_path):
    lines(tmp_path / "in" / "a.json", [{"id": 1, "issue_id": 7, "user": {"login": "bob"}, "body_text": "hi"}])
    row = landing.comment_rows(landing.read_raw_comments(spark, str(tmp_path / "in"))).first()
    assert list(row.asDict()) == schemas.COMMENTS.names and len(schemas.COMMENTS.names) == 11
    assert (row.id, row.issue_id, row.owner, row.body_text) == (1, 7, "bob", "hi")


def test_csv_with_breaks_and_quotes(spark, tmp_path):
    (tmp_path / "gt.csv").write_text(
        '"issue_id","attribute_id","is_related","relevant_contents","label"\n'
        '1,4,1.0,"two\nlines, ""quoted""",maybe-relevant\n2,4,0.0,,not-relevant\n'
    )
    rows = landing.read_csv(spark, str(tmp_path / "gt.csv"), schemas.GROUND_TRUTH).collect()
    assert [tuple(r) for r in rows] == [
        (1, 4, 1.0, 'two\nlines, "quoted"', "maybe-relevant"), (2, 4, 0.0, None, "not-relevant"),
    ]


def test_jdbc_options_name_ranges_and_driver():
    plain = landing.jdbc_options("jdbc:sqlite:/x.db", "issues")
    assert plain["driver"] == "org.sqlite.JDBC" and "partitionColumn" not in plain
    ranged = landing.jdbc_options("jdbc:postgresql://h/db", "issues", "issue_id", 1, 100, 8)
    assert ranged["numPartitions"] == "8" and ranged["partitionColumn"] == "issue_id"


def test_missing_table_reads_as_empty(spark, tmp_path):
    empty = landing.read_table(spark, str(tmp_path / "none"), schemas.TRACKER)
    assert empty.columns == schemas.TRACKER.names and empty.isEmpty()


def test_a_repeated_run_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "issue_id long, similarity_score double")
    sinks.append_run(df, path, schemas.MENTIONS, "a")
    for _ in range(2):
        sinks.append_run(df.withColumn("issue_id", F.col("issue_id") + 10), path, schemas.MENTIONS, "b")
    rows = landing.read_table(spark, path, schemas.MENTIONS).orderBy("issue_id").collect()
    assert [(r.issue_id, r.similarity_score, r.criteria) for r in rows] == [(1, 2.0, None), (2, None, None), (11, 2.0, None), (12, None, None)]


class NamedFolder:
    """A session whose cluster may name the shared folder."""

    def __init__(self, master, named=None):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext, self.master, self.dir = self, master, None

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


def test_shared_dir_is_the_one_the_session_names():
    named = NamedFolder("spark://cluster", "/shared/run")
    assert session.shared_dir(named) == "/shared/run" == named.dir
    for master in ("spark://cluster", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            session.shared_dir(NamedFolder(master))
    alone = NamedFolder("local[2]")
    assert session.shared_dir(alone) == alone.dir


def test_landing_stream_keeps_each_key_once(spark, tmp_path):
    source, table, mark = tmp_path / "in", str(tmp_path / "issues"), str(tmp_path / "mark")

    def run(checkpoint=mark):
        raw = ingest.raw_stream(spark, str(source), schemas.RAW_ISSUES)
        ingest.land_stream(raw, landing.issue_rows, table, schemas.ISSUES, "issue_id", checkpoint).awaitTermination()
        rows = landing.read_table(spark, table, schemas.ISSUES, ["issue_id", "title"]).orderBy("issue_id").collect()
        return [tuple(r) for r in rows]

    lines(source / "a.json", [RAW, RAW | {"id": 8}])
    assert run() == [(7, "t"), (8, "t")]
    lines(source / "b.json", [RAW | {"title": "late"}, RAW | {"id": 3, "title": "low"}, RAW | {"id": 3, "title": "low"}])
    assert run() == [(3, "low"), (7, "t"), (8, "t")]
    assert run() == [(3, "low"), (7, "t"), (8, "t")]


def copies(batch):
    return batch.select("project_id", F.lit("c").alias("criteria"), F.lit("+").alias("semantic"), F.lit(1.0).alias("similarity_score"), "issue_id")


def test_analysis_stream_equals_batch(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    issues = spark.range(1, 21).select(F.col("id").alias("issue_id"), (F.col("id") % 3).alias("project_id"))
    for part in (issues.filter("issue_id > 10"), issues.filter("issue_id <= 10")):  # low ids come late
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(issues.schema).parquet(source)
        ingest.analyse_stream(stream, copies, table, schemas.MENTIONS, str(tmp_path / "mark")).awaitTermination()
    found = landing.read_table(spark, table, schemas.MENTIONS).select("issue_id").collect()
    assert sorted(r.issue_id for r in found) == list(range(1, 21))


def test_tracked_runs_over_two_halves_equal_one(spark, tmp_path):
    issues = spark.range(1, 21).select(F.col("id").alias("issue_id"), (F.col("id") % 3).alias("project_id"))
    marks, table = [str(tmp_path / f"mark{i}") for i in range(4)], str(tmp_path / "out")
    for i, seen in enumerate((issues.filter("issue_id <= 10"), issues, issues)):
        ingest.analyse_above_tracker(seen, marks[i], marks[i + 1], copies, table, schemas.MENTIONS, f"r{i}")
    found = landing.read_table(spark, table, schemas.MENTIONS).select("issue_id").collect()
    assert sorted(r.issue_id for r in found) == list(range(1, 21))
    tracker = landing.read_table(spark, marks[3], schemas.TRACKER)
    assert above_tracker(issues, tracker).isEmpty()


def test_alert_stream(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("criteria string, created_at timestamp").parquet(source)
        ingest.alert_stream(stream, 2, "1 day", table, str(tmp_path / "mark")).awaitTermination()

    days = [("a", 1)] * 3 + [("b", 1)] * 2 + [("a", 2)] * 3 + [("a", 9)]
    rows = spark.createDataFrame(days, "criteria string, d int")
    rows.select("criteria", F.make_timestamp(F.lit(2024), F.lit(1), F.col("d"), F.lit(5), F.lit(0), F.lit(0)).alias("created_at")).write.parquet(source)
    run()
    found = spark.read.parquet(table).collect()
    assert sorted((r.day.day, r.criteria, r.mentions) for r in found) == [(1, "a", 3), (2, "a", 3)]
