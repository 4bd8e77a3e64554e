"""Votes are asked for where a measure is missing, and nowhere else."""

from pyspark.sql import functions as F

from issue_signals.operators import evaluate
from issue_signals.plans import runs, voting
from issue_signals.sources import buckets, schemas

ATTRIBUTES = "attribute_id int, attribute string, definition string, related_words string"
NAMED = [(1, "cost", "what to pay", "price, fee"), (2, "speed", "how fast it is", "fast")]


def test_votes_that_are_done_read_no_text(spark, tmp_path):
    """Before, the texts' windows were made and joined with the missing groups to find that none was missing."""
    at = str(tmp_path / "runs")
    truth = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.0)], "issue_id long, attribute_id int, is_related double")
    texts = spark.createDataFrame([(0, "price"), (1, "none")], "issue_id long, clean_issue_text string")
    attributes = spark.createDataFrame(NAMED[:1], ATTRIBUTES)
    runs.run_votes(texts, truth, attributes, at, 0)
    once = sorted(map(str, buckets.read_buckets(spark, f"{at}/metrics", 1, schemas.METRICS).collect()))
    broken = texts.withColumn("clean_issue_text", F.raise_error(F.lit("a text was read")).cast("string"))
    runs.run_votes(broken, truth, attributes, at, 1)
    assert sorted(map(str, buckets.read_buckets(spark, f"{at}/metrics", 2, schemas.METRICS).collect())) == once and len(once) == 7 * 4


def test_only_some_versions_are_asked_for(spark):
    truth = spark.createDataFrame([(0, 1, 1.0)], "issue_id long, attribute_id int, is_related double")
    texts = spark.createDataFrame([(0, "price")], "issue_id long, clean_issue_text string")
    only = spark.createDataFrame([(1, "v1"), (1, "v3")], "attribute_id int, version string")
    rows = voting.prompt_chunks(texts, truth, spark.createDataFrame(NAMED, ATTRIBUTES), only=only).collect()
    assert sorted(r.version for r in rows) == ["v1", "v3"]
    assert evaluate.with_labels(texts, truth).first().labels[0].attribute_id == 1
