"""Memory and passes over the texts that must not grow faster than the tables."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from issue_signals.functions import chunks as C
from issue_signals.functions.text import clean_issue_text
from issue_signals.operators import scoring
from issue_signals.plans import entailment

ATTRIBUTES = "attribute_id int, attribute string, definition string, related_words string"
NAMED = [(1, "cost", "what to pay", "price, fee"), (2, "speed", "how fast it is", "fast")]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored(spark, tmp_path, rows, schema):
    path = str(tmp_path / "stored")
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_a_batch_of_a_model_is_bounded(spark):
    """Before, a worker got 10,000 texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    def counting():
        return lambda texts: [np.array([float(len(texts))]) for _ in texts]

    rows = spark.range(3000, numPartitions=1).select(F.col("id").cast("string").alias("text"))
    assert scoring.embed(rows, "text", counting).agg(F.max(F.col("vector")[0])).first()[0] <= 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    C.packer([8])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    C.line_chunker(8)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "20"
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_words_are_those_of_the_cleaning_expression(spark):
    texts = ["A b-C  d9e", "", " \n", "\u212a\u0130 na\u00efve x\U0001f600Y", "it's 100% Fine."]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", clean_issue_text("text").alias("clean"))
    assert [scoring.clean_words(r.text) for r in df.collect()] == [r.clean.encode().split() for r in df.collect()]


def test_labelling_reads_the_corpus_once(spark, tmp_path):
    corpus = stored(spark, tmp_path, [(1, 7, "the price is fast"), (2, 7, "none"), (3, 7, None), (4, 7, "fee")], "issue_id long, project_id long, clean_issue_text string")
    rows = entailment.label_corpus(corpus, spark.createDataFrame(NAMED, ATTRIBUTES))
    assert sorted((r.issue_id, r.attribute_id) for r in rows.collect()) == [(1, 1), (1, 2), (4, 1)]
    assert plan_of(rows).count("clean_issue_text") and plan_of(rows).count("Relation [") == 1


def test_grid_joins_texts_with_their_labels_once(spark, tmp_path):
    texts = stored(spark, tmp_path, [(1, "a price. a fee"), (2, "fast")], "issue_id long, clean_issue_text string")
    truth = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (2, 2, 1.0), (3, 1, 1.0)], "issue_id long, attribute_id int, is_related double")
    scores = entailment.score_grid(texts, truth, spark.createDataFrame(NAMED, ATTRIBUTES), limits=[8])
    assert Counter((r.issue_id, r.attribute_id) for r in scores.collect()) == {(1, 1): 3, (1, 2): 3, (2, 2): 3}
    assert plan_of(scores).count("issue_id") and sum("Join" in line and "issue_id" in line for line in plan_of(scores).split("\n")) == 1
