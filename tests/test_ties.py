"""Similarities that lie exactly on the threshold or halfway between two scores."""

from pyspark.sql import functions as F

from issue_signals.operators import similarity


def test_a_tie_does_not_depend_on_the_order_of_a_sum(spark, monkeypatch):
    """0.3 and 0.40625 as sums of products come out, by the order in which they are summed."""
    sums = [(1, 0.29999999999999993), (2, 0.3), (3, 0.30000000000000004), (4, 0.40624999999999994), (5, 0.40625), (6, 0.2999999)]
    rows = spark.createDataFrame([(k, 0, s) for k, s in sums], "issue_id long, word_no long, similarity double")
    monkeypatch.setattr(similarity, "similar_words", lambda texts, words, threshold, *more: rows.filter(F.col("similarity") >= threshold))
    words = spark.createDataFrame([(0, "cost")], "word_no long, attribute string")
    found = similarity.attribute_matches(rows, words, 0.3, keep=("issue_id",)).collect()
    assert sorted((r.issue_id, r.similarity_score) for r in found) == [(1, 0.3), (2, 0.3), (3, 0.3), (4, 0.4063), (5, 0.4063)]
