"""A catalogue in which many words have the same vector."""

import numpy as np
from pyspark.sql import functions as F

from issue_signals.operators import large_catalogue as large
from issue_signals.operators import similarity
from issue_signals.operators.scoring import embed


def test_equal_vectors_are_one_entry(spark, monkeypatch):
    """Before, every word was compared with every text and each pair left its task."""
    rng = np.random.default_rng(3)
    some = rng.normal(size=(20, 6))
    words = [(k, some[k % 20].tolist()) for k in range(2000)]
    texts = [(k, (some[k % 20] + rng.normal(size=6) * 0.2).tolist()) for k in range(50)] + [(50, None), (51, [0.0] * 6)]
    wdf, tdf = spark.createDataFrame(words, "word_no long, vector array<double>"), spark.createDataFrame(texts, "doc_id long, vector array<double>")
    seen, real = [], large.prepared
    monkeypatch.setattr(large, "prepared", lambda *a, **k: seen.append(r := real(*a, **k)) or r)
    got = {r.doc_id: r for r in similarity.similar_totals(tdf, wdf, 0.4, keep=("doc_id",), max_words=100).collect()}
    assert seen[0].words.count() == 20
    want = similarity.similar_words(tdf, wdf, 0.4, keep=("doc_id",)).groupBy("doc_id").agg(F.count("*"), F.max("similarity"), F.sum("similarity")).collect()
    assert set(got) == {r[0] for r in want} and len(want) == 50
    for doc, n, best, total in want:
        assert got[doc].words == n and abs(got[doc].best - best) < 1e-9 and abs(got[doc].total - total) < 1e-6
    held = {r.doc_id: r.words for r in similarity.similar_totals(tdf, wdf, 0.4, keep=("doc_id",)).collect()}
    assert held == {d: r.words for d, r in got.items()}


def test_a_filter_on_vectors_does_not_embed_what_distinct_drops(spark):
    """Before, the filter went below the distinct, and every occurrence of a word was embedded."""
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def encode(texts):
            calls.add(len(texts))
            return [np.ones(2) for _ in texts]

        return encode

    words = spark.range(600).select((F.col("id") % 3).cast("string").alias("word")).distinct()
    assert embed(words, "word", counting).filter("vector IS NOT NULL").count() == 3
    assert calls.value == 3
