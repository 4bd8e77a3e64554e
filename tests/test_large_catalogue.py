"""The similarity join beyond the bounds of a task against all products."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from issue_signals.operators import large_catalogue as large
from issue_signals.operators import similarity

VECTORS = "array<double>"


def tables(spark, seed=4, words=300, texts=200, dim=8):
    """Words and texts around a few directions, with copies, zero vectors and a NULL."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))

    def around(n, spread):
        return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread

    w = np.concatenate([around(words, 0.3), np.zeros((2, dim)), np.repeat(centres[:1], 60, axis=0)])
    t = np.concatenate([around(texts, 0.2), np.zeros((1, dim)), np.repeat(centres[:1], 90, axis=0)])
    word_rows = [(k, f"c{k % 5}", k / 100, v.tolist()) for k, v in enumerate(w)]
    text_rows = [(k // 2, "x", v.tolist()) for k, v in enumerate(t)]  # ids are repeated
    wdf = spark.createDataFrame([*word_rows, (9999, "c0", 1.0, None)], f"word_no long, criteria string, weight double, vector {VECTORS}")
    tdf = spark.createDataFrame([*text_rows, (9999, "x", None)], f"issue_id long, text_row string, vector {VECTORS}").repartition(3)
    return word_rows, text_rows, wdf, tdf, large.unit_rows(t) @ large.unit_rows(w).T


@pytest.mark.parametrize("threshold,inclusive", [(0.9, False), (0.5, True), (0.0, False), (-0.3, True)])
def test_all_pairs_above_the_threshold(spark, monkeypatch, threshold, inclusive):
    monkeypatch.setattr(large, "TASK_TEXTS", 40)
    monkeypatch.setattr(large, "PRODUCT", 500)
    word_rows, text_rows, wdf, tdf, sims = tables(spark)
    got = large.large_similar_words(tdf, wdf, threshold, inclusive, keep=("issue_id", "text_row"), cells=16, shard_bytes=8 * 8 * 40)
    assert got.columns == ["issue_id", "text_row", "word_no", "similarity"]
    want = Counter((text_rows[i][0], "x", word_rows[j][0]) for i, j in zip(*np.nonzero(large.over(sims, threshold, inclusive))))
    rows = got.collect()
    assert Counter((r.issue_id, r.text_row, r.word_no) for r in rows) == want
    assert np.isclose(sum(r.similarity for r in rows), sims[large.over(sims, threshold, inclusive)].sum())


def test_totals_equal_those_of_a_held_catalogue(spark):
    _, _, wdf, tdf, _ = tables(spark)
    wdf = wdf.filter("vector IS NOT NULL")
    one = similarity.mention_scores(tdf, wdf, 0.4).withColumn("score", F.round("score", 9)).collect()
    for bound in ({"max_words": 100}, {"max_bytes": 4_000}):
        other = similarity.mention_scores(tdf, wdf, 0.4, **bound).withColumn("score", F.round("score", 9)).collect()
        assert Counter(one) == Counter(other) and one


def test_texts_go_only_where_they_can_hit(spark):
    _, _, wdf, tdf, _ = tables(spark)
    catalogue = large.prepared(wdf, cells=64, shard_bytes=8 * 8 * 40)
    assert catalogue.words.count() == 362 and catalogue.shard_count >= 9
    sizes = [r["count"] for r in catalogue.words.groupBy("shard").count().collect()]
    assert max(sizes) <= 60 and {r[0] for r in catalogue.words.select("shard").distinct().collect()} <= set(range(catalogue.shard_count))
    vectors = large.unit_rows(np.array([r.vector for r in tdf.filter("vector IS NOT NULL").collect()]))
    assert catalogue.reached(vectors, 0.95).mean() < 0.5 and catalogue.reached(vectors, 0.0).all()


def test_the_driver_sees_no_words(spark, monkeypatch):
    """Beyond the bound of bytes no more rows than the bound are collected, and pivots and counts only."""
    _, _, wdf, tdf, _ = tables(spark)
    seen = []
    frame = type(wdf)
    monkeypatch.setattr(frame, "collect", lambda self, real=frame.collect: seen.append(r := real(self)) or r)
    monkeypatch.setattr(large, "CELLS", 16)
    large.large_similar_words(tdf, wdf, 0.9, cells=16)
    assert seen and max(map(len, seen)) <= 16
    assert similarity.similar_words(tdf, wdf, 0.9, max_bytes=640).count() > 0
    assert max(map(len, seen)) <= 16


def test_empty_sides(spark):
    _, _, wdf, tdf, _ = tables(spark)
    assert large.large_similar_words(tdf.limit(0), wdf, 0.5).count() == 0
    assert large.large_similar_words(tdf, wdf.limit(0), 0.5).count() == 0
    assert large.large_mention_scores(tdf, wdf.limit(0), 0.5).count() == 0
