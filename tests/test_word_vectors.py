"""Trained word vectors: planted synonyms, and the singular vectors of a whole matrix."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from checks.queries import QUERIES
from issue_signals.operators import word_vectors as wv
from issue_signals.plans.reports import neighbour_counts


def planted(pairs=30, seed=6):
    """Sentences in which the two words of a pair stand among the same neighbours."""
    r = random.Random(seed)
    around = {k: [f"ctx{k}_{j}" for j in range(6)] for k in range(pairs)}
    rows = []
    for _ in range(4000):
        k = r.randrange(pairs)
        words = [r.choice(around[k]), r.choice([f"left{k}", f"right{k}"]), r.choice(around[k])]
        rows.append(([f"noise{r.randrange(40)}", *words, f"noise{r.randrange(40)}"],))
    return rows


def exact_vectors(rows, dim, min_count):
    counts = Counter()
    for (words,) in rows:
        for a, b in zip(words, words[1:]):
            counts[a, b] += 1
            counts[b, a] += 1
    sums = Counter()
    for (a, _), n in counts.items():
        sums[a] += n
    names = sorted(w for w in sums if sums[w] >= min_count)
    place = {w: k for k, w in enumerate(names)}
    counts = {p: n for p, n in counts.items() if p[0] in place and p[1] in place}
    total = sum(counts.values())
    matrix = np.zeros((len(names), len(names)))
    for (a, b), n in counts.items():
        matrix[place[a], place[b]] = max(0.0, np.log(n * total / (sums[a] * sums[b])))
    u, s, _ = np.linalg.svd(matrix)
    return names, u[:, :dim] * np.sqrt(s[:dim])


def test_planted_synonyms_are_found(spark):
    vectors = wv.word_vectors(neighbour_counts(spark.createDataFrame(planted(), "tokens array<string>")))
    criteria = spark.createDataFrame([(f"left{k}",) for k in range(30)] + [("absent",)], "criteria string")
    found = {r.criteria: r.similar_word for r in wv.trained_synonyms(vectors, criteria, 1).collect()}
    assert "absent" not in found and sum(found.get(f"left{k}") == f"right{k}" for k in range(30)) >= 27


def test_vectors_are_the_leading_singular_vectors(spark):
    rows = planted(6)
    names, want = exact_vectors(rows, 6, 20)
    got = {r.word: r.vector for r in wv.word_vectors(neighbour_counts(spark.createDataFrame(rows, "tokens array<string>")), 6, 10, 12, 20).collect()}
    assert sorted(got) == names and len(names) > 50
    own = np.array([got[w] for w in names])
    assert np.abs(own @ own.T - want @ want.T).max() < 0.02 * np.abs(want @ want.T).max()  # signs of the axes are free


def test_runs_agree_and_an_empty_corpus_has_no_vectors(spark):
    neighbours = neighbour_counts(spark.createDataFrame(planted(5), "tokens array<string>"))
    one, two = ({r.word: np.round(r.vector, 6).tolist() for r in wv.word_vectors(n, 4, 4, 2).select("word", F.transform("vector", F.abs).alias("vector")).collect()} for n in (neighbours, neighbours.repartition(7)))
    assert one == two
    assert wv.word_vectors(neighbours.limit(0), 4, 4, 1).count() == 0


def test_query_ranks_words_of_the_corpus(spark):
    rows = QUERIES["q_trained_synonyms"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.criteria != r.similar_word and 0 < r.max_w2v_score <= 1 for r in rows)
    assert max(Counter(r.criteria for r in rows).values()) <= 10


def test_vectors_do_not_depend_on_the_number_of_frequent_words(spark, monkeypatch):
    """None or few of the words as frequent ones: pairs of two rare words count too."""
    rows = planted(6)
    names, want = exact_vectors(rows, 6, 20)
    for hubs in (0, 25):
        monkeypatch.setattr(wv, "HUBS", hubs)
        monkeypatch.setattr(wv, "STEP", 7 if hubs == 25 else 1 << 15)
        got = {r.word: r.vector for r in wv.word_vectors(neighbour_counts(spark.createDataFrame(rows, "tokens array<string>")), 6, 10, 12, 20).collect()}
        assert sorted(got) == names
        own = np.array([got[w] for w in names])
        assert np.abs(own @ own.T - want @ want.T).max() < 0.02 * np.abs(want @ want.T).max(), hubs


def test_a_product_sends_rows_of_words_and_not_of_pairs(spark, monkeypatch):
    """What is summed after the shuffle: a row of a frequent word, and one for each task with rare neighbours of it."""
    sent = []

    def spy(sums, count, width, rows=wv._hub_rows):
        sent.append(sums.count())
        return rows(sums, count, width)

    monkeypatch.setattr(wv, "HUBS", 60)
    monkeypatch.setattr(wv, "_hub_rows", spy)
    neighbours = neighbour_counts(spark.createDataFrame(planted(6), "tokens array<string>"))
    words = wv.word_vectors(neighbours, 4, 4, 1, 5).count()
    assert len(sent) == 3 and max(sent) <= 60 * (1 + 4) < neighbours.count() and words > 60
