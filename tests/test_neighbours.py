"""Neighbour counts made in one pass over the texts."""

from collections import Counter

from issue_signals.plans import reports

TEXTS = ["The cat, the cat cat SAT.", None, "", "mat", "sat on a mat", "cat sat; on naïve mat", "on on on"] * 3
STOPS = ["the", "a"]


def test_pairs_are_those_of_the_content_words(spark, monkeypatch):
    """Whatever the number of words counted at once; a pair is sent once and not once for each of its words."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    want = Counter()
    for row in reports.content_words(df, STOPS).collect():
        for a, b in zip(row.tokens or (), (row.tokens or ())[1:]):
            want[a, b] += 1
            want[b, a] += 1
    for at_once in (1, 5, 1 << 20):
        monkeypatch.setattr(reports, "PAIR_WORDS", at_once)
        got = {(r.word, r.neighbour): r.n for r in reports.text_neighbours(df, STOPS).collect()}
        assert got == want and want["cat", "cat"] == 12
    assert {(r.word, r.neighbour): r.n for r in reports.neighbour_counts(reports.content_words(df, STOPS)).collect()} == want
    assert reports.text_neighbours(df.limit(0), STOPS).count() == 0
