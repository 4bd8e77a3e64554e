import random
import sys
from collections import Counter, defaultdict

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from issue_signals.operators import scoring
from issue_signals.plans import corpus, entailment, matches, mentions, reports, voting

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ISSUES = "issue_id long, project_id long, title string, body_text string, owner_type string, number int, state string, comments int, created_at timestamp"


def issue_frame(spark, texts):
    rows = [(i, i % 2, "t", text, "User", i, "open", 0, None) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, ISSUES)


def comment_frame(spark, rows=()):
    return spark.createDataFrame(list(rows), "issue_id long, id long, body_text string")


def word_frame(spark):
    rows = [(0, "cost", "price", 0.9), (1, "speed", "fast", 0.8), (2, "cost", "fast", 0.5)]
    return spark.createDataFrame(rows, "word_no long, criteria string, similar_word string, max_w2v_score double")


def attribute_frame(spark):
    rows = [(1, "cost", "price of it", "price, fee"), (2, "speed", None, "['fast']")]
    return spark.createDataFrame(rows, "attribute_id int, attribute string, definition string, related_words string")


def letters():
    """A model of two dimensions: how many a and b a text has."""
    return lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]


def only_good():
    def classify(texts):
        if any("boom" in t for t in texts):
            raise ValueError("no answer")
        return [("POSITIVE" if "good" in t else "NEGATIVE", 0.8) for t in texts]

    return classify


def texts(n=40):
    random.seed(5)
    return [" ".join(random.choice(["price", "fast", "good", "bad", "aaa", "bbb"]) for _ in range(random.randint(1, 6))) for _ in range(n)]


def test_mentions_do_not_depend_on_partitions_and_give_copies_the_same(spark):
    issues = issue_frame(spark, texts() + ["good price here"] * 4)
    first = mentions.criteria_mentions(issues, comment_frame(spark), word_frame(spark))
    again = mentions.criteria_mentions(issues.repartition(7), comment_frame(spark), word_frame(spark))
    key = ("issue_id", "criteria", "semantic")
    assert Counter(tuple(r[k] for k in key) for r in first.collect()) == Counter(tuple(r[k] for k in key) for r in again.collect())
    per_issue = defaultdict(set)
    for r in first.filter("issue_id >= 40").collect():
        per_issue[r.issue_id].add((r.criteria, r.semantic, round(r.similarity_score, 9)))
    assert len(per_issue) == 4 and len(set(map(frozenset, per_issue.values()))) == 1


def test_mentions_with_callers_models(spark):
    issues = issue_frame(spark, ["good aaab", "bad aaab", "good bbb"])
    words = spark.createDataFrame([(0, "first", "a", 1.0), (1, "second", "b", 0.5)], "word_no long, criteria string, similar_word string, max_w2v_score double")
    found = mentions.criteria_mentions(issues, comment_frame(spark), words, 0.05, letters, only_good)
    signs = {(r.issue_id, r.criteria): r.semantic for r in found.collect()}
    assert signs[0, "first"] == "+" and signs[1, "first"] == "-" and signs[2, "second"] == "+"


def test_sentiment_failure_keeps_the_row(spark):
    df = spark.createDataFrame([(1, "good"), (2, "boom"), (3, " ")], "i int, text string")
    rows = {r.i: r for r in scoring.sentiment(df, "text", only_good).collect()}
    assert (rows[1].sentiment, rows[1].confidence, rows[1].sentiment_error) == ("+", 0.8, None)
    assert rows[2].sentiment is None and rows[2].sentiment_error == "no answer"
    assert rows[3].sentiment == "-"


def test_embed_default_and_null(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, None), (3, "")], "i int, text string")
    rows = {r.i: r.vector for r in scoring.embed(df, dim=16).collect()}
    assert sum(v * v for v in rows[1]) == pytest.approx(1) and rows[2] is None and rows[3] == [0.0] * 16


def test_matches(spark):
    issues = issue_frame(spark, ["price of it", "zzz", "price good"])
    found = matches.matched_attributes(issues, comment_frame(spark), attribute_frame(spark), 0.5)
    rows = {(r.issue_id, r.attribute): (r.sentiment, r.similarity_score) for r in found.collect()}
    assert rows[0, "cost"] == ("0", 0.866) and rows[2, "cost"][0] == "+" and (1, "cost") not in rows


def test_each_matching_definition_is_a_row(spark):
    issues = issue_frame(spark, ["price of it"])
    twice = spark.createDataFrame([("cost", "price of it"), ("cost", "it of price"), ("cost", None)], "attribute string, definition string")
    found = matches.matched_attributes(issues, comment_frame(spark), twice, 0.5)
    assert [r.attribute for r in found.collect()] == ["cost", "cost"]


def test_models_see_whole_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def classify(texts):
            calls.add(1)
            if any("boom" in t for t in texts):
                raise ValueError("no answer")
            return [("POSITIVE", 0.5) for _ in texts]

        return classify

    df = spark.createDataFrame([(i, "boom" if i == 37 else f"text {i}") for i in range(64)], "i int, text string").coalesce(1)
    rows = {r.i: r for r in scoring.sentiment(df, "text", counting).collect()}
    assert [i for i, r in rows.items() if r.sentiment is None] == [37] and calls.value <= 2 * 6 + 1


def test_new_corpus_rows(spark):
    issues = issue_frame(spark, ["a", "b", "c"])
    have = spark.createDataFrame([(1,)], "issue_id long")
    rows = corpus.new_corpus_rows(issues, comment_frame(spark, [(2, 1, "x"), (0, 2, "y")]), have)
    assert [(r.issue_id, r.issue_text) for r in rows.collect()] == [(2, "t\n\nc\n\nx")]


def corpus_frame(spark, rows):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(rows)], "issue_id long, project_id long, clean_issue_text string")


def test_label_corpus_scores_only_keyword_hits(spark):
    seen = corpus_frame(spark, ["the price is high", "nothing", "very fast"])

    def always(score):
        return lambda: lambda pairs: [score for _ in pairs]

    rows = entailment.label_corpus(seen, attribute_frame(spark), always(0.95)).collect()
    assert sorted((r.issue_id, r.attribute_id, r.nli_label, r.nli_json) for r in rows) == [
        (0, 1, "maybe-relevant", '{"label":"maybe-relevant","score":0.95}'), (2, 2, "maybe-relevant", '{"label":"maybe-relevant","score":0.95}'),
    ]
    low = entailment.label_corpus(seen, attribute_frame(spark), always(0.69)).first()
    assert low.nli_label == "maybe-not-relevant"


def test_grid_scores_each_pair_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting():
        def score(pairs):
            calls.add(len(pairs))
            return [1.0 if "price" in chunk else 0.0 for chunk, _ in pairs]

        return score

    seen = corpus_frame(spark, ["the price", "the price", "a fee"])
    truth = spark.createDataFrame([(0, 1, 1.0), (1, 1, 1.0), (2, 1, 0.0)], "issue_id long, attribute_id int, is_related double")
    scores = entailment.score_grid(seen, truth, attribute_frame(spark), factory=counting, limits=[128, 256])
    measured = entailment.evaluate_grid(scores).collect()
    assert len(measured) == 7 * 3 * 3 * 2 * 2 and all(r.f1_score == 1.0 for r in measured)
    assert calls.value == 2 * 20


def test_default_entailment_score(spark):
    df = spark.createDataFrame([("a b c", ["a x", "b c", "q"]), (None, ["a", "b", "c"])], "chunk string, hypotheses array<string>")
    assert [r.scores for r in scoring.entailment_scores(df).collect()] == [[0.5, 1.0, 0.0], [0.0, 0.0, 0.0]]


def test_votes_end_to_end(spark):
    seen = corpus_frame(spark, [" ".join(["w"] * 300) + " price", "none", ""])
    truth = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.0), (2, 1, 0.0)], "issue_id long, attribute_id int, is_related double")
    prompts = voting.prompt_chunks(seen, truth, attribute_frame(spark), model_limit=256)
    assert prompts.filter("issue_id = 0 AND version = 'v0'").count() > 1
    rows = voting.evaluate_votes(voting.vote_predictions(prompts)).collect()
    assert len(rows) == 7 * 4 and all(r.f1_score == 1.0 and r.specificity == 1.0 for r in rows)

    def shy():
        return lambda prompts: [" Yes\n" if "price\nIs this" in p else "no" for p in prompts]

    assert {r.f1_score for r in voting.evaluate_votes(voting.vote_predictions(prompts, shy)).collect()} == {1.0}


def test_settings_cover_the_grid(spark):
    rows = entailment.settings(attribute_frame(spark), ["m", "n"], threshold_names=["a", "b", "c"])
    assert rows.count() == 2 * 108 * 7 and rows.distinct().count() == 2 * 108 * 7


def test_reports(spark):
    rows = [(1, "a", s, float(i), i, f"ctx{i}") for i, s in enumerate("++-+")]
    found = spark.createDataFrame(rows, "project_id long, criteria string, semantic string, similarity_score double, issue_id long, context string")
    report = reports.criteria_report(found, 2).first()
    assert (report.mentions, report.positive_share, report.examples) == (4, 0.75, ["ctx3", "ctx2"])
    charts = reports.chart_tables(found)
    assert set(charts) == {"top_criteria", "sentiment", "scores", "top_projects"} and charts["scores"].count() == 20
    dated = found.withColumn("created_at", F.timestamp_seconds(F.col("issue_id") * 86400))
    daily = reports.daily_mentions(dated.unionByName(dated))
    assert daily.count() == 4 and reports.alerts(daily, 1).count() == 4 and reports.alerts(daily, 2).isEmpty()


def test_neighbours_and_synonyms(spark):
    df = spark.createDataFrame([("the fast car runs",), ("the quick car runs",), ("a slow boat",)], "text string")
    tokens = reports.content_words(df, ["the", "a"])
    assert tokens.first().tokens == ["fast", "car", "runs"]
    neighbours = reports.neighbour_counts(tokens)
    assert {(r.word, r.neighbour): r.n for r in neighbours.collect()}["car", "runs"] == 2
    criteria = spark.createDataFrame([("fast",)], "criteria string")
    best = reports.synonyms(neighbours, criteria, 1).first()
    assert (best.similar_word, best.max_w2v_score) == ("quick", 1.0)


def test_weighted_compound(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "none"), (3, None)], "i int, text string")
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -2.0)], "word string, weight double")
    assert {r.i: r.compound for r in scoring.weighted_compound(df, lexicon, "text", ["i"]).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}
    df = spark.createDataFrame([(1, "good good bad good bad good")], "i int, text string")
    assert scoring.weighted_compound(df, lexicon, "text", ["i"]).first().compound == 0.0
