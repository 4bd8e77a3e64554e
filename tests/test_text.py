import pytest
from pyspark.sql import functions as F

from issue_signals.fixed_values import HYPOTHESIS_TEMPLATES, LABELLING_TEMPLATES
from issue_signals.functions import text as X
from issue_signals.functions.hypotheses import hypotheses, labelling_hypotheses, vote_prompt, word_prompt


@pytest.mark.parametrize(
    "text, valid",
    [
        ("fine", True),
        (" \t\n ", False),
        (None, False),
        ("[UNK]" * 5, True),
        ("[UNK]" * 6, False),
        ("é" * 30 + "a" * 70, True),
        ("é" * 31 + "a" * 69, False),
    ],
)
def test_valid_text(one, text, valid):
    assert one(X.is_valid_text(F.lit(text))) == (valid,)


@pytest.mark.parametrize(
    "text, kind",
    [
        ("A prefix only", "bug_fix"),
        ("Add a new thing and fix it", "bug_fix"),
        ("Implement login", "feature"),
        ("Bump lodash", "dependency"),
        ("Write the manual", "documentation"),
        ("hello", "general"),
    ],
)
def test_content_type_takes_first_in_order(one, text, kind):
    assert one(X.content_type(F.lit(text))) == (kind,)


@pytest.mark.parametrize(
    "text, attribute, relevant",
    [
        ("Improve response time", "response time", True),
        ("Refactor parser", "security", False),
        ("the response was late", "Response time", True),
        ("now or never", "run now", False),
        ("performances", "performance", True),
    ],
)
def test_relevance(one, text, attribute, relevant):
    assert one(X.is_relevant(F.lit(text), F.lit(attribute))) == (relevant,)


@pytest.mark.parametrize(
    "text, sentiment, confidence, expected",
    [
        ("good great fix", "-", 0.89, ("+", 0.70)),
        ("good great fix", "-", 0.90, ("-", 0.90)),
        ("good good good bug", "-", 0.5, ("-", 0.5)),
        ("crash and error, broken", "+", 0.5, ("-", 0.70)),
        ("crash and error, broken", "-", 0.5, ("-", 0.5)),
        ("neutral", "+", 0.5, ("+", 0.5)),
    ],
)
def test_override(one, text, sentiment, confidence, expected):
    final = X.override_sentiment(F.lit(text), F.lit(sentiment), F.lit(confidence))
    assert tuple(one(final)[0]) == expected


def context(one, text, attribute):
    return one(X.meaningful_context(F.lit(text), F.lit(attribute)))[0]


def test_context_ranks_by_polarity_and_keeps_order_of_ties(one):
    text = "Security is here today. Security is good and great. Nothing to see. Security was bad once. Security again as well."
    assert context(one, text, "security") == "Security is good and great. Security was bad once."
    assert context(one, "One security line here. Two security lines here. Three security lines.", "security") == (
        "One security line here. Two security lines here."
    )


def test_context_length_bounds(one):
    exactly = "security " + "x" * 188 + " z."
    assert len(exactly) == 200
    assert context(one, exactly + " Other words here.", "security") == exactly
    longer = "security " + "x" * 189 + " z."
    assert context(one, longer + " Fix the thing now.", "security") == "Fix the thing now."
    typed_199 = "fix it " + "x" * 191 + "."
    typed_200 = "fix it " + "x" * 192 + "."
    assert len(typed_199) == 199
    assert context(one, typed_199, "security") == typed_199
    assert context(one, typed_200, "security") == " ".join(typed_200.split()[:30]) + "..."


def test_context_needs_three_words(one):
    assert context(one, "Security bug. Title nothing", "security") == "Security bug. Title nothing..."


def test_context_title_takes_the_rest_of_the_text(one):
    assert context(one, "TITLE:  short\nname\nmore", "security") == "short name more"
    assert context(one, "title: " + "y" * 200, "security") == "y" * 150 + "..."


def test_context_multi_word_attribute_and_markers(one):
    assert context(one, "[CLS] The response is there. [SEP]", "response time") == "The response is there."
    assert context(one, "", "x") == "Content not available or contains invalid characters"
    assert context(one, "[CLS]", "x") == "..."


def test_context_preview_has_thirty_words(one):
    words = [f"w{i}" for i in range(40)]
    assert context(one, " ".join(words), "security") == " ".join(words[:30]) + "..."


def reason(one, text, attribute, sentiment, confidence):
    return one(X.sentiment_reason(F.lit(text), F.lit(attribute), F.lit(sentiment), F.lit(confidence)))[0]


def test_reason_forms(one):
    assert reason(one, "Fix the Security hole now.", "Security", "+", 0.955) == (
        "Positive sentiment (0.95) about Security: Fixed issue improving security. Fix the Security hole now."
    )
    assert reason(one, "crash error broken in security", "security", "+", 0.6) == (
        "Negative sentiment (0.70) about security: Problem affecting security. crash error broken in security"
    )
    assert reason(one, "hello to all of you", "Cost", "-", 0.6) == (
        "Negative sentiment (0.60) about Cost: Content may indirectly relate to cost. hello to all of you..."
    )
    assert reason(one, "", "Cost", "-", 0.6) == (
        "Negative sentiment (0.60) about Cost: Content not available or contains invalid characters"
    )


def test_cleaning(one):
    assert one(X.clean_issue_text(F.lit("Don't  panic,\n42 times!"))) == ("don t panic times",)
    assert one(X.clean_for_sentiment(F.lit("[CLS] a  b\n[SEP]"))) == ("a b",)
    assert one(X.clean_for_sentiment(F.lit("x" * 600), 512)) == ("x" * 512,)
    assert one(X.clean_for_sentiment(F.lit("x" * 600))) == ("x" * 600,)
    assert one(X.clean_for_sentiment(F.lit("  "))) == ("Invalid content",)


@pytest.mark.parametrize(
    "text, words",
    [("a, b c ,,d", ["a", "b c", "d"]), ("['a', \"b\"]", ["a", "b"]), ("", []), (None, []), ("__import__('os')", ["__import__(os)"])],
)
def test_related_words(one, text, words):
    assert one(X.related_words(F.lit(text))) == (words,)


def test_small_parsers(one):
    assert one(X.repository_path(F.lit("https://github.com/a/b")), X.comments_url(F.lit("u/1"))) == ("a/b", "u/1/comments")
    assert one(X.is_repository_url(F.lit(None)), X.is_repository_url(F.lit("http://x"))) == (False, False)
    assert one(X.normal_answer(F.lit(" YES\n")), X.normal_answer(F.lit("yes.")), X.normal_answer(F.lit(None))) == (True, False, False)
    assert one(X.nan_to_null(F.lit(float("nan"))), X.nan_to_null(F.lit(1.5))) == (None, 1.5)
    assert one(X.verdict_json(F.lit("a"), F.lit(0.5))) == ('{"label":"a","score":0.5}',)
    labels = [X.graded_label(F.lit(v)) for v in (1.0, 0.5, 0.0)]
    assert one(*labels) == ("maybe-relevant", "maybe-not-relevant", "not-relevant")
    stamp = F.date_format(X.utc_timestamp(F.lit("2020-02-03T04:05:06+02:00")), "yyyy-MM-dd HH:mm:ss")
    assert one(stamp, X.utc_timestamp(F.lit("soon"))) == ("2020-02-03 02:05:06", None)


def attributes(spark):
    rows = [(1, "cost", "what 100% {attribute} is", "price, fee"), (2, "safety", None, "")]
    return spark.createDataFrame(rows, "attribute_id int, attribute string, definition string, related_words string")


def test_hypotheses(spark):
    rows = {(r.attribute_id, r.version, r.hypothesis_no): r.hypothesis for r in hypotheses(attributes(spark)).collect()}
    assert len(rows) == 2 * sum(map(len, HYPOTHESIS_TEMPLATES.values())) == 44
    assert rows[1, "v1", 2] == "This text focuses on 'price', a key aspect of 'cost'."
    assert rows[2, "v1", 2] == "This text focuses on 'safety', a key aspect of 'safety'."
    assert rows[1, "v2", 2] == "The content aligns with the definition of cost: what 100% {attribute} is."
    assert rows[1, "v0", 4] == "The text concerns aspects like: price, fee."
    distinct = {r for (a, *_), r in rows.items() if a == 1}
    assert len(distinct) == 20


def test_labelling_hypotheses_and_prompts(spark, one):
    rows = labelling_hypotheses(attributes(spark)).filter("attribute_id = 1").orderBy("hypothesis_no").collect()
    assert [r.hypothesis for r in rows][2] == "The text is about one of these related words: price, fee."
    assert len(rows) == len(LABELLING_TEMPLATES)
    prompt = one(vote_prompt(F.array(F.lit("h1"), F.lit("h2")), F.lit("body")))[0]
    assert prompt.system.endswith("\nHypotheses:\n - h1\n - h2")
    assert prompt.user == "Text: body\nIs this text relevant?"
    assert one(word_prompt(F.lit("cost"))) == ("Software quality attribute: cost",)
