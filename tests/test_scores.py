import math

import pytest
from pyspark.sql import functions as F

from issue_signals.functions import scores as S
from issue_signals.functions import vectors as V
from issue_signals.operators import evaluate
from issue_signals.plans.entailment import version_places


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


@pytest.mark.parametrize(
    "scores, thresholds, hit",
    [
        ([0.6], [0.6, 0.55], True),
        ([0.59, 0.55], [0.6, 0.55], True),
        ([0.59, 0.54], [0.6, 0.55], False),
        ([0.1], [0.6, 0.05], False),
        ([], [0.6], False),
        ([0.1, 0.9], [0.8], True),
    ],
)
def test_cascade(one, scores, thresholds, hit):
    assert one(S.passes_cascade(doubles(scores), thresholds)) == (hit,)


def test_labelling_verdict(one):
    assert tuple(one(S.labelling_verdict(doubles([])))[0]) == ("maybe-not-relevant", 0.0)
    assert tuple(one(S.labelling_verdict(doubles([0.7] * 5)))[0]) == ("maybe-relevant", 0.7)
    assert tuple(one(S.labelling_verdict(doubles([0.89, 0.1])))[0]) == ("maybe-not-relevant", 0.89)


def test_softmax_and_entailment(one):
    total = math.exp(1) + math.exp(2) + math.exp(3)
    logits = doubles([1, 2, 3])
    got = one(S.entailment(logits), S.entailment(logits, 0), S.entailment(doubles([1, 2])))
    want = (math.exp(3) / total, math.exp(1) / total, math.exp(2) / (math.exp(1) + math.exp(2)))
    assert got == pytest.approx(want)


def test_signs(one):
    assert one(*[S.sign_of(F.lit(v)) for v in (0.01, -0.01, 0.0)]) == ("+", "-", "0")
    assert one(S.sign_of(F.lit(0.04), 0.05), S.polarity_of_label(F.lit("POSITIVE")), S.polarity_of_label(F.lit("x"))) == ("0", "+", "-")


def test_vectors(one):
    a, b = doubles([3, 4]), doubles([4, 3])
    assert one(V.dot(a, b), V.norm(a), V.cosine(a, b), V.cosine(a, doubles([0, 0]))) == pytest.approx((24, 5, 0.96, 0))
    assert one(V.unit(a), V.unit(doubles([0, 0]))) == ([0.6, 0.8], [0.0, 0.0])


def votes(spark, rows):
    trials = spark.createDataFrame(rows, "issue_id long, trial int, answer string")
    results = evaluate.vote_results(evaluate.trial_results(trials, ["issue_id"]), ["issue_id"])
    return {r.issue_id: tuple(r)[1:] for r in results.collect()}


def test_vote_rules(spark):
    def trial_rows(issue, answers):
        return [(issue, i, a) for i, a in enumerate(answers)]

    rows = [
        *trial_rows(1, ["yes"] * 3 + ["no"] * 2),
        *trial_rows(2, ["no", "yes"] * 2 + ["no"]),
        *trial_rows(3, ["no", "yes"]),
        *trial_rows(4, ["yes", "no"]),
        *trial_rows(5, [" Yes "] * 5),
        (6, 0, None),
        (7, 0, "no"),
        (7, 0, "yes"),
    ]
    assert votes(spark, rows) == {
        1: (1.0, 0.0, 1.0, 1.0),
        2: (0.0, 0.0, 1.0, 0.0),
        3: (0.0, 0.0, 1.0, 0.0),
        4: (1.0, 0.0, 1.0, 0.0),
        5: (1.0, 1.0, 1.0, 1.0),
        6: (0.0, 0.0, 0.0, 0.0),
        7: (1.0, 1.0, 1.0, 1.0),
    }


# Hand labels per attribute as counts of 1.0, 0.5 and 0.0, and the published F1 of the
# model that answers "related" for every pair.
LABEL_COUNTS = {
    1: (10, 3, 4), 2: (12, 1, 8), 3: (9, 1, 10), 4: (14, 1, 1), 5: (11, 4, 1), 6: (9, 0, 8), 7: (1, 0, 0),
    8: (6, 0, 1), 9: (10, 1, 9), 10: (14, 4, 2), 11: (4, 1, 15), 12: (6, 2, 5), 13: (5, 2, 6), 14: (8, 0, 0),
    15: (11, 2, 3), 16: (1, 1, 0), 17: (9, 1, 0), 18: (14, 1, 5), 20: (0, 0, 2),
}
PUBLISHED_F1 = {
    1: 0.7407, 2: 0.7273, 3: 0.6207, 4: 0.9333, 5: 0.8148, 6: 0.6923, 7: 1.0, 8: 0.9231, 9: 0.6667, 10: 0.8235,
    11: 0.3333, 12: 0.6316, 13: 0.5556, 14: 1.0, 15: 0.8148, 16: 0.6667, 17: 0.9474, 18: 0.8235, 20: 0.0,
}


def all_related(spark):
    rows = [
        (attribute, label, 1.0)
        for attribute, counts in LABEL_COUNTS.items()
        for label, n in zip((1.0, 0.5, 0.0), counts)
        for _ in range(n)
    ]
    assert len(rows) == 259
    return spark.createDataFrame(rows, "attribute_id int, is_related double, prediction double")


def test_published_numbers_of_the_all_positive_model(spark):
    measured = evaluate.quality(all_related(spark), ["attribute_id"], "negative")
    rows = {r.attribute_id: r for r in measured.collect()}
    assert {a: round(r.f1_score, 4) for a, r in rows.items()} == PUBLISHED_F1
    assert rows[1].precision == pytest.approx(0.5882352941176471) and rows[1].recall == 1.0
    assert rows[1].specificity == 0.0 and rows[1].accuracy == pytest.approx(0.5882352941176471)
    mean = evaluate.macro_mean(measured, []).first()
    assert tuple(round(v, 4) for v in mean) == (0.6101, 0.9474, 0.0, 0.6101, 0.7219)


def test_half_labels_drop_by_default(spark):
    row = evaluate.quality(all_related(spark), ["attribute_id"]).filter("attribute_id = 1").first()
    assert (row.tp, row.fp, row.fn, row.tn) == (10, 4, 0, 0)
    with pytest.raises(ValueError):
        evaluate.quality(all_related(spark), ["attribute_id"], "keep")


def test_f1_of_published_precision_and_recall(one):
    # Precision, recall and F1 as published.
    published = [(0.5, 0.1, 0.16666666666666669), (0.0, 0.0, 0.0), (0.5, 0.1111111111111111, 0.1818181818181818), (0.45, 1.0, 0.6206896551724138)]
    assert one(*[evaluate.f1(F.lit(p), F.lit(r)) for p, r, _ in published]) == pytest.approx([f for *_, f in published])


def test_chunk_scores_per_issue(spark):
    rows = [(1, [0.2, 0.4]), (1, [0.6, 0.0]), (2, None)]
    scored = spark.createDataFrame(rows, "issue_id long, scores array<double>")
    got = {r.issue_id: r for r in evaluate.hypothesis_scores(scored, ["issue_id"], 2).collect()}
    assert got[1].max_scores == [0.6, 0.4] and got[1].mean_scores == pytest.approx([0.4, 0.2])
    assert got[2].max_scores == [0.0, 0.0] and got[2].mean_scores == [0.0, 0.0]


def test_predictions_by_setting(spark):
    scores = spark.createDataFrame([(1, [0.9, 0.1, 0.7], [0.5, 0.1, 0.2])], "issue_id long, max_scores array<double>, mean_scores array<double>")
    got = evaluate.predictions_by_setting(scores, {"a": (0, 2), "b": (2, 1)}, [[0.8, 0.6], [0.6]])
    found = {(r.hypothesis_version, r.threshold_config, r.aggregation_logic): r.prediction for r in got.collect()}
    assert len(found) == 8
    assert found["a", "[0.8, 0.6]", "max"] == 1.0 and found["b", "[0.8, 0.6]", "max"] == 0.0
    assert found["b", "[0.6]", "max"] == 1.0 and found["a", "[0.6]", "mean"] == 0.0


def test_version_places_cover_the_list():
    places = version_places()
    assert places["v0"] == (0, 5) and places["v6"] == (20, 2) and sum(n for _, n in places.values()) == 22


def test_skip_done_settings(spark):
    wanted = spark.createDataFrame([(1, "m", "a"), (2, "m", "a")], "attribute_id int, model string, version string")
    done = spark.createDataFrame([(1, "m", "a")], "attribute_id int, model string, version string")
    assert [r.attribute_id for r in evaluate.todo(wanted, done, ["attribute_id", "model", "version"]).collect()] == [2]
    rules = ["majority_vote", "unanimous", "first_yes", "trial_ratio_threshold"]
    stored = spark.createDataFrame([(1, "m", r) for r in rules] + [(2, "m", r) for r in rules[:3]], "attribute_id int, model string, aggregation_logic string")
    assert [r.attribute_id for r in evaluate.vote_todo(wanted, stored, ["attribute_id", "model"]).collect()] == [2]


def test_best_setting_breaks_ties_by_name(spark):
    rows = [(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.4), (2, "z", 0.0)]
    metrics = spark.createDataFrame(rows, "attribute_id int, setting string, f1_score double")
    got = evaluate.best_setting(metrics, ["attribute_id"], ["setting"]).collect()
    assert {(r.attribute_id, r.setting, r.f1_score) for r in got} == {(1, "a", 0.5), (2, "z", 0.0)}
