"""Labels from scores or votes, and their quality against hand labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SCORE_AGGREGATIONS, THRESHOLD_LISTS, VOTE_AGGREGATIONS, VOTE_RATIO
from ..functions.scores import ranked_pass, ranked_scores
from ..functions.text import normal_answer
from .skew import lookup_join


def labelled_texts(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """Texts with their hand labels, one row per label. Hand labels are few: texts stay where they are."""
    labels = truth.select("issue_id", "attribute_id", "is_related")
    return lookup_join(texts, labels, ["issue_id"], "inner")


def with_labels(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """The texts that have a hand label, each once, with labels: a list of (attribute_id, is_related). What is made of a
    text afterwards need not be joined with its labels again."""
    lists = truth.groupBy("issue_id").agg(F.collect_list(F.struct("attribute_id", "is_related")).alias("labels"))
    return lookup_join(texts, lists, ["issue_id"], "inner")


def of_labelled(texts: DataFrame, truth: DataFrame) -> DataFrame:
    """The texts that have a hand label, once each."""
    return lookup_join(texts, truth.select("issue_id").distinct(), ["issue_id"], "left_semi")


def hypothesis_scores(scored: DataFrame, keys: Sequence[str], width: int, scores: str = "scores") -> DataFrame:
    """keys..., max_scores, mean_scores: chunk scores of width hypotheses put together per issue.

    One aggregate per hypothesis position: chunks are combined before the shuffle and the scores of
    an issue arrive in one row.
    """
    at = [F.get(scores, F.lit(i)) for i in range(width)]
    chunks = F.count(scores)
    return scored.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.max(s), F.lit(0.0)) for s in at]).alias("max_scores"),
        F.array(*[F.coalesce(F.try_divide(F.sum(s), chunks), F.lit(0.0)) for s in at]).alias("mean_scores"),
    )


def threshold_name(thresholds: Sequence[float]) -> str:
    return str([float(t) for t in thresholds])


def predictions_by_setting(
    scores: DataFrame,
    versions: dict[str, tuple[int, int]],
    threshold_lists: Sequence[Sequence[float]] = THRESHOLD_LISTS,
    aggregations: Sequence[str] = SCORE_AGGREGATIONS,
) -> DataFrame:
    """Each row of hypothesis_scores once per hypothesis version, threshold list and aggregation, with
    the prediction. versions gives the first position and the number of hypotheses of each version.

    Settings are a list inside the row: scores are computed once and no settings table is joined.
    """
    kept = [c for c in scores.columns if c not in ("max_scores", "mean_scores")]
    ranked = [
        F.struct(
            F.lit(version).alias("hypothesis_version"),
            F.lit(how).alias("aggregation_logic"),
            ranked_scores(F.slice(f"{how}_scores", first + 1, count)).alias("ranked"),
        )
        for version, (first, count) in versions.items()
        for how in aggregations
    ]
    judged = [
        F.struct(
            F.lit(threshold_name(limits)).alias("threshold_config"),
            ranked_pass("ranked", limits).cast("double").alias("prediction"),
        )
        for limits in threshold_lists
    ]
    rows = scores.select(*kept, F.inline(F.array(*ranked)))
    return rows.select(*kept, "hypothesis_version", "aggregation_logic", F.inline(F.array(*judged)))


def trial_results(answers: DataFrame, keys: Sequence[str], answer: str = "answer") -> DataFrame:
    """keys..., trial, yes: a trial says yes when any of its chunks does; no chunk is no."""
    return answers.groupBy(*keys, "trial").agg(F.coalesce(F.bool_or(normal_answer(answer)), F.lit(False)).alias("yes"))


def vote_results(trials: DataFrame, keys: Sequence[str], ratio: float = VOTE_RATIO) -> DataFrame:
    """keys... and one 0/1 column per vote rule. A majority tie goes to the vote of the first trial."""
    yes = F.col("yes")
    n_yes, n = F.count_if(yes), F.count("*")
    majority = F.when(n_yes * 2 == n, F.min_by(yes, "trial")).otherwise(n_yes * 2 > n)
    return trials.groupBy(*keys).agg(
        majority.cast("double").alias("majority_vote"),
        F.bool_and(yes).cast("double").alias("unanimous"),
        F.bool_or(yes).cast("double").alias("first_yes"),
        (n_yes / n >= ratio).cast("double").alias("trial_ratio_threshold"),
    )


def predictions_by_rule(results: DataFrame, rules: Sequence[str] = VOTE_AGGREGATIONS) -> DataFrame:
    kept = [c for c in results.columns if c not in rules]
    rows = [F.struct(F.lit(r).alias("aggregation_logic"), F.col(r).alias("prediction")) for r in rules]
    return results.select(*kept, F.inline(F.array(*rows)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def quality(
    predictions: DataFrame,
    keys: Sequence[str],
    half_label: str = "drop",
    prediction: str = "prediction",
    truth: str = "is_related",
) -> DataFrame:
    """keys..., tp, fp, fn, tn and the five measures; a zero denominator gives 0.

    half_label says what a graded label of 0.5 counts as: "drop" leaves the row out of every cell,
    "negative" takes it as not related.
    """
    if half_label not in ("drop", "negative"):
        raise ValueError("half_label is drop or negative")
    p = F.col(prediction)
    positive = F.col(truth) == 1
    negative = (F.col(truth) != 1) if half_label == "negative" else (F.col(truth) == 0)
    counts = predictions.groupBy(*keys).agg(
        F.count_if((p == 1) & positive).alias("tp"),
        F.count_if((p == 1) & negative).alias("fp"),
        F.count_if((p == 0) & positive).alias("fn"),
        F.count_if((p == 0) & negative).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    measured = counts.select(
        "*",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    )
    return measured.withColumn("f1_score", f1("precision", "recall"))


def f1(precision: Column | str, recall: Column | str) -> Column:
    p, r = (F.col(c) if isinstance(c, str) else c for c in (precision, recall))
    return _ratio(p * r * 2, p + r)


def todo(wanted: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """The wanted settings without a result."""
    return lookup_join(wanted, done.select(*key).distinct(), key, "left_anti")


def vote_todo(wanted: DataFrame, done: DataFrame, key: Sequence[str], rules: int = len(VOTE_AGGREGATIONS)) -> DataFrame:
    """The wanted groups that do not have a result for every vote rule; key excludes the rule."""
    complete = done.groupBy(*key).agg(F.count_distinct("aggregation_logic").alias("n")).filter(F.col("n") >= rules)
    return lookup_join(wanted, complete.select(*key), key, "left_anti")


def best_setting(metrics: DataFrame, keys: Sequence[str], setting: Sequence[str], measure: str = "f1_score") -> DataFrame:
    """keys..., the setting with the highest measure and the measure; ties go to the setting that
    sorts first."""
    low_first = F.struct((-F.col(measure)).alias("m"), *setting)
    best = metrics.groupBy(*keys).agg(F.min(low_first).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in setting], (-F.col("best.m")).alias(measure))


def macro_mean(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    measures = ["precision", "recall", "specificity", "accuracy", "f1_score"]
    return metrics.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])
