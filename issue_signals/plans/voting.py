"""Evaluation of yes/no voting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import token_budget, token_count, tokens, windows_of
from ..functions.hypotheses import hypotheses, vote_prompt
from ..operators.evaluate import (
    predictions_by_rule,
    quality,
    trial_results,
    vote_results,
    with_labels,
)
from ..operators.scoring import Factory, votes
from ..operators.skew import lookup_join

DEFAULT_MODEL = "keyword-rule"


def version_lists(attributes: DataFrame) -> DataFrame:
    """attribute_id, attribute, related_words, version, hypotheses: one list per hypothesis version."""
    ordered = F.array_sort(F.collect_list(F.struct("hypothesis_no", "hypothesis")))
    lists = (
        hypotheses(attributes)
        .groupBy("attribute_id", "version")
        .agg(F.transform(ordered, lambda h: h["hypothesis"]).alias("hypotheses"))
    )
    return attributes.select("attribute_id", "attribute", "related_words").join(lists, "attribute_id")


def prompt_chunks(
    texts: DataFrame, truth: DataFrame, attributes: DataFrame, text: str = "clean_issue_text", model_limit: int = 8192,
    only: DataFrame | None = None,
) -> DataFrame:
    """One row per labelled text, hypothesis version and token window, with the prompt.

    The window leaves room for the prompt's own words; a text without tokens has a NULL chunk. only: the attributes and
    versions (attribute_id, version) to ask for, all if it is missing; texts meet no others.
    """
    lists = version_lists(attributes)
    if only is not None:
        lists = lists.join(only.select("attribute_id", "version"), ["attribute_id", "version"], "left_semi")
    empty = vote_prompt("hypotheses", F.lit(""))
    used = token_count(F.concat_ws(" ", empty["system"], empty["user"]))
    sized = lists.withColumn("max_tokens", token_budget(used, model_limit))
    words = with_labels(texts.select("issue_id", text), truth).select("issue_id", "labels", tokens(text).alias("tokens"))
    asked = lookup_join(words.select("issue_id", "tokens", F.inline("labels")), sized, ["attribute_id"], "inner")
    windows = asked.select("*", F.posexplode_outer(windows_of("tokens", F.col("max_tokens"))).alias("chunk_no", "chunk"))
    prompt = vote_prompt("hypotheses", F.coalesce("chunk", F.lit("")))
    return windows.withColumn("prompt", F.concat_ws("\n", prompt["system"], prompt["user"])).drop("tokens", "hypotheses")


def vote_predictions(prompts: DataFrame, factory: Factory | None = None, trials: int = 5) -> DataFrame:
    """issue_id, attribute_id, attribute, is_related, hypothesis_version and one column per vote rule."""
    keys = ["issue_id", "attribute_id", "attribute", "is_related", "hypothesis_version", "max_tokens"]
    asked = prompts.withColumnRenamed("version", "hypothesis_version")
    if factory is None:  # every trial has the same answer: the chunks of a text are put together once, for all trials
        once = trial_results(votes(asked, 1), keys).drop("trial")
        return vote_results(once.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))), keys)
    return vote_results(trial_results(votes(asked, trials, factory), keys), keys)


def evaluate_votes(predictions: DataFrame, model: str = DEFAULT_MODEL, half_label: str = "drop") -> DataFrame:
    keys = ["attribute_id", "attribute", "hypothesis_version", "max_tokens", "aggregation_logic"]
    measured = quality(predictions_by_rule(predictions), keys, half_label)
    return measured.select(
        "*",
        F.lit(model).alias("model"),
        F.lit("token").alias("chunking_strategy"),
        F.lit("default").alias("threshold_config"),
    )
