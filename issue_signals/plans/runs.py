"""Stored runs of the analyses: what is not done yet is analysed, written, and then marked as done.

A run has a number. It reads the marks or results of its number and writes those of the next one, so a
run that fails is repeated with the same input and replaces what it had written. Results come first,
marks after them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_PROJECT_ISSUES, VOTE_AGGREGATIONS
from ..operators.evaluate import todo, vote_todo
from ..operators.progress import above_tracker, of_projects, tracker_after, unprocessed_projects
from ..operators.scoring import Factory
from ..session import materialize
from ..sources.buckets import merge_into, read_buckets
from ..sources.landing import read_table
from ..sources.schemas import LABELLED, MATCHES, MENTIONS, METRICS, SCORE_METRICS_KEY, TRACKER, VOTE_METRICS_KEY
from ..sources.sinks import append_run, replace_table
from .entailment import SETTING, evaluate_grid, label_corpus, score_grid
from .entailment import DEFAULT_MODEL as SCORE_MODEL
from .matches import matched_attributes
from .mentions import criteria_mentions
from .voting import DEFAULT_MODEL as VOTE_MODEL
from .voting import evaluate_votes, prompt_chunks, version_lists, vote_predictions


def _tracked(issues: DataFrame, at: str, run: int, table: str, schema, analyse, more_than: int) -> None:
    """Analyse the issues above the marks of projects with more than more_than of them. The issues of
    the run are written once: results and marks come from the same rows, whatever arrives meanwhile."""
    tracker = read_table(issues.sparkSession, f"{at}/marks/{run}", TRACKER)
    fresh = above_tracker(issues, tracker)
    batch = materialize(of_projects(fresh, unprocessed_projects(issues, tracker, more_than)))
    append_run(analyse(batch), f"{at}/{table}", schema, f"run-{run}")
    replace_table(tracker_after(tracker, batch.select("project_id", "issue_id")), f"{at}/marks/{run + 1}", TRACKER)


def run_mentions(
    issues: DataFrame, comments: DataFrame, words: DataFrame, at: str, run: int, more_than: int = MIN_PROJECT_ISSUES, **options
) -> None:
    """Criteria mentions of the issues that no earlier run saw, in at/mentions."""
    _tracked(issues, at, run, "mentions", MENTIONS, lambda batch: criteria_mentions(batch, comments, words, **options), more_than)


def run_matches(
    issues: DataFrame, comments: DataFrame, attributes: DataFrame, at: str, run: int, more_than: int = MIN_PROJECT_ISSUES, **options
) -> None:
    """Attribute matches of the issues that no earlier run saw, in at/matches."""
    _tracked(issues, at, run, "matches", MATCHES, lambda batch: matched_attributes(batch, comments, attributes, **options), more_than)


def run_labels(corpus: DataFrame, attributes: DataFrame, at: str, run: int, factory: Factory | None = None, **options) -> None:
    """Labels of the corpus merged into at/labels by issue and attribute; the new label wins. The buckets
    of issues whose labels are as before are not written."""
    found = label_corpus(corpus, attributes, factory, **options)
    merge_into(found, f"{at}/labels", run, ["issue_id", "attribute_id"], [F.col("nli_json")], LABELLED, ["issue_id"])


def _merged_metrics(measured: DataFrame, key: Sequence[str], seconds: float | None, at: str, run: int) -> None:
    rows = measured.withColumn("duration_seconds", F.lit(seconds).cast("double"))
    merge_into(rows, f"{at}/metrics", run, key, [F.col("f1_score")], METRICS, ["attribute_id"])


def run_grid(
    texts: DataFrame, truth: DataFrame, attributes: DataFrame, wanted: DataFrame, at: str, run: int,
    text: str = "clean_issue_text", model: str = SCORE_MODEL, factory: Factory | None = None, seconds: float | None = None,
) -> None:
    """Measures of the wanted settings that at/metrics lacks. Attributes, chunkings and limits without a
    missing setting are not scored. seconds is the caller's time of the job, kept with the rows."""
    stored = read_buckets(texts.sparkSession, f"{at}/metrics", run, METRICS)
    missing = materialize(todo(wanted, stored, SCORE_METRICS_KEY))
    open_attributes = attributes.join(missing.select("attribute_id").distinct(), "attribute_id", "left_semi")
    sides = missing.agg(F.collect_set("chunking_strategy"), F.collect_set("max_tokens")).first()  # a few names and numbers
    rows = stored.limit(0)
    if sides[0]:
        scores = score_grid(texts, truth, open_attributes, text, factory, sorted(sides[0]), sorted(sides[1]))
        rows = evaluate_grid(scores, model).join(missing.select("attribute_id", *SETTING), ["attribute_id", *SETTING], "left_semi")
    _merged_metrics(rows, SCORE_METRICS_KEY, seconds, at, run)


def run_votes(
    texts: DataFrame, truth: DataFrame, attributes: DataFrame, at: str, run: int,
    text: str = "clean_issue_text", model: str = VOTE_MODEL, factory: Factory | None = None, seconds: float | None = None, **options,
) -> None:
    """Measures of the vote rules for the attributes and versions that lack one in at/metrics. What is missing is known from
    the attributes and the stored measures, before any text is read."""
    stored = read_buckets(texts.sparkSession, f"{at}/metrics", run, METRICS)
    key = ["attribute_id", "hypothesis_version"]
    own = stored.filter(F.col("model") == model)
    groups = version_lists(attributes).select("attribute_id", F.col("version").alias("hypothesis_version"))
    missing = materialize(vote_todo(groups, own, key, len(VOTE_AGGREGATIONS)).withColumnRenamed("hypothesis_version", "version"))
    rows = stored.limit(0)
    if not missing.isEmpty():
        asked = prompt_chunks(texts, truth, attributes, text, only=missing, **options)
        rows = evaluate_votes(vote_predictions(asked, factory), model)
    _merged_metrics(rows, VOTE_METRICS_KEY, seconds, at, run)
