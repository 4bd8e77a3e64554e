"""Entailment labelling of a corpus and the evaluation of its settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CHUNKINGS,
    HYPOTHESIS_TEMPLATES,
    LABELLING_TEMPLATES,
    SCORE_AGGREGATIONS,
    THRESHOLD_LISTS,
    TOKEN_LIMITS,
)
from ..functions.chunks import line_chunker, packer
from ..functions.hypotheses import hypotheses, labelling_hypotheses
from ..functions.scores import labelling_verdict
from ..functions.text import verdict_json
from ..operators.evaluate import (
    hypothesis_scores,
    predictions_by_setting,
    quality,
    todo,
    with_labels,
)
from ..operators.keywords import attribute_terms, keyword_sets
from ..operators.scoring import Factory, entailment_scores
from ..operators.skew import lookup_join

DEFAULT_MODEL = "token-overlap"
SETTING = ["chunking_strategy", "threshold_config", "hypothesis_version", "max_tokens", "aggregation_logic"]


def hypothesis_lists(attributes: DataFrame, rows: DataFrame) -> DataFrame:
    """attribute_id, attribute, hypotheses: an attribute's hypotheses in version and template order."""
    ordered = F.array_sort(F.collect_list(F.struct("version", "hypothesis_no", "hypothesis")))
    lists = rows.groupBy("attribute_id").agg(F.transform(ordered, lambda h: h["hypothesis"]).alias("hypotheses"))
    return attributes.select("attribute_id", "attribute").join(lists, "attribute_id")


def version_places(templates: dict[str, Sequence[str]] = HYPOTHESIS_TEMPLATES) -> dict[str, tuple[int, int]]:
    """First position and length of each version in the lists of hypothesis_lists."""
    places, first = {}, 0
    for version in sorted(templates):
        places[version] = (first, len(templates[version]))
        first += len(templates[version])
    return places


def label_corpus(
    corpus: DataFrame,
    attributes: DataFrame,
    factory: Factory | None = None,
    max_tokens: int = 512,
    text: str = "clean_issue_text",
) -> DataFrame:
    """issue_id, project_id, attribute_id, nli_label, nli_json for texts with a keyword of the attribute.

    The keyword filter comes first, so only texts that pass it are chunked, each once, and scored. The attributes of a text
    are a list in its row, so that the corpus is read once and neither texts nor chunks are joined with them.
    """
    found = keyword_sets(corpus.filter("issue_id IS NOT NULL"), attribute_terms(attributes), text, ("issue_id", "project_id", text))
    lists = hypothesis_lists(attributes, labelling_hypotheses(attributes))
    chunked = found.select("issue_id", "project_id", "attribute_ids", F.explode_outer(line_chunker(max_tokens)(F.col(text))).alias("chunk"))
    each = chunked.select("issue_id", "project_id", "chunk", F.explode("attribute_ids").alias("attribute_id"))
    asked = lookup_join(each, lists, ["attribute_id"], "inner")
    scored = entailment_scores(asked, factory=factory)
    per_issue = hypothesis_scores(scored, ["issue_id", "project_id", "attribute_id"], len(LABELLING_TEMPLATES))
    labelled = per_issue.withColumn("verdict", labelling_verdict("max_scores"))
    return labelled.select(
        "issue_id",
        "project_id",
        "attribute_id",
        F.col("verdict.label").alias("nli_label"),
        verdict_json("verdict.label", "verdict.score").alias("nli_json"),
        F.col("verdict.score").alias("score"),
    )


def chunk_sets(text: str, chunkings: Sequence[str] = CHUNKINGS, limits: Sequence[int] = TOKEN_LIMITS) -> Column:
    """One (chunking_strategy, max_tokens, chunks) per chunking and token limit."""

    def sets_of(strategy: str) -> Column:
        return F.zip_with(
            packer(limits, strategy)(F.col(text)),
            F.array(*[F.lit(n) for n in limits]),
            lambda chunks, n: F.struct(
                F.lit(strategy).alias("chunking_strategy"), n.alias("max_tokens"), chunks.alias("chunks")
            ),
        )

    return F.flatten(F.array(*[sets_of(strategy) for strategy in chunkings]))


def score_grid(
    texts: DataFrame,
    truth: DataFrame,
    attributes: DataFrame,
    text: str = "clean_issue_text",
    factory: Factory | None = None,
    chunkings: Sequence[str] = CHUNKINGS,
    limits: Sequence[int] = TOKEN_LIMITS,
) -> DataFrame:
    """issue_id, attribute_id, attribute, is_related, chunking_strategy, max_tokens, max_scores, mean_scores.

    texts has one row per issue or page. Scores depend on text, hypothesis, chunking and limit only;
    thresholds and aggregations are applied to them afterwards and cost no further model call. A text
    is chunked once, whatever the number of its labels.
    """
    lists = hypothesis_lists(attributes, hypotheses(attributes))
    once = with_labels(texts.select("issue_id", text), truth)
    sets = once.select("issue_id", "labels", F.inline_outer(chunk_sets(text, chunkings, limits)))
    chunked = sets.select("issue_id", "labels", "chunking_strategy", "max_tokens", F.explode_outer("chunks").alias("chunk"))
    labelled = chunked.select("issue_id", "chunking_strategy", "max_tokens", "chunk", F.inline("labels"))
    asked = lookup_join(labelled, lists, ["attribute_id"], "inner")
    width = sum(len(t) for t in HYPOTHESIS_TEMPLATES.values())
    keys = ["issue_id", "attribute_id", "attribute", "is_related", "chunking_strategy", "max_tokens"]
    return hypothesis_scores(entailment_scores(asked, factory=factory), keys, width)


def evaluate_grid(
    scores: DataFrame,
    model: str = DEFAULT_MODEL,
    half_label: str = "drop",
    threshold_lists: Sequence[Sequence[float]] = THRESHOLD_LISTS,
    aggregations: Sequence[str] = SCORE_AGGREGATIONS,
) -> DataFrame:
    """One row of measures per attribute and setting."""
    predicted = predictions_by_setting(scores, version_places(), threshold_lists, aggregations)
    measured = quality(predicted, ["attribute_id", "attribute", *SETTING], half_label)
    return measured.withColumn("model", F.lit(model))


def settings(
    attributes: DataFrame,
    models: Sequence[str],
    chunkings: Sequence[str] = CHUNKINGS,
    threshold_names: Sequence[str] = (),
    limits: Sequence[int] = TOKEN_LIMITS,
    aggregations: Sequence[str] = SCORE_AGGREGATIONS,
    versions: Sequence[str] = tuple(HYPOTHESIS_TEMPLATES),
) -> DataFrame:
    """Every combination of the settings for every attribute, as lists unfolded inside its row."""
    choices = {
        "model": models,
        "chunking_strategy": chunkings,
        "threshold_config": threshold_names,
        "hypothesis_version": versions,
        "max_tokens": limits,
        "aggregation_logic": aggregations,
    }
    rows = attributes.select("attribute_id")
    for name, values in choices.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows


def settings_todo(wanted: DataFrame, done: DataFrame) -> DataFrame:
    from ..sources.schemas import SCORE_METRICS_KEY

    return todo(wanted, done, SCORE_METRICS_KEY)
