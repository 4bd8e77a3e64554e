"""Criteria mentions: which criteria an issue text is near to, with signed strength."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..fixed_values import MENTION_THRESHOLD
from ..functions.hypotheses import word_prompt
from ..operators.combine import combine_labelled
from ..operators.keys import back_to_issues, distinct_texts, with_text_key
from ..operators.scoring import Factory, embed, sentiment
from ..operators.similarity import mention_scores, mentions_of, signed, word_lookup
from ..session import materialize


def criteria_words(words: DataFrame, factory: Factory | None = None, dim: int = 64, shared_words: str = "last") -> DataFrame:
    """word_no, criteria, word, weight, vector of the catalogue, from its prompts."""
    looked_up = word_lookup(words, shared_words=shared_words).withColumn("prompt", word_prompt("word"))
    return embed(looked_up, "prompt", factory, dim).drop("prompt")


def criteria_mentions(
    issues: DataFrame,
    comments: DataFrame,
    words: DataFrame,
    threshold: float = MENTION_THRESHOLD,
    embedder: Factory | None = None,
    classifier: Factory | None = None,
    dim: int = 64,
    max_chars: int | None = None,
    shared_words: str = "last",
    **lexicon,
) -> DataFrame:
    """project_id, criteria, semantic, similarity_score, issue_id.

    Each distinct text of a project is embedded, compared and classified once; the assembled texts
    are written to the shared folder, because both the scoring and the way back to the issues read
    them, the latter only their keys.
    """
    assembled = combine_labelled(issues, comments, max_chars)
    texts = materialize(with_text_key(assembled))
    once = sentiment(distinct_texts(texts), "text", classifier, **lexicon)
    vectors = embed(once, "text", embedder, dim).drop("text")
    keep = ("project_id", "text_key", "sentiment")
    scores = mention_scores(vectors, criteria_words(words, embedder, dim, shared_words), threshold, keep=keep)
    per_text = scores.select("project_id", "text_key", "criteria", signed("score", "sentiment").alias("total"))
    found = back_to_issues(texts.select("project_id", "issue_id", "text_key"), per_text)
    return mentions_of(found, threshold).select("project_id", "criteria", "semantic", "similarity_score", "issue_id")
