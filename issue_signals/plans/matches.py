"""Attribute matches: one row per issue and attribute whose definition is near to the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import MATCH_THRESHOLD
from ..operators.combine import combine_blank_joined
from ..operators.scoring import Factory, embed, sentiment
from ..operators.similarity import attribute_matches


def defined_attributes(attributes: DataFrame, embedder: Factory | None = None, dim: int = 64) -> DataFrame:
    """word_no, attribute, vector: each attribute with a definition once."""
    rows = attributes.filter(F.col("definition").isNotNull()).select("attribute", "definition").distinct()
    numbered = rows.withColumn("word_no", F.row_number().over(Window.orderBy("attribute", "definition")).cast("long"))
    return embed(numbered, "definition", embedder, dim).select("word_no", "attribute", "vector")


def matched_attributes(
    issues: DataFrame,
    comments: DataFrame,
    attributes: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    embedder: Factory | None = None,
    classifier: Factory | None = None,
    dim: int = 64,
    **lexicon,
) -> DataFrame:
    """project_id, attribute, sentiment, similarity_score, issue_id: one row per match, so an attribute
    with two definitions that match gives two."""
    texts = combine_blank_joined(issues, comments)
    scored = sentiment(texts, "text", classifier, neutral=True, **lexicon)
    vectors = embed(scored, "text", embedder, dim).drop("text")
    keep = ("project_id", "issue_id", "sentiment")
    return attribute_matches(vectors, defined_attributes(attributes, embedder, dim), threshold, keep=keep)
