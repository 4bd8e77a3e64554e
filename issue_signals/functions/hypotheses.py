"""Hypothesis and prompt wording from attribute columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import HYPOTHESIS_TEMPLATES, LABELLING_TEMPLATES, VOTE_INSTRUCTION, VOTE_QUESTION, WORD_PROMPT
from .text import col, related_words

PLACES = {"attribute": 1, "definition": 2, "related_words": 3, "first_word": 4}


def _fill(template: str, arguments: Sequence[Column]) -> Column:
    pattern = template.replace("%", "%%")
    for name, place in PLACES.items():
        pattern = pattern.replace("{" + name + "}", f"%{place}$s")
    return F.format_string(pattern, *arguments)


def hypotheses(attributes: DataFrame, templates: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """attribute_id, version, hypothesis_no, hypothesis: one row per template and attribute.

    Without related words the first word falls back to the attribute's name.
    """
    templates = templates or HYPOTHESIS_TEMPLATES
    words = related_words("related_words")
    arguments = [
        F.col("attribute"),
        F.coalesce("definition", F.lit("")),
        F.array_join(words, ", "),
        F.coalesce(F.get(words, F.lit(0)), F.col("attribute")),
    ]
    filled = [
        F.struct(F.lit(version).alias("version"), F.lit(i).alias("hypothesis_no"), _fill(t, arguments).alias("hypothesis"))
        for version, rows in templates.items()
        for i, t in enumerate(rows)
    ]
    return attributes.select("attribute_id", F.inline(F.array(*filled)))


def labelling_hypotheses(attributes: DataFrame) -> DataFrame:
    return hypotheses(attributes, {"prod": LABELLING_TEMPLATES})


def word_prompt(word: Column | str) -> Column:
    return F.concat(F.lit(WORD_PROMPT), col(word))


def vote_prompt(hypothesis_list: Column | str, text: Column | str) -> Column:
    """struct(system, user): the two messages put to a voting model."""
    return F.struct(
        F.concat(F.lit(VOTE_INSTRUCTION), F.array_join(col(hypothesis_list), "\n - ")).alias("system"),
        F.concat(F.lit("Text: "), col(text), F.lit(VOTE_QUESTION)).alias("user"),
    )
