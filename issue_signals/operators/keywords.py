"""Keyword match of texts with attribute terms.

Terms are literal substrings, compared in lower case. A small catalogue becomes one condition per
attribute over the lowered text: no join, no Python. A larger one is searched in one pass over each
text with an automaton that every task holds. Beyond the broadcast bound the attributes are dealt to
several such automatons, one pass over the texts each; texts are never shuffled. All ways give the
same rows: one per row of texts and attribute.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import any_substring, related_words
from ..session import small_batches
from .skew import MAX_BROADCAST_ROWS, bounded_rows

if TYPE_CHECKING:
    import ahocorasick

MAX_LITERAL_TERMS = 64


def attribute_terms(attributes: DataFrame) -> DataFrame:
    """attribute_id, term: the attribute's name and its related words, lowered and distinct."""
    names = F.concat(F.array(F.col("attribute")), related_words("related_words"))
    return (
        attributes.select("attribute_id", F.explode(names).alias("term"))
        .select("attribute_id", F.lower("term").alias("term"))
        .filter("term <> ''")
        .distinct()
    )


def _automaton(terms: Iterable[tuple[int, str]]) -> ahocorasick.Automaton:
    import ahocorasick

    attributes_of: dict[str, set[int]] = {}
    for attribute_id, term in terms:
        attributes_of.setdefault(term, set()).add(attribute_id)
    automaton = ahocorasick.Automaton()
    for term, ids in attributes_of.items():
        automaton.add_word(term, ids)
    automaton.make_automaton()
    return automaton


def _scan(batch: pd.DataFrame, automaton: ahocorasick.Automaton, keep: list[str]) -> pd.DataFrame:
    found = batch["lowered"].map(lambda t: sorted(set().union(*(ids for _, ids in automaton.iter(t)))) if t is not None else [])
    rows = batch[keep].assign(attribute_ids=found)
    return rows[found.map(len) > 0]


def keyword_matches(
    texts: DataFrame,
    terms: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("issue_id",),
    max_literal: int = MAX_LITERAL_TERMS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """keep..., attribute_id: one row per text and attribute with at least one term in the text."""
    sets = keyword_sets(texts, terms, text, keep, max_literal, max_broadcast)
    return sets.select(*keep, F.explode("attribute_ids").alias("attribute_id"))


def keyword_sets(
    texts: DataFrame,
    terms: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("issue_id",),
    max_literal: int = MAX_LITERAL_TERMS,
    max_broadcast: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """keep..., attribute_ids: the texts with at least one term, with the attributes of their terms. Beyond the broadcast
    bound a text is one row per automaton that finds a term in it."""
    keep = list(keep)
    kind = T.ArrayType(terms.schema["attribute_id"].dataType)
    lowered = texts.select(*keep, F.lower(text).alias("lowered"))
    schema = lowered.select(*keep).schema.add("attribute_ids", kind)
    terms = terms.select("attribute_id", "term")

    rows = bounded_rows(terms, max_broadcast)
    if rows is None:
        shards = -(-terms.count() // max_broadcast)
        dealt = [terms.filter(F.pmod(F.xxhash64("attribute_id"), F.lit(shards)) == k).collect() for k in range(shards)]
        return reduce(DataFrame.unionByName, [_searched(lowered, rows, keep, schema) for rows in dealt])
    if len(rows) > max_literal:
        return _searched(lowered, rows, keep, schema)

    by_attribute: dict[int, list[str]] = {}
    for row in sorted(rows):
        by_attribute.setdefault(row["attribute_id"], []).append(row["term"])
    hits = [F.when(any_substring(F.col("lowered"), words), F.lit(k).cast(kind.elementType)) for k, words in by_attribute.items()]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast(kind)
    # unfolded from a list of one, so that no later filter is pushed below this step and lowers the texts again
    return lowered.select(*keep, F.explode(F.filter(F.array(found), lambda s: F.size(s) > 0)).alias("attribute_ids"))


def _searched(lowered: DataFrame, terms: list[Row], keep: list[str], schema: T.StructType) -> DataFrame:
    shared = lowered.sparkSession.sparkContext.broadcast([tuple(r) for r in terms])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value) if shared.value else None
        for batch in batches if automaton else ():
            yield _scan(batch, automaton, keep)

    small_batches(lowered.sparkSession)
    return lowered.mapInPandas(search, schema)
