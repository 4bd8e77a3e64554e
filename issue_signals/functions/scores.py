"""Score, vote and label expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import LABELLING_THRESHOLDS
from .text import col, let


def softmax(logits: Column | str) -> Column:
    def powers(x: Column) -> Column:
        return let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def shares(p: Column) -> Column:
        return let(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(p, lambda v: v / total))

    return let(let(col(logits), powers), shares)


def entailment(logits: Column | str, index: int | None = None) -> Column:
    """Probability of the entailment class. Without an index: class 2 of three or more, else class 1."""
    x = col(logits)
    place = F.when(F.size(x) >= 3, F.lit(2)).otherwise(F.lit(1)) if index is None else F.lit(index)
    return F.get(softmax(x), place)


def ranked_scores(scores: Column | str) -> Column:
    return F.sort_array(col(scores), asc=False)


def ranked_pass(ranked: Column | str, thresholds: Sequence[float]) -> Column:
    """True if the i-th of the ranked scores reaches the i-th threshold for any i; plain comparisons,
    so that the generated code holds them."""
    hits = [F.coalesce(F.get(col(ranked), F.lit(i)) >= float(t), F.lit(False)) for i, t in enumerate(thresholds)]
    return reduce(lambda a, b: a | b, hits)


def passes_cascade(scores: Column | str, thresholds: Sequence[float]) -> Column:
    """True if the i-th highest score reaches the i-th threshold for any i."""
    return ranked_pass(ranked_scores(scores), thresholds)


def labelling_verdict(scores: Column | str, thresholds: Sequence[float] = LABELLING_THRESHOLDS) -> Column:
    """struct(label, score): the label of the cascade and the top score, 0.0 when there is none."""
    s = col(scores)
    return F.struct(
        F.when(passes_cascade(s, thresholds), F.lit("maybe-relevant"))
        .otherwise(F.lit("maybe-not-relevant"))
        .alias("label"),
        F.coalesce(F.array_max(s), F.lit(0.0)).alias("score"),
    )


def sign_of(compound: Column | str, cut: float = 0.0) -> Column:
    c = col(compound)
    return F.when(c > cut, F.lit("+")).when(c < -cut, F.lit("-")).otherwise(F.lit("0"))


def polarity_of_label(label: Column | str) -> Column:
    return F.when(col(label) == "POSITIVE", F.lit("+")).otherwise(F.lit("-"))
