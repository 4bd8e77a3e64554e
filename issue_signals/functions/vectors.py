"""Vectors as array columns, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double, whatever the element type."""
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, v: total + v,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """Scaled to length 1; a zero vector stays zero."""

    def scaled(p: Column) -> Column:
        return F.transform(p["v"], lambda x: F.when(p["length"] > 0, x.cast("double") / p["length"]).otherwise(0.0))

    return let(let(col(a), lambda v: F.struct(v.alias("v"), norm(v).alias("length"))), scaled)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
