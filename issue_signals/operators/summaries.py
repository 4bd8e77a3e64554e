"""Counts behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import top_n_per_key


def value_counts(df: DataFrame, column: str, top: int) -> DataFrame:
    """The top most frequent values; ties by value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("mentions"))
    return counted.orderBy(F.desc("mentions"), column).limit(top)


def sentiment_table(mentions: DataFrame, top: int = 5, values: Sequence[str] = ("+", "-")) -> DataFrame:
    """criteria and one count per sentiment, for the most mentioned criteria; one pass over the rows."""
    counted = mentions.groupBy("criteria").agg(
        F.count("*").alias("mentions"),
        *[F.count_if(F.col("semantic") == v).alias(name) for v, name in zip(values, ("positive", "negative"))],
    )
    return counted.orderBy(F.desc("mentions"), "criteria").limit(top).drop("mentions")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (1..bins), low, high, n for bins of equal width; the last bin is closed. Empty bins stay."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    ends = ends.select(
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
    )
    place = F.least(
        F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins)
    ).cast("int")
    # The bounds are one row, read back as a scalar subquery; they come out of the count with the bins.
    bounds = ends.select(F.struct("lo", "hi")).scalar().alias("bounds")
    values = df.filter(F.col(column).isNotNull()).select(column, bounds).select(column, "bounds.lo", "bounds.hi")
    counted = values.select(place.alias("bin"), "lo", "hi").groupBy("bin", "lo", "hi").agg(F.count("*").alias("n"))
    all_bins = counted.groupBy("lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    width = (F.col("hi") - F.col("lo")) / bins
    rows = all_bins.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", width.alias("width"), "counts")
    return rows.select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"),
        (F.col("lo") + F.col("bin") * F.col("width")).alias("high"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("n"),
    )


def words_per_criteria(words: DataFrame) -> DataFrame:
    """criteria and its words in catalogue order."""
    entries = F.array_sort(F.collect_list(F.struct("word_no", "similar_word")))
    return words.groupBy("criteria").agg(F.transform(entries, lambda e: e["similar_word"]).alias("words"))


def cap_matches(mentions: DataFrame, limit: int = 1000, sample: bool = True, seed: int = 0) -> DataFrame:
    """At most limit mentions per project: the highest scores, or a sample that is the same each time."""
    key = ["issue_id", "criteria"]
    draw = F.md5(F.concat_ws(":", F.lit(seed), *key))
    order = [draw, *key] if sample else [F.desc("similarity_score"), *key]
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    return top_n_per_key(mentions, ["project_id"], ordered, limit, row_id=key)
