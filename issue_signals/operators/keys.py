"""Rows by key: first or last of a key, missing keys, merges, duplicates of a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import lookup_join


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order. Spark keeps one row per key and task before the
    shuffle (window group limit), so a hot key sends few rows."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).filter("place = 1").drop("place")


def insert_if_absent(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """The rows to append to target: new keys only, the first arrival of each.

    The target is first reduced to the incoming keys; while these fit a broadcast it is not shuffled."""
    first = first_by_key(incoming, keys, order)
    present = target.select(*keys).join(first.select(*keys), list(keys), "left_semi")
    return first.join(present, list(keys), "left_anti")


def keyed_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old with the rows of new put in place of those with the same key; the first in order wins
    among several new rows of a key. old is not shuffled while the new keys fit a broadcast."""
    latest = first_by_key(new, keys, order)
    kept = lookup_join(old, latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*old.columns))


def update_column(table: DataFrame, name: str, value: Column) -> DataFrame:
    """Set one derived column for every row; written back with a whole-table write."""
    return table.withColumn(name, value)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent and how many rows each has. Counted before the join, so that a
    key goes through it once."""
    counted = child.filter(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count("*").alias("rows"))
    parents = parent.select(F.col(parent_key).alias(child_key))
    return counted.join(parents, child_key, "left_anti")


def with_text_key(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("text_key", F.sha2(F.col(text), 256))


def distinct_texts(
    df: DataFrame, scope: Sequence[str] = ("project_id",), text: str = "text", row_id: str = "issue_id"
) -> DataFrame:
    """scope, text_key, text, issues: each text once per scope. df has a text_key.

    The row with the smallest id stands for its text; keys and ids are aggregated, texts are not."""
    first = df.groupBy(*scope, "text_key").agg(F.min(row_id).alias(row_id), F.count("*").alias("issues"))
    return df.select(*scope, "text_key", row_id, text).join(first, [*scope, "text_key", row_id]).drop(row_id)


def back_to_issues(issues: DataFrame, scored: DataFrame, scope: Sequence[str] = ("project_id",)) -> DataFrame:
    """Give every issue the result of its text."""
    return lookup_join(issues, scored, [*scope, "text_key"])
