"""Joins and top-n that hold when one key has a third of all rows.

No step here runs a job. Which side is broadcast is decided on the plan's statistics and, at run time,
on the sizes of the shuffle; a partition that one key makes large is split by adaptive execution, for
inner, left, semi and anti joins alike, because nothing between the scan and the join pins the
partitions. NULL keys match nothing and take the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000
#: Rows per key up to which Spark itself ranks within a task before it shuffles.
GROUP_LIMIT = 1_000


def bounded_rows(df: DataFrame, max_rows: int) -> list[Row] | None:
    """The rows of a catalogue, or None when it has more than max_rows. One job; nothing larger is moved."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def lookup_join(big: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that is normally small: broadcast if it is, a shuffle join with split
    partitions if it is not."""
    return big.join(lookup, list(on), how)


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, row_id: Sequence[str], parts: int = 64
) -> DataFrame:
    """The first n rows of each key. Up to GROUP_LIMIT rows a task sends n rows of a key at most; beyond
    that each key is ranked in parts first. order must end in a unique column."""
    salted = df.withColumn("part", F.pmod(F.xxhash64(*row_id), F.lit(parts)))
    for group in ([*keys, "part"], list(keys)) if n > GROUP_LIMIT else (list(keys),):
        window = Window.partitionBy(*group).orderBy(*order)
        salted = salted.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= n).drop("place")
    return salted.drop("part")
