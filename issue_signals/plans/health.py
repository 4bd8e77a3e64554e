"""The health of criteria over time: daily partials that each run of new mentions adds to, and the report on them.

A partial is one row per day and criterion (HEALTH), in a bucketed table dealt by day. A run reads and writes the buckets of
the days that its mentions fall on, so a late mention changes its own day and no other, whatever the table's age.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..sources.buckets import BUCKETS, merge_into, read_met

HEALTH = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("criteria", T.StringType()),
        T.StructField("mentions", T.LongType()),
        T.StructField("positive", T.LongType()),
        T.StructField("scored", T.LongType()),
        T.StructField("score_sum", T.DecimalType(38, 6)),
    ]
)
KEYS = ("day", "criteria")


def daily_partials(mentions: DataFrame) -> DataFrame:
    """HEALTH rows of mentions with criteria, created_at, semantic ("+" is positive) and similarity_score.

    Scores are summed as decimals of six places, so that the sum does not depend on the order or on how the mentions came
    in runs; NULL, NaN and infinite scores are in mentions, not in scored. NULL criteria and times are a key like any other."""
    score = F.col("similarity_score").try_cast("decimal(28,6)")
    return mentions.groupBy(F.to_date("created_at").alias("day"), "criteria").agg(
        F.count("*").alias("mentions"),
        F.count_if(F.col("semantic") == "+").alias("positive"),
        F.count(score).alias("scored"),
        F.coalesce(F.sum(score), F.lit(0)).cast("decimal(38,6)").alias("score_sum"),
    )


def add_mentions(mentions: DataFrame, path: str, run: int, buckets: int = BUCKETS) -> list[int]:
    """Add a run of new mentions to the table; returns the buckets that were written.

    The run reads the table as it was after `run` runs, so that a run that is repeated adds its mentions once."""
    new = materialize(daily_partials(mentions))
    stored = read_met(new, path, run, HEALTH, ["day"], buckets)
    met = stored.join(new.select(*KEYS), _same(stored, new), "left_semi")
    sums = [F.sum(c).cast(HEALTH[c].dataType).alias(c) for c in HEALTH.names[2:]]
    return merge_into(new.unionByName(met).groupBy(*KEYS).agg(*sums), path, run, KEYS, [F.desc("mentions")], HEALTH, ["day"], buckets)


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["day"].eqNullSafe(right["day"]) & left["criteria"].eqNullSafe(right["criteria"])


def criteria_health(partials: DataFrame, days: int = 7) -> DataFrame:
    """One row per criterion and day, from the first day of the table to its last, days without mentions included.

    day, criteria, mentions, mean_score (NULL without scores), recent (mentions of the last `days` days), recent_positive_share,
    preceding (mentions of the `days` days before them) and change (recent / preceding - 1; NULL if nothing preceded). For
    the first days both periods are as long as the table reaches back. Mentions without a time have no day and are left out.
    An empty table gives no rows."""
    dated = partials.filter(F.col("day").isNotNull())
    first, last = dated.agg(F.min("day")).scalar(), dated.agg(F.max("day")).scalar()
    every = dated.select("criteria").distinct().select(F.explode(F.sequence(first, last)).alias("day"), "criteria")
    gaps = every.select("*", *[F.lit(0).cast(HEALTH[c].dataType).alias(c) for c in HEALTH.names[2:]])
    filled = dated.unionByName(gaps).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in HEALTH.names[2:]])
    by = Window.partitionBy("criteria").orderBy("day")
    recent, preceding = by.rowsBetween(1 - days, 0), by.rowsBetween(1 - 2 * days, -days)
    windows = filled.select(
        "*",
        F.sum("mentions").over(recent).alias("recent"),
        F.sum("positive").over(recent).alias("recent_positive"),
        F.coalesce(F.sum("mentions").over(preceding), F.lit(0)).alias("preceding"),
    )
    return windows.select(
        "day",
        "criteria",
        "mentions",
        F.when(F.col("scored") > 0, F.col("score_sum").cast("double") / F.col("scored")).alias("mean_score"),
        "recent",
        F.when(F.col("recent") > 0, F.col("recent_positive") / F.col("recent")).alias("recent_positive_share"),
        "preceding",
        F.when(F.col("preceding") > 0, F.col("recent") / F.col("preceding") - 1).alias("change"),
    )
