"""Reports over stored mentions and over the corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_issue_text
from ..operators.scoring import clean_words
from ..operators.skew import lookup_join, top_n_per_key
from ..operators.summaries import histogram, sentiment_table, value_counts
from ..session import materialize, small_batches

#: Words whose pairs a task counts at once.
PAIR_WORDS = 1 << 20


def chart_tables(mentions: DataFrame) -> dict[str, DataFrame]:
    """The four summaries: top criteria, their sentiment, score histogram, top projects."""
    return {
        "top_criteria": value_counts(mentions, "criteria", 15),
        "sentiment": sentiment_table(mentions, 5),
        "scores": histogram(mentions, "similarity_score", 20),
        "top_projects": value_counts(mentions, "project_id", 10),
    }


def criteria_report(mentions: DataFrame, examples: int = 3) -> DataFrame:
    """criteria, mentions, positive_share, examples: the contexts of the strongest mentions.

    mentions has criteria, semantic, similarity_score, issue_id and context.
    """
    counted = mentions.groupBy("criteria").agg(
        F.count("*").alias("mentions"),
        (F.count_if(F.col("semantic") == "+") / F.count("*")).alias("positive_share"),
    )
    order = [F.desc("similarity_score"), F.col("issue_id")]
    best = top_n_per_key(
        mentions.select("criteria", "similarity_score", "issue_id", "context"), ["criteria"], order, examples, ["issue_id"]
    )
    entries = F.array_sort(F.collect_list(F.struct((-F.col("similarity_score")).alias("s"), "issue_id", "context")))
    listed = best.groupBy("criteria").agg(F.transform(entries, lambda e: e["context"]).alias("examples"))
    return counted.join(listed, "criteria", "left")


def content_words(df: DataFrame, stop_words: Sequence[str], text: str = "text") -> DataFrame:
    """Add tokens: the cleaned text's words without stop words."""
    words = F.split(clean_issue_text(text), " ")
    return df.withColumn("tokens", F.filter(words, lambda w: (w != "") & ~w.isin(list(stop_words))))


def neighbour_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """word, neighbour, n: how often a word stands next to another, either side.

    Pairs are counted in the task before the shuffle, so frequent pairs stay cheap.
    """
    words = F.col(tokens)
    following = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    pair = F.zip_with(before, following, lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(1).cast("long").alias("n")))
    return _both_ways(df.select(F.inline(pair)))


def text_neighbours(df: DataFrame, stop_words: Sequence[str], text: str = "text") -> DataFrame:
    """The neighbour_counts of the content_words of texts, in one pass over the texts: a task names the words of some
    PAIR_WORDS by number, counts their pairs as numbers and sends each pair once."""
    small_batches(df.sparkSession)
    left_out = frozenset(w.encode() for w in stop_words)

    def counted(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        named = pa.array([w for row in rows for w in row], pa.binary()).dictionary_encode()
        order = pc.sort_indices(named.dictionary)
        names = named.dictionary.take(order)
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(len(names))
        flat = place[named.indices.to_numpy()]
        ends = np.cumsum([len(row) for row in rows])[:-1]  # the last word of a text and the first of the next are no pair
        one, two = np.delete(flat[:-1], ends - 1), np.delete(flat[1:], ends - 1)
        pairs, n = np.unique(np.minimum(one, two) * len(names) + np.maximum(one, two), return_counts=True)
        words = names.cast(pa.string())
        for low in range(0, len(pairs), 1 << 16):
            part = pairs[low : low + (1 << 16)]
            sides = [words.take(pa.array(part // len(names))), words.take(pa.array(part % len(names)))]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(n[low : low + (1 << 16)])], names=["a", "b", "n"])

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for found in batch.column(0).to_pylist():
                row = [w for w in clean_words(found or "") if w not in left_out]
                if len(row) > 1:
                    rows.append(row)
                    held += len(row)
                if held >= PAIR_WORDS:
                    yield from counted(rows)
                    rows, held = [], 0
        if rows:
            yield from counted(rows)

    return _both_ways(df.select(text).mapInArrow(pairs_of, "a string, b string, n long"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """word, neighbour, n from counted pairs a <= b: a pair is summed once and then stands for both its words."""
    met = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("neighbour"), (F.col("n") * 2).alias("n")))
    two = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("neighbour"), "n"), F.struct(F.col("b").alias("word"), F.col("a").alias("neighbour"), "n"))
    return met.select(F.inline(F.when(F.col("a") == F.col("b"), own).otherwise(two)))


def synonyms(neighbours: DataFrame, criteria: DataFrame, top: int = 10) -> DataFrame:
    """criteria, similar_word, max_w2v_score: the words whose neighbours are most like a criterion's.

    A word's vector is its neighbour counts; the score is the cosine. Only words that share a
    neighbour with a criterion get a product, found by an equality join on the neighbour. The counts
    are written once, as four steps read them, and those of the criteria, so that Spark knows how few they are.
    """
    neighbours = materialize(neighbours)
    lengths = neighbours.groupBy("word").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    wanted = lookup_join(neighbours, criteria.select(F.col("criteria").alias("word")).distinct(), ["word"])
    left = materialize(wanted.select(F.col("word").alias("criteria"), "neighbour", F.col("n").alias("m")))
    shared = lookup_join(neighbours, left, ["neighbour"], "inner")
    dots = shared.groupBy("criteria", "word").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    of_criteria = lengths.select(F.col("word").alias("criteria"), F.col("length").alias("criteria_length"))
    scored = (
        dots.filter(F.col("criteria") != F.col("word"))
        .join(lengths, "word")
        .join(of_criteria, "criteria")
        .select(
            "criteria",
            F.col("word").alias("similar_word"),
            F.round(F.col("dot") / (F.col("length") * F.col("criteria_length")), 6).alias("max_w2v_score"),
        )
    )
    return top_n_per_key(scored, ["criteria"], [F.desc("max_w2v_score"), F.col("similar_word")], top, ["similar_word"])


def daily_mentions(mentions: DataFrame, criteria: str = "criteria", time: str = "created_at") -> DataFrame:
    """day, criteria, mentions."""
    day = F.window(time, "1 day")
    return mentions.groupBy(day.alias("w"), criteria).agg(F.count("*").alias("mentions")).select(
        F.col("w.start").alias("day"), criteria, "mentions"
    )


def alerts(daily: DataFrame, limit: int) -> DataFrame:
    """Days on which a criterion has more than limit mentions."""
    return daily.filter(F.col("mentions") > limit)
