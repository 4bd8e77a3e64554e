"""Similarity join of text vectors with attribute-word vectors.

The word side is a catalogue. While it is within the bound it becomes one numpy matrix that every
task holds, and a batch of texts is compared with all words in one product: no shuffle, and only
the hits (or their totals) leave the task. Beyond the bounds in words and bytes `large_catalogue` takes over, where neither
the driver nor a task holds the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..fixed_values import MATCH_THRESHOLD, MENTION_THRESHOLD
from .large_catalogue import PRODUCT, large_mention_scores, large_similar_totals, large_similar_words, over, unit_rows, vector_matrix
from .skew import bounded_rows, lookup_join

#: Words, and bytes of their vectors, up to which every task holds the catalogue.
MAX_WORDS, MAX_BYTES = 50_000, 64 << 20
#: Digits of a similarity that do not depend on the order in which its products are summed.
DIGITS = 12
WORD_FIELDS = "word_no long, criteria string, word string, weight double, vector array<double>"


def word_lookup(words: DataFrame, score: str | None = None, shared_words: str = "last") -> DataFrame:
    """word_no, criteria, word, weight: every catalogue row with the criteria it is credited to.

    words has word_no (catalogue order), criteria, similar_word and maybe a score column, whose name
    contains w2v and score. With "last" a word listed under several criteria is credited to the last;
    with "each" every row keeps its own criteria. Rows of a word that is listed twice both stay.
    """
    score = score or score_column(words)
    weight = F.col(score).cast("double") if score else F.lit(1.0)
    rows = words.select("word_no", "criteria", F.col("similar_word").alias("word"), weight.alias("weight"))
    keys = ["word"] if shared_words == "last" else ["word", "criteria"]
    last = F.max_by(F.struct("criteria", "weight"), "word_no").over(Window.partitionBy(*keys))
    found = rows.select("word_no", "word", last.alias("last"))
    return found.select("word_no", F.col("last.criteria").alias("criteria"), "word", F.col("last.weight").alias("weight"))


def score_column(df: DataFrame) -> str | None:
    return next((c for c in df.columns if "w2v" in c.lower() and "score" in c.lower()), None)


def _hits(texts: DataFrame, vector: str, keep: list[str], words: pd.DataFrame, number: DataType, threshold: float, inclusive: bool) -> DataFrame:
    matrix = unit_rows(np.stack(words["vector"].to_list()).astype(np.float64))
    numbers = words["word_no"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast((matrix, numbers))

    kind = to_arrow_type(number)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_words, word_no = shared.value
        for batch in _slices(batches, len(unit_words)):
            sims = vector_matrix(batch.column(vector)) @ unit_words.T
            text_at, word_at = np.nonzero(over(sims, threshold, inclusive))
            kept = [batch.column(c).take(pa.array(text_at)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(word_no[word_at], kind), pa.array(sims[text_at, word_at])], [*keep, "word_no", "similarity"]
            )

    schema = texts.select(*keep).schema.add("word_no", number).add("similarity", "double")
    return texts.select(*keep, vector).filter(F.col(vector).isNotNull()).mapInArrow(score, schema)


def _totals(texts: DataFrame, vector: str, keep: list[str], words: pd.DataFrame, threshold: float) -> DataFrame:
    matrix = unit_rows(np.stack(words["vector"].to_list()).astype(np.float64))
    groups, group_of = np.unique(words["criteria"].to_numpy(dtype=str), return_inverse=True)
    member = (group_of[:, None] == np.arange(len(groups))[None, :]).astype(np.float64)
    shared = texts.sparkSession.sparkContext.broadcast((matrix, member, words["weight"].to_numpy(), groups))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_words, of_group, weight, names = shared.value
        for batch in _slices(batches, len(unit_words)):
            sims = vector_matrix(batch.column(vector)) @ unit_words.T
            hit = over(sims, threshold, False)
            counts = hit.astype(np.float64) @ of_group
            sums = np.where(hit, sims * weight, 0.0) @ of_group
            text_at, group_at = np.nonzero(counts)
            kept = [batch.column(c).take(pa.array(text_at)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(names[group_at].tolist(), pa.string()),
                    pa.array(counts[text_at, group_at].astype(np.int64)),
                    pa.array(sums[text_at, group_at]),
                ],
                [*keep, "criteria", "words", "score"],
            )

    schema = texts.select(*keep).schema.add("criteria", "string").add("words", "long").add("score", "double")
    return texts.select(*keep, vector).filter(F.col(vector).isNotNull()).mapInArrow(score, schema)


def _slices(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a product has PRODUCT numbers at most."""
    step = max(1, PRODUCT // max(1, words))
    for batch in batches:
        for low in range(0, len(batch), step):
            yield batch.slice(low, step)


def _held(catalogue: DataFrame, max_words: int, max_bytes: int) -> pd.DataFrame | None:
    """The words as one table, or None beyond a bound. A vector's length is that of the first one; one read tells both."""
    size = F.size("vector").cast("long")
    within = catalogue.filter("vector IS NOT NULL").limit(max_words + 1).withColumn("bytes", F.sum(8 * size).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, 0)))
    rows = bounded_rows(within.filter(F.col("bytes") <= max_bytes + 8 * size), max_words)
    if rows is None or sum(8 * len(r["vector"]) for r in rows) > max_bytes:
        return None
    return pd.DataFrame(rows, columns=[*catalogue.columns, "bytes"])


def similar_words(
    texts: DataFrame,
    words: DataFrame,
    threshold: float = MENTION_THRESHOLD,
    inclusive: bool = False,
    vector: str = "vector",
    keep: tuple[str, ...] = ("issue_id",),
    max_words: int = MAX_WORDS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """keep..., word_no, similarity: the pairs above the threshold. words has word_no and vector."""
    keep = list(keep)
    catalogue = words.select("word_no", F.col("vector").cast("array<double>").alias("vector"))
    held = _held(catalogue, max_words, max_bytes)
    if held is None:
        return large_similar_words(texts, catalogue, threshold, inclusive, vector, tuple(keep))
    number = catalogue.schema["word_no"].dataType
    if held.empty:
        return texts.select(*keep, F.lit(None).cast(number).alias("word_no"), F.lit(0.0).alias("similarity")).limit(0)
    return _hits(texts, vector, keep, held, number, threshold, inclusive)


def similar_totals(
    texts: DataFrame,
    words: DataFrame,
    threshold: float = MENTION_THRESHOLD,
    inclusive: bool = False,
    vector: str = "vector",
    keep: tuple[str, ...] = ("issue_id",),
    max_words: int = MAX_WORDS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """keep..., words, best, total: per value of keep the number of the pairs of similar_words, the highest and the sum of their similarities."""
    keep = list(keep)
    catalogue = words.select("word_no", F.col("vector").cast("array<double>").alias("vector"))
    held = _held(catalogue, max_words, max_bytes)
    if held is None:
        found = large_similar_totals(texts, catalogue, threshold, inclusive, vector, tuple(keep))
    else:
        found = similar_words(texts, words, threshold, inclusive, vector, tuple(keep), max_words, max_bytes).select(
            *keep, F.lit(1).cast("long").alias("words"), F.col("similarity").alias("best"), F.col("similarity").alias("total")
        )
    return found.groupBy(*keep).agg(F.sum("words").alias("words"), F.max("best").alias("best"), F.sum("total").alias("total"))


def mention_scores(
    texts: DataFrame,
    words: DataFrame,
    threshold: float = MENTION_THRESHOLD,
    vector: str = "vector",
    keep: tuple[str, ...] = ("issue_id",),
    max_words: int = MAX_WORDS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """keep..., criteria, words, score: per text and criteria the number of similar words and the sum
    of similarity times weight. words has word_no, criteria, weight and vector.

    The sums are made where the batch is compared, so a text sends one row per criteria even when
    nearly every word is above the threshold.
    """
    keep = list(keep)
    catalogue = words.select("word_no", "criteria", "weight", F.col("vector").cast("array<double>").alias("vector"))
    held = _held(catalogue, max_words, max_bytes)
    if held is None:
        return large_mention_scores(texts, catalogue, threshold, vector, tuple(keep))
    if held.empty:
        return texts.select(*keep, F.lit("").alias("criteria"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("score")).limit(0)
    return _totals(texts, vector, keep, held, threshold)


def matched_words(hits: DataFrame, words: DataFrame, keep: tuple[str, ...] = ("issue_id",)) -> DataFrame:
    """keep..., criteria, matched: the similar words with their weighted scores, in catalogue order.
    A list is never longer than the criteria's part of the catalogue."""
    named = lookup_join(hits, words.select("word_no", "criteria", "word", "weight"), ["word_no"], "inner")
    entry = F.struct("word_no", "word", (F.col("similarity") * F.col("weight")).alias("score"))
    return named.groupBy(*keep, "criteria").agg(F.array_sort(F.collect_list(entry)).alias("matched"))


def signed(score: Column | str, sentiment: Column | str) -> Column:
    """score with the sign of the sentiment. All words of a text share its sentiment, so the sum of
    their signed scores is their summed score with one sign."""
    value = F.col(score) if isinstance(score, str) else score
    return F.when((F.col(sentiment) if isinstance(sentiment, str) else sentiment) == "+", value).otherwise(-value)


def mentions_of(totals: DataFrame, threshold: float = MENTION_THRESHOLD, total: str = "total") -> DataFrame:
    """Put semantic and similarity_score in place of the signed total: its sign, '-' for 0, and its
    size. Totals of at most the threshold drop out."""
    return (
        totals.withColumn("semantic", F.when(F.col(total) > 0, F.lit("+")).otherwise(F.lit("-")))
        .withColumn("similarity_score", F.abs(total))
        .filter(F.col("similarity_score") > threshold)
        .drop(total)
    )


def attribute_matches(
    texts: DataFrame,
    attributes: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    vector: str = "vector",
    keep: tuple[str, ...] = ("issue_id", "project_id"),
    **bounds: int,
) -> DataFrame:
    """keep..., attribute, similarity_score: attributes whose definition is at least threshold similar
    to the text, rounded to 4. attributes has word_no, attribute and vector.

    A similarity is the sum of products of rounded numbers, so that 0.3 may come as 0.29999999999999993, by the order of
    the sum. It is taken to DIGITS digits first: what lies on the threshold or halfway between two scores does not depend on that."""
    hits = similar_words(texts, attributes, threshold - 10.0**-DIGITS, True, vector, keep, **bounds)
    near = hits.withColumn("similarity", F.round("similarity", DIGITS)).filter(F.col("similarity") >= threshold)
    named = lookup_join(near, attributes.select("word_no", "attribute"), ["word_no"], "inner")
    return named.select(*keep, "attribute", F.round("similarity", 4).alias("similarity_score"))


def mean_vector(df: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """keys..., vector: the mean per position. Sums are made before the shuffle, one row per key,
    position and task, so a hot key stays cheap."""
    positions = df.select(*keys, F.posexplode(vector).alias("position", "value"))
    means = positions.groupBy(*keys, "position").agg(F.avg(F.col("value").cast("double")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "value")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda p: p["value"]).alias("vector"))
