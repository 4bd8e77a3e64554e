"""Dense word vectors from neighbour counts, trained on executors.

The counts become a sparse symmetric matrix of positive pointwise mutual information. Its leading singular
vectors are found by subspace iteration from random signs: a product of the matrix with one row per word, and an
orthonormal basis of the result, which comes from the Gram matrix of the rows, as wide as a vector.

Nearly every pair of neighbours has a frequent word. The HUBS most frequent words are numbered, and their rows, bounded by
that number, are broadcast in each round. Every word is stored with the numbers and values of its frequent neighbours, so
that a task makes its words' sums from the broadcast rows and what they add to the frequent words in total: no entry of
the matrix is sent. Only pairs of two rare words are joined. The vocabulary can be of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import materialize, small_batches
from .similarity import similar_words
from .skew import top_n_per_key

#: Numbers of a vector, further numbers of the iteration, rounds, and occurrences that a word needs.
DIM, EXTRA, ROUNDS, MIN_COUNT, SEED = 32, 8, 5, 5, 17
#: Words whose rows are broadcast, and entries of the matrix that are multiplied at once.
HUBS, STEP = 1 << 17, 1 << 15


def _both(pairs: DataFrame, one: list[Column], two: list[Column]) -> DataFrame:
    """Of every pair word <= neighbour the fields seen from either word; a word beside itself is seen once."""
    own, other = F.struct(*one), F.struct(*two)
    return pairs.select(F.inline(F.when(F.col("word") == F.col("neighbour"), F.array(own)).otherwise(F.array(own, other))))


def _words(pairs: DataFrame, min_count: int, hubs: int) -> DataFrame:
    """word, of_word, hub: the words with at least min_count neighbours, and the numbers of the most frequent ones."""
    counted = _both(pairs, [F.col("word"), F.col("n")], [F.col("neighbour").alias("word"), F.col("n")]).groupBy("word")
    of_word = materialize(counted.agg(F.sum("n").cast("double").alias("of_word")).filter(F.col("of_word") >= min_count))
    order = [F.desc("of_word"), F.col("word")]
    top = of_word.orderBy(*order).limit(hubs).select("word", (F.row_number().over(Window.orderBy(*order)) - 1).alias("hub"))
    return materialize(of_word.join(top, "word", "left"))


def mutual_information(neighbours: DataFrame, min_count: int = MIN_COUNT, hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """word, neighbour, hub, other, value: the positive logarithms of n x total / (n of word x n of neighbour), each
    pair once, word <= neighbour; hub and other are their numbers among the `hubs` most frequent words, or null. And
    those words: word, hub.

    neighbours has word, neighbour and n, both ways. Words with fewer than min_count neighbours are left out. Frequent
    words are looked up in a broadcast table; only pairs with a rare word are shuffled."""
    pairs = materialize(neighbours.filter("word <= neighbour").select("word", "neighbour", "n"))
    words = _words(pairs, min_count, hubs)
    near = words.toDF("neighbour", "of_neighbour", "other")
    frequent = words.filter("hub is not null")
    seen = pairs.join(F.broadcast(frequent), "word", "left").join(F.broadcast(near.filter("other is not null")), "neighbour", "left")
    some = seen.filter("hub is null or other is null").select("word", "neighbour", "n").join(words, "word").join(near, "neighbour")
    met = materialize(seen.filter("hub is not null and other is not null").unionByName(some))
    total = float(met.agg(F.sum(F.when(F.col("word") == F.col("neighbour"), F.col("n")).otherwise(2 * F.col("n")))).first()[0] or 0)
    value = F.log(F.col("n") * total / (F.col("of_word") * F.col("of_neighbour")))
    return met.select("word", "neighbour", "hub", "other", value.alias("value")).filter("value > 0"), frequent.select("word", "hub")


def _lists(matrix: DataFrame, frequent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frequent and the rare words of the matrix with their frequent neighbours (HUBS at most): word, hub, others,
    values, and word, others, values, mixed, which tells whether a rare word has rare neighbours."""
    columns = ["word", "hub", "other", "value"]
    back = [F.col(a).alias(b) for a, b in zip(["neighbour", "other", "hub", "value"], columns)]
    sides = _both(matrix, [F.col(c) for c in columns], back)
    entries = F.collect_list(F.when(F.col("other").isNotNull(), F.struct("other", "value"))).alias("entries")
    lists = [F.col("entries.other").alias("others"), F.col("entries.value").alias("values")]
    of_hub = sides.filter("hub is not null").select("hub", "other", "value").repartition("hub").groupBy("hub").agg(entries)
    of_rare = sides.filter("hub is null").repartition("word").groupBy("word").agg(entries, F.bool_or(F.col("other").isNull()).alias("mixed"))
    hubs = of_hub.join(F.broadcast(frequent), "hub").select("word", "hub", *lists)
    return materialize(hubs), materialize(of_rare.select("word", *lists, "mixed"))


def _names(width: int) -> list[str]:
    return [f"x{k}" for k in range(width)]


def _signs(word: Column, width: int, seed: int) -> list[Column]:
    """Random signs of a word, the same in every run."""
    return [(F.pmod(F.xxhash64(word, F.lit(seed), F.lit(k)), F.lit(2)) * 2 - 1).cast("double").alias(name) for k, name in enumerate(_names(width))]


def _numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(x).to_numpy() for x in names], axis=1)


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """The products of all pairs of columns: width x width numbers, summed in the tasks first."""
    names = _names(width)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            own = _numbers(batch, names)
            total += own.T @ own
        at = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "value"])

    summed = rows.select(*names).mapInArrow(part, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for at, value in summed:
        out[at] = value
    return out.reshape(width, width)


def _add(into: np.ndarray, at: np.ndarray, values: np.ndarray, rows: np.ndarray, picked: np.ndarray) -> None:
    """Add values x rows[picked] to the rows `at` (ascending) of into."""
    for low in range(0, len(at), STEP):
        part = slice(low, low + STEP)
        first = np.flatnonzero(np.diff(at[part], prepend=-1))
        into[at[part][first]] += np.add.reduceat(values[part, None] * rows[picked[part]], first, axis=0)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lists of a batch: the row, the frequent neighbour and the value of each entry."""
    lengths = np.diff(batch.column("others").offsets.to_numpy())
    return np.repeat(np.arange(len(batch)), lengths), *(batch.column(c).flatten().to_numpy() for c in ("others", "values"))


def _sums(lists: DataFrame, kept: list[str], shared, width: int) -> DataFrame:
    """The columns kept, and x...: the sum of every word over its frequent neighbours."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((len(batch), width))
            owner, other, value = _entries(batch)
            _add(sums, owner, value, shared.value[0], other)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(c) for c in sums.T]], names=[*kept, *_names(width)])

    schema = StructType([*[lists.schema[c] for c in kept], *[StructField(x, DoubleType()) for x in _names(width)]])
    return lists.select(*dict.fromkeys([*kept, "others", "values"])).mapInArrow(apply, schema)


def _given(rare: DataFrame, shared, width: int) -> DataFrame:
    """hub, x...: what the rare words of a task add to each of their frequent neighbours."""
    names = _names(width)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turn = shared.value
        given, seen = np.zeros((len(rows), width)), np.zeros(len(rows), bool)
        for batch in batches:
            owner, other, value = _entries(batch)
            order = np.argsort(other, kind="stable")
            _add(given, other[order], value[order], _numbers(batch, names) @ turn, owner[order])
            seen[other] = True
        found = np.flatnonzero(seen)
        for low in range(0, len(found), STEP):
            at = found[low : low + STEP]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(c) for c in given[at].T]], names=["hub", *names])

    schema = StructType([StructField("hub", IntegerType()), *[StructField(x, DoubleType()) for x in names]])
    return rare.select("others", "values", *names).mapInArrow(apply, schema)


def _hub_rows(sums: DataFrame, count: int, width: int) -> np.ndarray:
    """The rows of the frequent words, from (hub, x...) summed by hub: count x width numbers at most."""
    found = sums.groupBy("hub").agg(*[F.sum(x).alias(x) for x in _names(width)]).toArrow()
    out = np.zeros((count, width))
    out[found.column("hub").to_numpy()] = np.stack([found.column(x).to_numpy() for x in _names(width)], axis=1)
    return out


def _product(hubs: DataFrame, rest: DataFrame | None, rare: DataFrame, hub_rows: np.ndarray, turn: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """matrix x rows x turn, for the rows of the rare words, which come with their lists, and of the frequent ones.
    rest has the entries of two rare words, both ways."""
    width = hub_rows.shape[1]
    names = _names(width)
    shared = rare.sparkSession.sparkContext.broadcast((hub_rows @ turn, turn))
    own = materialize(_sums(rare, ["word", "others", "values", "mixed"], shared, width))
    sums = _sums(hubs, ["hub"], shared, width).unionByName(_given(rare, shared, width))
    hub_sums = _hub_rows(sums, len(hub_rows), width)
    shared.unpersist()
    if rest is None:
        return own, hub_sums
    given = rare.filter("mixed").select(F.col("word").alias("neighbour"), *names)
    more = _turned(rest.join(given, "neighbour").groupBy("word").agg(*[F.sum(F.col("value") * F.col(x)).alias(x) for x in names]), turn)
    added = own.filter("mixed").join(more.toDF("word", *[f"more_{x}" for x in names]), "word", "left")
    both = [(F.col(x) + F.coalesce(f"more_{x}", F.lit(0.0))).alias(x) for x in names]
    return own.filter("not mixed").unionByName(materialize(added.select("word", "others", "values", "mixed", *both))), hub_sums


def _named(hubs: DataFrame, rows: np.ndarray) -> DataFrame:
    """word, x...: the rows of the frequent words."""
    names = _names(rows.shape[1])
    shared = hubs.sparkSession.sparkContext.broadcast(rows)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value[batch.column("hub").to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), *[pa.array(c) for c in own.T]], names=["word", *names])

    schema = StructType([hubs.schema["word"], *[StructField(x, DoubleType()) for x in names]])
    return hubs.select("word", "hub").mapInArrow(apply, schema)


def _turned(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """Every row times the small matrix `turn`."""
    names, out = _names(turn.shape[0]), _names(turn.shape[1])
    schema = StructType([rows.schema["word"], *[StructField(x, DoubleType()) for x in out]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _numbers(batch, names) @ turn
            yield pa.RecordBatch.from_arrays([batch.column("word"), *[pa.array(c) for c in own.T]], names=["word", *out])

    return rows.select("word", *names).mapInArrow(apply, schema)


def _basis(product: np.ndarray, power: float) -> np.ndarray:
    """From a Gram matrix the turn that makes its rows' columns orthogonal, the longest first, scaled by their
    length to the given power; columns of no length stay zero."""
    length2, axes = np.linalg.eigh(product)
    length2, axes = length2[::-1], axes[:, ::-1]
    real = length2 > 1e-12 * max(float(length2[0]), 1e-300)
    scale = np.where(real, np.maximum(length2, 1e-300) ** (power / 2), 0.0)
    return axes * scale


def word_vectors(neighbours: DataFrame, dim: int = DIM, extra: int = EXTRA, rounds: int = ROUNDS, min_count: int = MIN_COUNT, seed: int = SEED) -> DataFrame:
    """word, vector: for every word its coordinates along the dim leading singular vectors, times the roots of their values.

    Each round writes the rows of the rare words once, dim + extra numbers each. No neighbours, no vectors."""
    width = dim + extra
    names = _names(width)
    small_batches(neighbours.sparkSession)
    matrix, frequent = mutual_information(neighbours, min_count, HUBS)
    hubs, rare = _lists(matrix, frequent)
    pairs = _both(matrix.filter("hub is null and other is null"), [F.col(c) for c in ("word", "neighbour", "value")], [F.col("neighbour").alias("word"), F.col("word").alias("neighbour"), F.col("value")])
    rest = None if rare.filter("mixed").isEmpty() else materialize(pairs)
    signs = _signs(F.col("word"), width, seed)
    rare = rare.select("*", *signs)
    count = (hubs.agg(F.max("hub")).first()[0] or 0) + 1
    hub_rows, turn = _hub_rows(hubs.select("hub", *signs), count, width), np.eye(width)
    for k in range(rounds + 1):
        rare, hub_rows = _product(hubs, rest, rare, hub_rows, turn)
        # orthonormal columns; in the end the columns' lengths are the singular values, and what is left of them is their root
        turn = _basis(gram(rare, width) + hub_rows.T @ hub_rows, -1.0 if k < rounds else -0.5)
    rows = _turned(rare.select("word", *names), turn[:, :dim]).unionByName(_named(hubs, hub_rows @ turn[:, :dim]))
    return materialize(rows.select("word", F.array(*_names(dim)).alias("vector")))


def trained_synonyms(vectors: DataFrame, criteria: DataFrame, top: int = 10) -> DataFrame:
    """criteria, similar_word, max_w2v_score: the words whose vectors are most like a criterion's.

    criteria has a column criteria. Each task compares its words with all criteria and ranks them, so that top words per
    criterion leave it. A criterion without a vector has no synonyms."""
    wanted = criteria.select(F.col("criteria").alias("word")).distinct().join(vectors, "word")
    catalogue = wanted.select(F.col("word").alias("word_no"), "vector")
    hits = similar_words(vectors, catalogue, 0.0, keep=("word",)).filter(F.col("word") != F.col("word_no"))
    scored = hits.select(F.col("word_no").alias("criteria"), F.col("word").alias("similar_word"), F.round("similarity", 6).alias("max_w2v_score"))
    return top_n_per_key(scored, ["criteria"], [F.desc("max_w2v_score"), F.col("similar_word")], top, ["similar_word"])
