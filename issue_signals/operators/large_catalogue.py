"""Similarity join with a catalogue that no task and no driver can hold.

All similarities above a threshold are found exactly; what cannot reach it is not compared. The words are
gathered in cells, each around a pivot word, and a cell is known by its pivot and by the angle of its
farthest word. A text can only have hits in a cell if its angle to the pivot is at most that angle and
the angle of the threshold together (the triangle inequality of angles). Cells that lie near to each other fill a
shard up to a bound in bytes. A text is sent to the shards of the cells that it can hit, where the
shard's words come first and the texts follow in batches, one matrix product each.

The driver holds the pivots (CELLS words at most), one row of numbers per cell, and one count per shard; words and texts
move between executors only. A shard that a large share of the texts can hit is given to several tasks, and a cell larger
than a shard is cut by hash. A threshold of 0 or less prunes nothing: every text meets every shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: Pivots; bytes of a shard's matrix; texts of a shard that go to one task; numbers in one product.
CELLS, SHARD_BYTES, TASK_TEXTS, PRODUCT = 1_024, 64 << 20, 100_000, 1 << 22
_SLACK = 1e-6


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def vector_matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as rows of length 1; a zero vector stays zero."""
    if not len(column):
        return np.zeros((0, 0))
    return unit_rows(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def over(sims: np.ndarray, threshold: float, inclusive: bool) -> np.ndarray:
    return sims >= threshold if inclusive else sims > threshold


@dataclass(frozen=True)
class Catalogue:
    """Words with cell and shard in the shared folder, and the map of the cells."""

    words: DataFrame
    pivots: np.ndarray
    #: By cell: the angle of its farthest word, and its shards as (first, how many).
    angles: np.ndarray
    shards: list[tuple[int, int]]

    @property
    def shard_count(self) -> int:
        return max((first + count for first, count in self.shards), default=0)

    def reached(self, vectors: np.ndarray, threshold: float) -> np.ndarray:
        """For each vector (of length 1 or zero) and shard, whether the shard can hold a hit."""
        if threshold <= 0 or not self.shards:
            return np.ones((len(vectors), self.shard_count), bool)
        apart = np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))
        near = apart <= self.angles + np.arccos(min(threshold, 1.0)) + _SLACK
        out = np.zeros((len(vectors), self.shard_count), bool)
        for cell, (first, count) in enumerate(self.shards):
            out[:, first : first + count] |= near[:, cell : cell + 1]
        return out & (np.abs(vectors).max(axis=1, initial=0) > 0)[:, None]


def _packed(pivots: np.ndarray, sizes: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Shards for cells of these sizes, in the order of the pivots along their main axis."""
    if not len(pivots):
        return []
    axis = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0]
    out: list[tuple[int, int]] = [(0, 1)] * len(pivots)
    shard = used = 0
    for cell in np.argsort(pivots @ axis, kind="stable").tolist():
        size = int(sizes[cell])
        if used and used + size > capacity:
            shard, used = shard + 1, 0
        pieces = max(1, -(-size // capacity))
        out[cell] = (shard, pieces)
        used += size
        if pieces > 1:
            shard, used = shard + pieces, 0
    return out


def prepared(words: DataFrame, cells: int | None = None, shard_bytes: int | None = None) -> Catalogue:
    """A catalogue of words (word_no, vector and what is to be kept), written once with cell and shard.

    Pivots are the words with the smallest hashed numbers. Rows without a vector are left out."""
    spark = words.sparkSession
    cells, shard_bytes = cells or CELLS, shard_bytes or SHARD_BYTES
    words = materialize(words.filter("vector IS NOT NULL"))
    chosen = words.select("word_no", "vector").orderBy(F.xxhash64("word_no"), "word_no").limit(cells).toArrow()
    pivots = np.unique(vector_matrix(chosen.column("vector").combine_chunks()), axis=0) if len(chosen) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(pivots)
    schema = T.StructType([*words.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vector_matrix(batch.column("vector"))
            step = max(1, PRODUCT // max(1, len(shared.value)))
            for low in range(0, len(batch), step):
                sims = vectors[low : low + step] @ shared.value.T
                cell = sims.argmax(axis=1)
                near = sims[np.arange(len(sims)), cell]
                part = batch.slice(low, step)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=schema.names)

    dealt = materialize(words.mapInArrow(assign, schema))
    counted = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # a row per cell
    sizes, angles = np.zeros(len(pivots), np.int64), np.full(len(pivots), -4.0)  # no text reaches an empty cell
    for cell, n, near in counted:
        sizes[cell], angles[cell] = n, np.arccos(np.clip(near, -1, 1))
    capacity = max(1, shard_bytes // (8 * max(1, pivots.shape[1])))
    shards = _packed(pivots, sizes, capacity)
    # a row per cell, no more than CELLS of them
    place = spark.createDataFrame([(k, *s) for k, s in enumerate(shards)], "cell int, first int, pieces int")
    dealt = dealt.join(F.broadcast(place), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("word_no"), "pieces").cast("int"))
    return Catalogue(dealt.drop("cell", "near", "first", "pieces"), pivots, angles, shards)


def _numbered(texts: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """The texts with a vector, each with a number (text_row), written once as their vectors are read twice."""
    rows = texts.select(F.struct(*keep).alias("kept"), F.col(vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    return materialize(rows.withColumn("text_row", F.monotonically_increasing_id()))


def _met(numbered: DataFrame, catalogue: Catalogue, threshold: float, extra: list[str]) -> DataFrame:
    """Words (with the columns extra) and texts by shard and part: part by part the words first (text_row NULL)."""
    spark = numbered.sparkSession
    shared = spark.sparkContext.broadcast((catalogue.pivots, catalogue.angles, catalogue.shards))

    def reached(vectors: np.ndarray) -> np.ndarray:
        return Catalogue(None, *shared.value).reached(vectors, threshold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(catalogue_shards, np.int64)
        for batch in batches:
            total += reached(vector_matrix(batch.column("vector"))).sum(axis=0) if len(batch) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["shard", "n"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                text, shard = np.nonzero(reached(vector_matrix(batch.column("vector"))))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), batch.column("text_row").take(take), batch.column("vector").take(take)], names=["shard", "text_row", "vector"]
                )

    catalogue_shards = catalogue.shard_count
    narrow = numbered.select("text_row", "vector")
    counts = narrow.mapInArrow(count, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row per shard
    parts = spark.createDataFrame([(s, max(1, -(-n // TASK_TEXTS))) for s, n in counts], "shard int, parts int")
    sent = narrow.mapInArrow(send, "shard int, text_row long, vector array<double>").join(F.broadcast(parts), "shard")
    sent = sent.select("shard", F.pmod(F.xxhash64("text_row"), "parts").cast("int").alias("part"), "text_row", "vector")
    given = catalogue.words.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    given = given.select("shard", "part", F.lit(None).cast("long").alias("text_row"), F.col("vector").cast("array<double>").alias("vector"), *extra)
    both = given.unionByName(sent, allowMissingColumns=True)
    return both.repartition("shard", "part").sortWithinPartitions("shard", "part", "text_row")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, their matrix, texts' numbers, texts' matrix) for slices of the texts of each shard and part."""
    at, held, words, matrix = None, [], None, None
    for batch in batches:
        shard, part = (batch.column(c).to_numpy() for c in ("shard", "part"))
        is_text = batch.column("text_row").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (is_text[1:] != is_text[:-1])) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
            if low == high:
                continue
            if at != (shard[low], part[low]):
                at, held, words, matrix = (shard[low], part[low]), [], None, None
            piece = batch.slice(low, high - low)
            if not is_text[low]:
                held.append(piece)
                continue
            if words is None:
                words = pa.concat_batches(held)
                matrix = vector_matrix(words.column("vector"))
            step = max(1, PRODUCT // len(words))
            for start in range(0, len(piece), step):
                texts = piece.slice(start, step)
                yield words, matrix, texts.column("text_row").to_numpy(), vector_matrix(texts.column("vector"))


def large_similar_words(
    texts: DataFrame, words: DataFrame, threshold: float, inclusive: bool = False, vector: str = "vector", keep: tuple[str, ...] = ("issue_id",), **sizes: int
) -> DataFrame:
    """keep..., word_no, similarity: the pairs above the threshold. words has word_no and vector."""
    catalogue = prepared(words.select("word_no", "vector"), **sizes)
    numbered = _numbered(texts, vector, list(keep))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, matrix, rows, vectors in _groups(batches):
            sims = vectors @ matrix.T
            text_at, word_at = np.nonzero(over(sims, threshold, inclusive))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[text_at]), given.column("word_no").take(pa.array(word_at)), pa.array(sims[text_at, word_at])], names=["text_row", "word_no", "similarity"]
            )

    schema = words.select(F.lit(0).cast("long").alias("text_row"), "word_no", F.lit(0.0).alias("similarity")).schema
    hits = _met(numbered, catalogue, threshold, ["word_no"]).mapInArrow(score, schema)
    return hits.join(numbered.select("text_row", "kept"), "text_row").select("kept.*", "word_no", "similarity")


def _classes(words: DataFrame) -> DataFrame:
    """word_no, vector, copies: each vector of words once, with a number of its own and how many words have it.

    Vectors are grouped as bytes, which are hashed; arrays would be sorted."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                counts = Counter(row.tobytes() for row in rows)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()))], names=["key", "n"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            ends = np.cumsum([0, *(len(k) // 8 for k in keys)], dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(keys))))
            yield pa.RecordBatch.from_arrays([batch.column("word_no"), vectors, batch.column("copies")], names=["word_no", "vector", "copies"])

    found = words.filter("vector IS NOT NULL").select(F.col("vector").cast("array<double>").alias("vector")).mapInArrow(packed, "key binary, n long")
    counted = found.groupBy("key").agg(F.sum("n").alias("copies")).select(F.xxhash64("key").alias("word_no"), "key", "copies")
    return counted.mapInArrow(unpacked, "word_no long, vector array<double>, copies long")


def large_similar_totals(texts: DataFrame, words: DataFrame, threshold: float, inclusive: bool = False, vector: str = "vector", keep: tuple[str, ...] = ("issue_id",), **sizes: int) -> DataFrame:
    """keep..., words, best, total: per text with hits their number, the highest and the sum of their similarities.

    Words with the same vector are one entry of the catalogue, with their number, and no pair leaves a task: the work
    grows with the different vectors, not with the words. words has word_no and vector."""
    catalogue = prepared(_classes(words), **sizes)
    numbered = _numbered(texts, vector, list(keep))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, matrix, rows, vectors in _groups(batches):
            copies = given.column("copies").to_numpy()
            sims = vectors @ matrix.T
            hit = over(sims, threshold, inclusive)
            some = np.flatnonzero(hit.any(axis=1))
            hit, sims = hit[some], sims[some]
            best = np.where(hit, sims, -np.inf).max(axis=1, initial=-np.inf)
            found = [pa.array(rows[some]), pa.array(hit @ copies), pa.array(best), pa.array(np.where(hit, sims, 0.0) @ copies.astype(np.float64))]
            yield pa.RecordBatch.from_arrays(found, names=["text_row", "words", "best", "total"])

    parts = _met(numbered, catalogue, threshold, ["copies"]).mapInArrow(score, "text_row long, words long, best double, total double")
    totals = parts.groupBy("text_row").agg(F.sum("words").alias("words"), F.max("best").alias("best"), F.sum("total").alias("total"))
    return totals.join(numbered.select("text_row", "kept"), "text_row").select("kept.*", "words", "best", "total")


def large_mention_scores(texts: DataFrame, words: DataFrame, threshold: float, vector: str = "vector", keep: tuple[str, ...] = ("issue_id",), **sizes: int) -> DataFrame:
    """keep..., criteria, words, score: per text and criteria the similar words and the sum of similarity times weight.

    A task sends one row per text and criteria of its shard; the parts of several shards are summed."""
    catalogue = prepared(words.select("word_no", "criteria", "weight", "vector"), **sizes)
    numbered = _numbered(texts, vector, list(keep))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given, matrix, rows, vectors in _groups(batches):
            names, group = np.unique(given.column("criteria").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            sims = vectors @ matrix.T
            text_at, word_at = np.nonzero(over(sims, threshold, False))
            place = text_at * len(names) + group[word_at]
            size = len(rows) * len(names)
            counts = np.bincount(place, minlength=size)
            sums = np.bincount(place, sims[text_at, word_at] * given.column("weight").to_numpy()[word_at], size)
            some = np.flatnonzero(counts)
            found = [pa.array(rows[some // len(names)]), pa.array(names[some % len(names)].tolist(), pa.string()), pa.array(counts[some]), pa.array(sums[some])]
            yield pa.RecordBatch.from_arrays(found, names=["text_row", "criteria", "words", "score"])

    parts = _met(numbered, catalogue, threshold, ["criteria", "weight"]).mapInArrow(score, "text_row long, criteria string, words long, score double")
    totals = parts.groupBy("text_row", "criteria").agg(F.sum("words").alias("words"), F.sum("score").alias("score"))
    return totals.join(numbered.select("text_row", "kept"), "text_row").select("kept.*", "criteria", "words", "score")
