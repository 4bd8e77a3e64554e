"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A text is the set of its hashed words, of their hashed beginnings and of hashed facts about its form (share of repeated words,
lines, marks, capitals ...). All grades share one weight per hash; ordered thresholds part the score:
P(grade >= k) = sigmoid(score - threshold k). The model is fitted on at most SAMPLE labelled rows,
those with the smallest hashed ids, in one task, and holds a weight only for hashes that MIN_TEXTS of
them contain and whose texts have a mean grade clearly apart from that of all. Scoring reads whole texts and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from issue_signals.llm.common import small_batches, whole_row

#: Labelled rows that the fit uses at most, texts a feature must occur in, and steps of the fit.
SAMPLE, MIN_TEXTS, STEPS = 20_000, 5, 300
#: Standard errors by which the mean grade of a feature's texts must differ from that of all.
LEAN_FROM = 4.0
#: Weight decay of the fit; probability of the best grade from which a text is kept.
DECAY, KEEP_FROM = 1e-4, 0.7
#: Lengths of the word beginnings that count beside the words: inflected words share them.
STEMS = (4, 5)
#: Space of the hashes.
HASH_BITS = 31
_MARKS = " \t\r\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…–—"
_SYMBOL = re.compile(r"[^\w\s.,;:'\"!?()-]")


def _hash(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature, 7) & ((1 << HASH_BITS) - 1)


def _facts(text: str, words: list[str], distinct: int) -> list[str]:
    """Facts about the form of a text, each as a word that no text has."""
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    level = min(12, n.bit_length())
    shares = {
        "repeated": 1 - distinct / n if n else 0,
        "again": sum(map(str.__eq__, words, words[1:])) / n if n else 0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0,
        "symbols": len(_SYMBOL.findall(text)) / size,
        "exclaimed": text.count("!") / max(1, n),
        "piped": text.count("|") / max(1, n),
        "capitals": sum(map(str.isupper, words)) / max(1, n),
        "digits": sum(map(text.count, "0123456789")) / size,
    }
    facts = [f"\0{name}\0{round(20 * share)}" for name, share in shares.items()]
    facts += [f"\0{name}\0{level}\0{round(10 * share)}" for name, share in shares.items() if name in ("repeated", "lines")]
    return [*facts, f"\0words\0{level}", f"\0long\0{min(30, round((size - n) / max(1, n)))}"]


def features(text: str | None) -> np.ndarray:
    """The distinct hashes of the whole text, sorted. Null is the empty text."""
    text = text or ""
    words = text.split()
    seen = {w.strip(_MARKS) for w in set(text.lower().split())}
    stems = {f"\0{n}\0{w[:n]}" for n in STEMS for w in seen if len(w) > n}
    found = [_hash(w) for w in (*seen, *stems)]
    found += [_hash(f) for f in _facts(text, words, len(seen))]
    return np.unique(np.array(found, np.int32))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of sorted hashes and ascending thresholds, one for each grade but the lowest."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, found: np.ndarray) -> float:
        return float(self.weights[_places(self.hashes, found)].sum())


def _places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where those of found that are known stand among the sorted known."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return at[known[at] == found]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, min_texts: int = MIN_TEXTS, decay: float = DECAY, lean_from: float = LEAN_FROM) -> OrdinalModel:
    """Maximum likelihood of the cumulative links with weight decay, by full-batch Adam; the same for
    the same rows in the same order. With fewer than two grades every score is 0."""
    top = int(grades.max(initial=0))
    if not len(rows) or grades.min() == top:
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.zeros(top))
    hashes, seen = np.unique(np.concatenate(rows), return_counts=True)
    hashes, seen = hashes[seen >= min_texts], seen[seen >= min_texts]
    spread = grades - grades.mean()
    lean = np.zeros(len(hashes))
    for found, apart in zip(rows, spread):  # row by row, so that only the hashes themselves are held at once
        lean[_places(hashes, found)] += apart
    hashes = hashes[np.abs(lean) >= lean_from * np.sqrt(np.maximum(seen * (1 - seen / len(rows)), 1e-9) * spread.var())]
    columns = [_places(hashes, found) for found in rows]
    row, column = np.repeat(np.arange(len(rows)), [len(c) for c in columns]), np.concatenate(columns)
    n, levels = len(rows), np.arange(1, top + 1)
    # thresholds: the first, and the logarithms of the steps between them
    share = np.clip([(grades >= k).mean() for k in levels], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * levels)
    state = np.concatenate([np.zeros(len(hashes)), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, gaps = state[: len(hashes)], np.exp(state[len(hashes) + 1 :])
        edges = np.concatenate([state[len(hashes) : len(hashes) + 1], gaps]).cumsum()
        score = np.bincount(row, weights[column], n)
        above = _sigmoid(score[:, None] - edges[None, :])  # P(grade >= k)
        upper = np.concatenate([np.ones((n, 1)), above], axis=1)[np.arange(n), grades]
        lower = np.concatenate([above, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        likely = np.maximum(upper - lower, 1e-9)
        slope = above * (1 - above)
        padded = np.concatenate([np.zeros((n, 1)), slope, np.zeros((n, 1))], axis=1)
        up, down = padded[np.arange(n), grades], padded[np.arange(n), grades + 1]
        by_score = -(up - down) / likely
        by_edge = np.array([(np.where(grades == k, up, 0) / likely).sum() - (np.where(grades == k - 1, down, 0) / likely).sum() for k in levels])
        by_gap = np.array([by_edge[k:].sum() for k in range(1, top)]) * gaps
        slope_all = np.concatenate([np.bincount(column, by_score[row], len(hashes)), [by_edge.sum()], by_gap]) / n
        slope_all[: len(hashes)] += decay * weights
        first += 0.1 * (slope_all - first)
        second += 0.01 * (slope_all**2 - second)
        state -= 0.08 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    edges = np.concatenate([state[len(hashes) : len(hashes) + 1], np.exp(state[len(hashes) + 1 :])]).cumsum()
    return OrdinalModel(hashes, state[: len(hashes)], edges)


def trained(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE
) -> OrdinalModel:
    """Fit on the labelled rows: labels has the id and a grade from 0 up. Rows without an id or grade are
    left out; of an id's grades the lowest counts. Without labels every text gets score 0."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{grade_col}`").cast("int").alias("grade"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), found], names=["doc_id", "grade", "hashes"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(i, g, h.values.to_numpy()) for b in batches for i, g, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        found.sort(key=lambda x: (x[0], len(x[2]), x[2].tolist()[:8]))
        model = fit([h for _, _, h in found], np.array([g for _, g, _ in found], np.int64))
        kept = np.abs(model.weights) > 1e-3
        at = np.concatenate([model.hashes[kept].astype(np.int64), -np.arange(1, len(model.thresholds) + 1)])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([model.weights[kept], model.thresholds]))], names=["hash", "weight"])

    texts = rows.mapInArrow(extract, "doc_id long, grade int, hashes array<int>").repartition(1)
    got = texts.mapInArrow(learn, "hash long, weight double").orderBy("hash").toArrow()
    hashes, weights = got.column("hash").to_numpy(), got.column("weight").to_numpy()
    edge = hashes < 0
    return OrdinalModel(hashes[~edge], weights[~edge], weights[edge][::-1])


def text_score(text: Column, model: OrdinalModel) -> Column:
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(features(t)) for t in texts.to_pylist()], pa.float64())

    return score(text)


def graded(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of docs: doc_id, score, expected_grade, tails (P(grade >= 1), P(grade >= 2), ...), kept.

    kept: the best grade is at least as likely as keep_from. A null text is scored as the empty one;
    a null id passes through. A model of one grade has no tails, expects grade 0 and keeps all."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_score(F.col(f"`{text_col}`").cast("string"), model).alias("score"))
    return rows.select("doc_id", "score", *_outcome(F.col("score"), model, keep_from))


def _outcome(score: Column, model: OrdinalModel, keep_from: float) -> list[Column]:
    tails = [1 / (1 + F.exp(F.lit(float(edge)) - score)) for edge in model.thresholds]
    expected = sum(tails[1:], tails[0]) if tails else F.lit(0.0)
    kept = tails[-1] >= keep_from if tails else F.lit(True)
    return [expected.alias("expected_grade"), F.array(*tails).cast("array<double>").alias("tails"), kept.alias("kept")]


def accepted(docs: DataFrame, model: OrdinalModel, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns, whatever their names. Null, empty and long texts are
    graded as in `graded`; repeated rows go or stay alike, and an empty table gives no rows."""
    small_batches(docs.sparkSession)
    scored = docs.select(whole_row(docs), text_score(F.col(f"`{text_col}`").cast("string"), model).alias("score"))
    return scored.filter(_outcome(F.col("score"), model, keep_from)[2]).select("row.*")


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade from the columns quality and toxic: a point for quality, a point for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + (1 - F.col("toxic"))).cast("int").alias("grade"))
