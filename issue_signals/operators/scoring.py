"""Model scoring as DataFrame steps.

A model is a factory that each Python worker calls once and that returns a function over a batch
of texts. Every distinct input is scored once; results are joined back. Without a factory a native,
deterministic default takes the model's place, so that plans run and can be checked without weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import NEGATIVE_WORDS, POSITIVE_WORDS
from ..functions.scores import sign_of
from ..functions.text import clean_for_sentiment, clean_issue_text, cue_counts, let, related_words
from ..session import small_batches
from .skew import lookup_join

Batch = Callable[[list[str]], list]
Factory = Callable[[], Batch]


_LETTERS = bytes(b if 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def clean_words(text: str) -> list[bytes]:
    """The words of clean_issue_text(text), for a step that takes them in Python: one pass over the bytes, where the
    expression takes some 70 ns a character."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def word_hashes(dim: int = 64) -> Factory:
    """The model-free text encoder: a bag of words of length 1, each word counted in the bucket that
    the first six digits of its md5 name. Any engine with md5 gives the same vectors. Texts are cleaned here."""

    def load() -> Batch:
        @lru_cache(maxsize=1 << 15)
        def bucket(word: bytes) -> int:
            return int(md5(word).hexdigest()[:6], 16) % dim

        def encode(texts: list[str]) -> list[np.ndarray]:
            places = [[i * dim + bucket(w) for w in clean_words(t)] for i, t in enumerate(texts)]
            flat = np.fromiter((p for row in places for p in row), dtype=np.int64)
            counts = np.bincount(flat, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
            lengths = np.linalg.norm(counts, axis=1, keepdims=True)
            return list(np.divide(counts, lengths, out=counts, where=lengths > 0))

        return encode

    return load


def embed(df: DataFrame, text: str = "text", factory: Factory | None = None, dim: int = 64, name: str = "vector") -> DataFrame:
    """Add a vector per text, NULL for a NULL text. Default: word_hashes of the cleaned text."""
    load = factory or word_hashes(dim)
    small_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for texts in batches:
            vectors = [np.asarray(v, dtype=np.float64) for v in model(["" if t is None else t for t in texts.to_pylist()])]
            ends = np.cumsum([0, *map(len, vectors)], dtype=np.int32)
            numbers = np.concatenate(vectors) if vectors else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers), mask=texts.is_null())

    # "not deterministic" keeps Spark from moving a filter on the vector, and the model with it, below a distinct or a join
    return df.withColumn(name, encode.asNondeterministic()(F.col(text)))


def lexicon_compound(
    text: Column | str, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """(positive - negative) / (positive + negative) distinct words present, 0.0 without any."""
    return let(
        cue_counts(text, positive, negative),
        lambda c: F.coalesce(F.try_divide(c["pos"] - c["neg"], c["pos"] + c["neg"]).cast("double"), F.lit(0.0)),
    )


def weighted_compound(df: DataFrame, lexicon: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """keep..., compound: mean weight of the text's lexicon words (word, weight), 0.0 without any.

    The lexicon is normally small: words meet it where they are, and each task sends one sum per text.
    """
    words = df.select(*keep, F.explode_outer(F.split(clean_issue_text(text), " ")).alias("word"))
    joined = lookup_join(words, lexicon.select("word", "weight"), ["word"], "left")
    return joined.groupBy(*keep).agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("compound"))


def sentiment(
    df: DataFrame,
    text: str = "text",
    factory: Factory | None = None,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    neutral: bool = False,
    max_chars: int | None = None,
) -> DataFrame:
    """Add sentiment, confidence and sentiment_error.

    A factory's function returns (label, score) per text; a text it fails on gets NULL and the
    error. Default: word lexicon; '+' when positive words prevail, else '-', or with neutral '0'
    when neither does. confidence is then the share of the prevailing side.
    """
    cleaned = df.withColumn("sentiment_text", clean_for_sentiment(text, max_chars))
    if factory is None:
        compound = lexicon_compound("sentiment_text", positive, negative)
        label = sign_of("compound") if neutral else F.when(F.col("compound") > 0, F.lit("+")).otherwise(F.lit("-"))
        return (
            cleaned.withColumn("compound", compound)
            .withColumn("sentiment", label)
            .withColumn("confidence", (F.abs("compound") + 1) / 2)
            .withColumn("sentiment_error", F.lit(None).cast("string"))
            .drop("compound", "sentiment_text")
        )
    small_batches(df.sparkSession)

    @F.pandas_udf("label string, score double, error string")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            yield pd.DataFrame(_isolated(model, texts.tolist()), columns=["label", "score", "error"])

    scored = cleaned.withColumn("answer", classify("sentiment_text"))
    polarity = F.when(F.col("answer.label").isNotNull(), F.when(F.col("answer.label") == "POSITIVE", "+").otherwise("-"))
    return (
        scored.withColumn("sentiment", polarity)
        .withColumn("confidence", F.col("answer.score"))
        .withColumn("sentiment_error", F.col("answer.error"))
        .drop("answer", "sentiment_text")
    )


def _isolated(model: Batch, texts: list[str]) -> list[tuple]:
    """One model call for the batch; a batch that fails is halved until the failing text is alone."""
    try:
        return [(*answer, None) for answer in model(texts)] if texts else []
    except Exception as error:  # the row keeps the reason instead of a made-up label
        if len(texts) == 1:
            return [(None, None, str(error))]
        half = len(texts) // 2
        return _isolated(model, texts[:half]) + _isolated(model, texts[half:])


def word_overlap() -> Callable[[str, tuple[str, ...]], list[float]]:
    """The model-free entailment score: the share of each hypothesis' distinct words in the chunk.

    Few words of a chunk are in any hypothesis of a list: a chunk meets the words of the whole list once, and the
    scores of the words that it shares with them are remembered."""

    @lru_cache(maxsize=1 << 10)
    def words(hypotheses: tuple[str, ...]) -> tuple[frozenset[bytes], list[frozenset[bytes]]]:
        each = [frozenset("".join(c if "a" <= c <= "z" else " " for c in h.lower()).encode().split()) for h in hypotheses]
        return frozenset().union(*each), each

    @lru_cache(maxsize=1 << 12)
    def shares(met: frozenset[bytes], hypotheses: tuple[str, ...]) -> list[float]:
        return [len(own & met) / len(own) if own else 0.0 for own in words(hypotheses)[1]]

    def score(chunk: str, hypotheses: tuple[str, ...]) -> list[float]:
        return shares(words(hypotheses)[0].intersection(clean_words(chunk)), hypotheses)

    return score


def _overlaps() -> Callable[[Column, Column], Column]:
    """A column function (chunk, hypotheses) -> the word overlap with each hypothesis."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        overlap = word_overlap()
        for texts, lists in batches:
            rows = zip(texts.to_pylist(), lists.to_pylist())
            yield pa.array([[0.0] * len(h) if t is None else overlap(t, tuple(h)) for t, h in rows], pa.list_(pa.float64()))

    return score


def _pair_scorer(factory: Factory) -> Callable[[Column, Column], Column]:
    """A column function (chunk, hypotheses) -> one score per hypothesis; one model call per batch."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()

        for texts, lists in batches:
            pairs = [(chunk, h) for chunk, hypotheses in zip(texts, lists) if chunk is not None for h in hypotheses]
            answers = iter(model(pairs) if pairs else ())
            yield pd.Series([[0.0 if chunk is None else float(next(answers)) for _ in h] for chunk, h in zip(texts, lists)])

    return score


def entailment_scores(
    chunks: DataFrame, chunk: str = "chunk", hypotheses: str = "hypotheses", factory: Factory | None = None
) -> DataFrame:
    """Add scores, one per hypothesis of the row; a NULL chunk scores 0.0 throughout.

    A factory's function takes [(chunk, hypothesis), ...] and returns probabilities. Each distinct pair
    is scored once, as a model costs far more than the shuffle that finds them: a chunk meets all its
    hypotheses in one row. Default: word_overlap, which is cheap and scores the rows where they are.
    """
    small_batches(chunks.sparkSession)
    if factory is None:
        return chunks.withColumn("scores", _overlaps()(F.col(chunk), F.col(hypotheses)))
    asked = F.array_distinct(F.flatten(F.collect_set(hypotheses))).alias("h")
    once = chunks.filter(F.col(chunk).isNotNull()).groupBy(F.col(chunk).alias("c")).agg(asked)
    scored = once.select(F.sha2("c", 256).alias("chunk_key"), F.map_from_arrays("h", _pair_scorer(factory)("c", "h")).alias("score_of"))
    found = chunks.withColumn("chunk_key", F.sha2(chunk, 256)).join(scored, "chunk_key", "left")
    scores = F.transform(hypotheses, lambda h: F.coalesce(F.get(F.map_values(F.map_filter("score_of", lambda k, _: k == h)), F.lit(0)), F.lit(0.0)))
    return found.withColumn("scores", scores).drop("chunk_key", "score_of")


def votes(
    chunks: DataFrame, trials: int = 5, factory: Factory | None = None, prompt: str = "prompt", words: str = "related_words",
    chunk: str = "chunk",
) -> DataFrame:
    """One row per chunk and trial with the answer.

    A factory's function takes prompts and returns answers. Default: yes when a related word is in
    the chunk; the same in every trial.
    """
    each_trial = F.explode(F.sequence(F.lit(1), F.lit(trials)))
    if factory is None:
        lowered = F.struct(F.lower(chunk).alias("chunk"), F.transform(related_words(words), F.lower).alias("words"))
        hit = let(lowered, lambda p: F.exists(p["words"], lambda w: F.contains(p["chunk"], w)))
        answered = chunks.withColumn("answer", F.when(hit, F.lit("yes")).otherwise(F.lit("no")))
        return answered.withColumn("trial", each_trial)
    rows = chunks.withColumn("trial", each_trial)
    small_batches(chunks.sparkSession)

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()))

    return rows.withColumn("answer", ask(F.col(prompt)))
