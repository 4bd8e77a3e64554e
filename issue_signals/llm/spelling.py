"""Spelling variants: words one edit apart, and the common form of each.

The letters of a word are hashed to a few symbols. Words that are one edit apart have reduced words
that are equal or one edit apart, so the whole one-edit neighbourhood of every distinct reduced word is
generated, as 64-bit sums that an edit changes in constant time, and met with the sums of the reduced
vocabulary. What meets is verified on the original words. The number of symbols follows from the size
of the vocabulary (`symbols_for`), so that about one word has a reduced word of BALANCE letters: the neighbourhoods
grow with the words, and so do the pairs to verify.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from issue_signals.llm.common import shared_table, text_or_empty

#: A run of letters, and all letters that it can have once A-Z are lower case.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
#: One run in DAMAGED, chosen by hash, loses a letter.
DAMAGED = 199
MIN_LETTERS, MIN_COUNT = 6, 5
#: A form is that many times as frequent as the word, at least.
RATIO = 5
#: Letters of a reduced word for which the symbols are dealt, and the fewest symbols.
BALANCE, FEWEST = 7, 4
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
#: Places of reduced words that are edited at once.
_PLACES = 50_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """word: every maximal run of letters of every text, A-Z in lower case, some of them without one letter."""
    low = F.translate(text_or_empty(text_col), UPPER, LOWER)
    found = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), 0)).alias("run"))
    found = found.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    run, at = F.col("run"), F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    return found.select(F.when(F.col("h") % damaged == 0, shorter).otherwise(run).alias("word"))


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damaged: int = DAMAGED
) -> DataFrame:
    """word, n: the words of at least min_letters code points that occur at least min_count times."""
    found = runs(docs, id_col, text_col, damaged).filter(F.length("word") >= min_letters)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def symbols_for(words: int) -> int:
    return max(FEWEST, math.ceil(max(1, words) ** (1 / BALANCE)))


def symbol_of(symbols: int) -> str:
    """The symbol of each of LETTERS: the letters in the order of their digests, dealt in turn."""
    order = sorted(LETTERS, key=lambda c: (c > "z", hashlib.sha256(c.encode()).digest()))
    dealt = {c: chr(97 + k % symbols) for k, c in enumerate(order)}
    return "".join(dealt[c] for c in LETTERS)


def reduced(word: Column, symbols: int) -> Column:
    return F.translate(word, LETTERS, symbol_of(symbols))


def _values(symbols: int) -> np.ndarray:
    """A 64-bit value for each symbol."""
    return np.array([int.from_bytes(hashlib.sha256(b"%d" % s).digest()[:8], "big") | 1 for s in range(symbols)], np.uint64)


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all words end to end, the word of each, and where each word begins (and the end)."""
    plain = words.to_pylist()
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer("".join(plain).encode("latin-1"), np.uint8).astype(np.int64) - 97, np.repeat(np.arange(len(plain)), sizes), starts


def _sums(flat: np.ndarray, owner: np.ndarray, starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The power of each place in its word, the sum of value x power before each place, and each word's whole sum."""
    longest = int(np.diff(starts).max(initial=0))
    powers = np.ones(longest + 1, np.uint64)
    powers[1:] = np.uint64(_ODD)
    powers = np.multiply.accumulate(powers)
    power = powers[np.arange(len(flat)) - starts[owner]]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[flat] * power, dtype=np.uint64)])
    return power, running[:-1] - running[starts[:-1]][owner], running[starts[1:]] - running[starts[:-1]]


def word_sum(word: Column, symbols: int) -> Column:
    """The 64-bit sum of a reduced word."""
    values = _values(symbols)

    @F.arrow_udf(LongType())
    def compute(words: pa.Array) -> pa.Array:
        return pa.array(_sums(*_flat(words), values)[2].view(np.int64))

    return compute(word)


def _edited(words: pa.Array, symbols: int, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sum of a reduced word, sum of the word with one edit or none), each edited word once: a letter equal to the one
    before it is not deleted, and none is inserted behind its equal, as that gives a word met before."""
    flat, owner, starts = _flat(words)
    power, before, whole = _sums(flat, owner, starts, values)
    odd, back = np.uint64(_ODD), np.uint64(_BACK)
    yield whole, whole
    # a letter behind the last
    tail = np.flatnonzero(np.diff(starts) > 0)
    for s in range(symbols):
        put = tail[flat[starts[tail + 1] - 1] != s]
        yield whole[put], whole[put] + values[s] * power[starts[put + 1] - 1] * odd
    for low in range(0, len(flat), _PLACES):
        at = np.arange(low, min(low + _PLACES, len(flat)))
        own, here, scale, head = whole[owner[at]], values[flat[at]], power[at], before[at]
        first = at == starts[owner[at]]
        previous = np.where(first, -1, flat[at - 1])
        fresh = previous != flat[at]
        yield own[fresh], (head + (own - head - here * scale) * back)[fresh]
        for s in range(symbols):
            other = flat[at] != s
            yield own[other], (own + (values[s] - here) * scale)[other]
            put = previous != s
            yield own[put], (head + values[s] * scale + (own - head) * odd)[put]


def neighbourhoods(forms: DataFrame, symbols: int) -> DataFrame:
    """own, near: the sum of each reduced word of forms (column reduced) with the sums of all words that
    one edit over the symbols makes of it, and with its own."""
    values = _values(symbols)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, near in _edited(batch.column(0), symbols, values):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(near.view(np.int64))], names=["own", "near"])

    return forms.select("reduced").mapInArrow(generate, "own long, near long")


def near_words(words: DataFrame, symbols: int) -> DataFrame:
    """word, near, near_n for all pairs of words (word, n) that are exactly one edit apart, both ways."""
    held = words.withColumn("reduced", reduced(F.col("word"), symbols))
    summed = shared_table(held.withColumn("own", word_sum(F.col("reduced"), symbols)).select("word", "n", "reduced", "own"), "spelling-words")
    # a small table that makes much work: adaptive execution would put it in few tasks, so the number of parts is given
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = summed.select("reduced").repartition(parts, "reduced").distinct()
    links = neighbourhoods(forms, symbols).join(summed.select(F.col("own").alias("near")).distinct(), "near")
    links = links.distinct()
    mine = links.join(summed.select("own", "word"), "own").select("near", "word")
    theirs = summed.select(F.col("own").alias("near"), F.col("word").alias("other"), F.col("n").alias("near_n"))
    met = mine.join(theirs, (mine["near"] == theirs["near"]) & (F.levenshtein(mine["word"], theirs["other"], 1) == 1))
    return met.select("word", F.col("other").alias("near"), "near_n")


def roots(forms: DataFrame, deepest: int) -> DataFrame:
    """word, root: where the chain of forms (word, form) from each word ends, by doubling the steps.

    deepest: the longest chain that there can be."""
    state = forms.select("word", F.col("form").alias("root"))
    reach = 1
    while reach < deepest:
        state = shared_table(state, "spelling-roots")
        further = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        state = state.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    return state


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    symbols: int | None = None,
    damaged: int = DAMAGED,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A null text has no words, and a null id is hashed as the empty one; very long texts are split in
    runs like any other, and a run of any length is one word. Repeated rows count again. Of near words
    with equal n the first in code-point order is the form. Columns beside the id and the text are not
    read. An empty table gives no rows. The result is the same for any number of symbols."""
    words = shared_table(vocabulary(docs, id_col, text_col, min_letters, min_count, damaged), "spelling-vocabulary")
    size, largest = words.agg(F.count("*"), F.max("n")).first()
    near = near_words(words, symbols or symbols_for(size))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    has_form = -F.col("best.n") >= F.col("n") * ratio
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, -F.col("best.n")).alias("form_n"),
    )
    found = shared_table(found, "spelling-forms")
    deepest = math.floor(math.log(max(largest or 1, 1), max(ratio, 2))) + 1  # each step multiplies n by ratio
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"), deepest)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
