"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

A text is its letters in lower case, with one boundary between words. Four neighbouring symbols are one
64-bit key, so that the contexts, endings and continuation counts of the model are shifts and masks of a
column, and all of the model is grouping and joining of distinct keys, over every document to learn
from. What tasks hold is, for each language and order, two sorted arrays of hashes: of the symbols
with a probability, and of the contexts with a weight for what they were not seen with. The hashes have
as many bits as keep all languages of an order within 2 ** SLOT_BITS, whatever the size of the corpus.

A part of the documents is left out of the counts. It sets the temperature of the score, and for each
language and class of length the cross-entropy beyond which a text is rejected.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issue_signals.llm.common import shared_table, small_batches

#: Symbols in the longest key, and bits of a symbol; characters beyond are folded.
ORDER, SYMBOL_BITS = 4, 16
#: Hashes of all languages of one order, as a power of two.
SLOT_BITS = 21
#: Languages beyond that number are an error: their hashes would be too short.
MAX_LANGUAGES = 512
#: Share of the calibration texts of a language and length that is not rejected; classes of length.
ACCEPTED, CLASSES = 0.999, 12
TEMPERATURES = tuple(2.0 ** (k / 2) for k in range(16))
UNKNOWN = "und"
#: Symbols whose keys are made at once, and keys that are told apart without sorting.
_WINDOW, _DENSE = 1 << 20, 1 << 25
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column) -> Column:
    """Documents that nothing may be learned from. A null id counts as the empty one."""
    return _place(id_col) % 4 == 2


def _place(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def _calibrates(id_col: Column) -> Column:
    return _place(id_col) % 16 == 3


@cache
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (0: no part of a word), and whether it is a letter."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    code = np.arange(len(kind))
    folded = np.maximum((code ^ code >> SYMBOL_BITS) & ((1 << SYMBOL_BITS) - 1), 1)
    return np.where((kind == "L") | (kind == "M"), folded, 0).astype(np.uint16), kind == "L"


def symbols(text: str | None) -> np.ndarray:
    """Words of symbols, each with a boundary (0) behind it; nothing if the text has no letter."""
    table, letters = _symbols()
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letters[codes].any():
        return np.zeros(0, np.uint16)
    found = np.append(table[codes], np.uint16(0))
    return found[(found != 0) | (np.append(np.uint16(0), found[:-1]) != 0)]


def _laid_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts end to end, each behind ORDER - 1 boundaries; the text of each symbol (len(texts) for those
    boundaries), and the number of symbols of each text."""
    held = [symbols(t) for t in texts]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    pad = np.zeros(ORDER - 1, np.uint16)
    flat = np.concatenate([part for h in held for part in (pad, h)]) if held else pad
    spans = np.stack([np.full(len(held), ORDER - 1), sizes], axis=1).ravel()
    owner = np.repeat(np.stack([np.full(len(held), len(held)), np.arange(len(held))], axis=1).ravel(), spans)
    return flat, owner, sizes


def _keys(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all symbols of flat but the first ORDER - 1, and which of them each symbol has."""
    met = np.flatnonzero(np.bincount(flat, minlength=1))
    local = np.zeros(int(met[-1]) + 1, np.int64)
    local[met] = np.arange(len(met))
    local = local[flat]
    size = len(flat) - ORDER + 1
    dense = len(met) ** ORDER <= _DENSE
    parts, base = (local, len(met)) if dense else (flat.astype(np.uint64), 1 << SYMBOL_BITS)
    code = np.zeros(size, parts.dtype)
    for k in range(ORDER):
        code = code * parts.dtype.type(base) + parts[k : k + size]
    if not dense:
        return np.unique(code, return_inverse=True)
    seen = np.zeros(len(met) ** ORDER, bool)
    seen[code] = True
    distinct = np.flatnonzero(seen)
    index = np.zeros(len(seen), np.int32)
    index[distinct] = np.arange(len(distinct), dtype=np.int32)
    key = np.zeros(len(distinct), np.uint64)
    for k in range(ORDER):
        digit = met[distinct // len(met) ** (ORDER - 1 - k) % len(met)]
        key = (key << np.uint64(SYMBOL_BITS)) | digit.astype(np.uint64)
    return key, index[code]


def _windows(flat: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct keys, the key of each symbol, its text), some symbols at a time."""
    for low in range(ORDER - 1, len(flat), _WINDOW):
        high = min(len(flat), low + _WINDOW)
        keys, which = _keys(flat[low - ORDER + 1 : high])
        yield keys, which, owner[low:high]


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, key, n: how often each key occurs in the texts of docs (text, lang) of a language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str | None]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                flat, owner, sizes = _laid_out(texts)
                for keys, which, own in _windows(flat, owner):
                    n = np.bincount(which[own < len(texts)], minlength=len(keys))
                    some = n > 0
                    out = [pa.array([lang] * int(some.sum()), pa.string()), pa.array(keys[some].view(np.int64)), pa.array(n[some])]
                    yield pa.RecordBatch.from_arrays(out, names=["lang", "key", "n"])

    found = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _ending(order: int) -> Column:
    """The last `order` symbols of a key."""
    return F.col("key").bitwiseAND(F.lit((1 << SYMBOL_BITS * order) - 1)) if order < ORDER else F.col("key")


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From the counts of the longest keys: lang, size, key, value (the logarithm of a probability), n; and
    lang, size, key (a context of `size` symbols), value (the logarithm of its weight for unseen symbols), n.

    Shorter keys are counted by the symbols that they follow. One discount for each language and order:
    n1 / (n1 + 2 n2); 0.5 where there are no such counts. The shortest order is mixed with equal
    probabilities of all symbols, whose weight is that of the empty context."""
    levels = {ORDER: counts.select("lang", "key", "n")}
    for size in range(ORDER - 1, 0, -1):
        levels[size] = shared_table(levels[size + 1].groupBy("lang", _ending(size).alias("key")).agg(F.count("*").alias("n")), "language-level")
    lower = None
    grams, contexts = [], []
    for size in range(1, ORDER + 1):
        level = levels[size]
        ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        discounts = level.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("discount"))
        level = level.withColumn("context", F.shiftrightunsigned("key", SYMBOL_BITS))
        after = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(discounts, "lang")
        after = shared_table(after.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("total")), "language-contexts")
        met = level.join(after, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("discount")) / F.col("total"))
        if lower is None:
            met = met.withColumn("below", F.lit(2.0**-SYMBOL_BITS))
        else:
            met = met.withColumn("end", _ending(size - 1)).join(lower, ["lang", "end"])
        met = shared_table(met.select("lang", "key", "n", (F.col("own") + F.col("weight") * F.col("below")).alias("p")), "language-grams")
        lower = met.select("lang", F.col("key").alias("end"), F.col("p").alias("below"))
        grams.append(met.select("lang", F.lit(size).alias("size"), "key", F.log("p").alias("value"), "n"))
        contexts.append(after.select("lang", F.lit(size - 1).alias("size"), F.col("context").alias("key"), F.log("weight").alias("value"), F.col("total").alias("n")))
    whole = [parts[0] for parts in (grams, contexts)]
    for k in range(1, ORDER):
        whole = [whole[0].unionByName(grams[k]), whole[1].unionByName(contexts[k])]
    return whole[0], whole[1]


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    mixed = (keys ^ keys >> np.uint64(32)) * _ODD
    return ((mixed ^ mixed >> np.uint64(29)) * _ODD >> np.uint64(64 - bits)).astype(np.uint32)


def _hashed(rows: DataFrame, bits: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """By language and size the sorted hashes and their values; of keys with one hash the most frequent
    counts. At most 2 ** SLOT_BITS rows of a size come to the driver."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch.column("key").to_numpy().view(np.uint64), bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "size", "key", "value", "n")), pa.array(slot)], names=["lang", "size", "key", "value", "n", "slot"])

    placed = rows.mapInArrow(place, "lang string, size int, key long, value double, n long, slot long")
    best = placed.groupBy("lang", "size", "slot").agg(F.max_by("value", F.struct("n", "key")).cast("float").alias("value"))
    got = best.toArrow().to_pandas().sort_values(["lang", "size", "slot"])
    return {at: (part["slot"].to_numpy().astype(np.uint32), part["value"].to_numpy().astype(np.float32)) for at, part in got.groupby(["lang", "size"])}


@dataclass
class LanguageModel:
    """Languages in code-point order, their arrays, and the calibration."""

    langs: list[str]
    bits: int
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    contexts: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0
    #: By (language, class of length): the largest cross-entropy of a text that is not rejected.
    limits: dict[tuple[str, int], float] = field(default_factory=dict)

    def log_probabilities(self, lang: str, keys: np.ndarray, size: int = ORDER) -> np.ndarray:
        """The logarithm of the probability of the last symbol of each key after those before it."""
        if not size:
            return np.full(len(keys), -SYMBOL_BITS * math.log(2))
        found, value = _looked_up(self.grams.get((lang, size)), slots(keys, self.bits))
        open_ = np.flatnonzero(~found)
        if len(open_):
            rest = keys[open_]
            seen, weight = _looked_up(self.contexts.get((lang, size - 1)), slots(rest >> np.uint64(SYMBOL_BITS), self.bits))
            shorter = rest & np.uint64((1 << SYMBOL_BITS * (size - 1)) - 1)
            value[open_] = np.where(seen, weight, 0.0) + self.log_probabilities(lang, shorter, size - 1)
        return value

    def log_likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the logarithm of the text's probability, and the symbols of each text."""
        flat, owner, sizes = _laid_out(texts)
        total = np.zeros((len(texts) + 1, len(self.langs)))
        for keys, which, own in _windows(flat, owner):
            for k, lang in enumerate(self.langs):
                total[:, k] += np.bincount(own, self.log_probabilities(lang, keys)[which], len(total))
        return total[:-1], sizes

    def limit(self, lang: str, size: int) -> float:
        own = self.limits.get((lang, length_class(size)))
        return own if own is not None else max((v for (other, _), v in self.limits.items() if other == lang), default=math.inf)


def _looked_up(arrays: tuple[np.ndarray, np.ndarray] | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if arrays is None:
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(arrays[0], wanted), len(arrays[0]) - 1)
    return arrays[0][at] == wanted, arrays[1][at].astype(np.float64)


def length_class(size: int) -> int:
    return min(int(size).bit_length(), CLASSES)


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """The models of all languages of docs, from every row that is not held out and has a text and a language.

    Texts without a letter add nothing. Rows that repeat count again. Without such rows the model has no
    languages. More than MAX_LANGUAGES languages are an error."""
    key = F.col(f"`{id_col}`")
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), held_out(key).alias("out"), _calibrates(key).alias("calibrates"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL AND NOT out")
    counts = shared_table(gram_counts(rows.filter("NOT calibrates")), "language-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return LanguageModel([], SLOT_BITS, {}, {})
    bits = SLOT_BITS - (len(langs) - 1).bit_length()
    grams, contexts = kneser_ney(counts)
    return calibrated(LanguageModel(langs, bits, _hashed(grams, bits), _hashed(contexts, bits)), rows.filter("calibrates"))


def calibrated(model: LanguageModel, rows: DataFrame) -> LanguageModel:
    """model with the temperature that makes its scores most likely on rows (text, lang), and the limits."""
    sc = rows.sparkSession.sparkContext
    shared, place = sc.broadcast(model), {lang: k for k, lang in enumerate(model.langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            total, sizes = shared.value.log_likelihoods(batch.column("text").to_pylist())
            some = np.array([k for k, lang in enumerate(langs) if lang in place and sizes[k]], np.int64)
            own = np.array([place[langs[k]] for k in some], np.int64)
            apart = total[some] - total[some, own][:, None]
            losses = np.stack([np.logaddexp.reduce(apart / t, axis=1) for t in TEMPERATURES], axis=1)
            entropy = -total[some, own] / np.maximum(sizes[some], 1)
            out = [pa.array([langs[k] for k in some], pa.string()), pa.array([length_class(sizes[k]) for k in some], pa.int32()), pa.array(entropy), pa.array(list(losses), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["lang", "class", "entropy", "losses"])

    found = shared_table(rows.select("text", "lang").mapInArrow(measure, "lang string, class int, entropy double, losses array<double>"), "language-calibration")
    sums = found.agg(*[F.sum(F.round(F.col("losses")[k], 6)).alias(f"t{k}") for k in range(len(TEMPERATURES))]).first()
    if sums[0] is not None:
        model.temperature = TEMPERATURES[min(range(len(TEMPERATURES)), key=lambda k: (round(sums[k], 3), k))]
    # a row for each language and class of length
    limits = found.groupBy("lang", "class").agg(F.percentile_approx("entropy", ACCEPTED, 10_000)).collect()
    model.limits = {(lang, size): value for lang, size, value in limits}
    return model


def identified(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, best, lang, score, entropy, rejected.

    best is the language whose model has the lowest cross-entropy per symbol, of equal ones the first in
    code-point order; score its share of the probability at the calibrated temperature. rejected: the
    cross-entropy is beyond the limit of that language and length; lang is then UNKNOWN, else best. A text
    that is null or has no letter has best and lang UNKNOWN, score 0 and no entropy, and so has every
    text if the model has no languages. Very long texts are scored whole, a window at a time. A null
    id passes through, repeated rows are repeated, columns beside the two are not read, and an empty
    table gives no rows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            total, sizes = held.log_likelihoods(batch.column("text").to_pylist())
            rows = []
            for own, size in zip(total, sizes):
                if not size or not held.langs:
                    rows.append((UNKNOWN, UNKNOWN, 0.0, None, False))
                    continue
                k = int(own.argmax())
                share = 1 / float(np.exp((own - own[k]) / held.temperature).sum())
                entropy = -float(own[k]) / int(size)
                rejected = entropy > held.limit(held.langs[k], size)
                rows.append((held.langs[k], UNKNOWN if rejected else held.langs[k], share, entropy, rejected))
            kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "best", "lang", "score", "entropy", "rejected"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, best string, lang string, score double, entropy double, rejected boolean")
