"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

The terms of a text are its shingles of five words (fewer words: the whole sequence), weighted by how
often they occur. For each of SAMPLES samples a term draws r and c from Gamma(2, 1) and b from [0, 1),
all from hashes of the term and the sample's number; with weight w it gets
    t = floor(ln w / r + b),    ln a = ln c - r * (t - b + 1),
and the term of the smallest a, together with its t, is the sample. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, sum of min weights over sum of max weights.
Terms are exploded and minimised in the same stage, so what is shuffled is one short row per text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issue_signals.llm.common import SPACE, shared_table, text_or_empty

#: Words of a shingle, and samples of a fingerprint: the standard error of a likeness is at most 0.09.
SHINGLE, SAMPLES = 5, 32
#: Rows that the neighbour search sorts together.
ROWS_PER_RANGE = 4_096
#: Ranges at most; of a larger table a range holds more rows. Their ends pass the driver.
MOST_RANGES = 65_536
_LOW = 0xFFFFFFFF
_ENTRIES = "array<struct<term: bigint, log_weight: double, version: int>>"


def shingle_hashes(words: Column) -> Column:
    """Sorted hashes of the shingles of an array of word hashes."""
    several = F.transform(
        F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*[F.element_at(words, i + F.lit(k)) for k in range(SHINGLE)])
    )
    return F.when(F.size(words) >= SHINGLE, F.sort_array(several)).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _words(text: str) -> Column:
    """Hashes of the words of a text, none if there is no word."""
    hashed = F.transform(F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), SPACE + "+"), lambda w: F.when(w != "", F.xxhash64(w)))
    return F.filter(hashed, lambda h: h.isNotNull())


def _once(hashes: Column) -> Column:
    return F.size(F.array_distinct(hashes)) == F.size(hashes)


def _entry(term: Column, log_weight: Column, version: int) -> Column:
    return F.struct(term.alias("term"), log_weight.alias("log_weight"), F.lit(version).alias("version"))


def _ones(hashes: Column, version: int) -> Column:
    return F.transform(hashes, lambda h: _entry(h, F.lit(0.0), version))


def _weighted(hashes: Column, version: int) -> Column:
    """Entries of a sorted array of hashes; its runs are looked for only where hashes repeat."""
    starts = F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (i == 1) | (F.element_at(hashes, i) != F.element_at(hashes, F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, 2, F.size(hashes)), F.array(F.size(hashes) + 1))
    runs = F.zip_with(starts, ends, lambda a, b: _entry(F.element_at(hashes, a), F.log((b - a).cast("double")), version))
    return F.when(F.size(hashes) == 0, F.array().cast(_ENTRIES)).when(_once(hashes), _ones(hashes, version)).otherwise(runs)


def with_terms(rows: DataFrame, text: str, other: str | None = None) -> DataFrame:
    """rows without the texts, and with (term, log_weight, version): a row per term, or one with nulls if there is none.

    Version 0 is a term of text, 1 one of other, and 2 one of both, where it occurs once in each."""
    texts = [text, *([other] if other else [])]
    keep = [c for c in rows.columns if c not in texts]
    for step in (_words, shingle_hashes):
        rows = rows.select(*keep, *[(step(t) if step is _words else step(F.col(t))).alias(t) for t in texts])
    if other is None:
        entries = _weighted(F.col(text), 0)
    else:
        a, b = F.col(text), F.col(other)
        shared = F.concat(_ones(F.array_intersect(a, b), 2), _ones(F.array_except(a, b), 0), _ones(F.array_except(b, a), 1))
        entries = F.when(_once(a) & _once(b), shared).otherwise(F.concat(_weighted(a, 0), _weighted(b, 1)))
    return rows.select(*keep, entries.alias("__terms")).select(*keep, F.inline_outer("__terms"))


def _unit(bits: Column, width: int) -> Column:
    """width bits as a number inside (0, 1)."""
    return (bits + F.lit(0.5)) * F.lit(2.0**-width)


def _packed(log_a: Column, name: Column) -> Column:
    """log_a lies between -75 and 4 for weights up to e**10, far within the fixed point."""
    return F.shiftleft(F.floor((log_a + 128) * F.lit(float(1 << 22))), 32).bitwiseOR(name.bitwiseAND(F.lit(_LOW)))


def sample_key(term: Column, log_weight: Column, number: int) -> Column:
    """ln a in fixed point above 32 bits that name the term and its t: the minimum is the sample.

    Of weight 1, t is 0, so that two logarithms are all that it costs; term is a hash and names itself."""
    one, two = F.xxhash64(term, F.lit(2 * number)), F.xxhash64(term, F.lit(2 * number + 1))
    r = -F.log(_unit(F.shiftrightunsigned(one, 32), 32) * _unit(one.bitwiseAND(F.lit(_LOW)), 32))
    c = -F.log(_unit(F.shiftrightunsigned(two, 42), 22) * _unit(F.shiftrightunsigned(two, 21).bitwiseAND(F.lit(0x1FFFFF)), 21))
    b = _unit(two.bitwiseAND(F.lit(0x1FFFFF)), 21)
    t = F.floor(log_weight / r + b)
    heavy = _packed(F.log(c) - r * (F.lit(1.0) - b + t), F.when(t == 0, term).otherwise(F.xxhash64(term, t)))
    return F.when(log_weight == 0, _packed(F.log(c) - r * (F.lit(1.0) - b), term)).otherwise(heavy)


def _names(samples: int) -> list[str]:
    return [f"__{k}" for k in range(samples)]


def _signature(least: list[Column]) -> Column:
    return F.array(*[F.coalesce(v.bitwiseAND(F.lit(_LOW)), F.lit(0).cast("long")) for v in least])


def _least_keys(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    least = [F.min(sample_key(F.col("term"), F.col("log_weight"), k)).alias(n) for k, n in enumerate(_names(samples))]
    return terms.groupBy(*keys).agg(*least)


def signatures(rows: DataFrame, text: str, samples: int = SAMPLES) -> DataFrame:
    """rows without text but with signature (array of 32-bit values as long); equal rows become one.
    A text without words has zeros."""
    keys = [c for c in rows.columns if c != text]
    made = _least_keys(with_terms(rows, text), keys, samples)
    return made.select(*keys, _signature([F.col(n) for n in _names(samples)]).alias("signature"))


def paired_signatures(rows: DataFrame, text: str, other: str, samples: int = SAMPLES) -> DataFrame:
    """As `signatures`, with signature of text and other_signature of other: what the two texts share is drawn once."""
    keys = [c for c in rows.columns if c not in (text, other)]
    made = _least_keys(with_terms(rows, text, other), [*keys, "version"], samples)
    own = [F.min(F.when(F.col("version") != 1, F.col(n))).alias(n) for n in _names(samples)]
    others = [F.min(F.when(F.col("version") != 0, F.col(n))).alias("other" + n) for n in _names(samples)]
    made = made.groupBy(*keys).agg(*own, *others)
    return made.select(*keys, _signature([F.col(n) for n in _names(samples)]).alias("signature"), _signature([F.col("other" + n) for n in _names(samples)]).alias("other_signature"))


def as_text(signature: Column, samples: int = SAMPLES) -> Column:
    """The signature as 8 hex digits per sample."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.element_at(signature, k + 1))), 8, "0") for k in range(samples)])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity. Two texts without
    words are alike, one with and one without are not."""
    equal = [F.when(F.element_at(a, k + 1) == F.element_at(b, k + 1), 1).otherwise(0) for k in range(samples)]
    return sum(equal[1:], equal[0]) / F.lit(float(samples))


def _long_array(numbers: list[int]) -> Column:
    """One literal after constant folding, however many numbers there are."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below key, searched in two steps; 0 for null."""
    step = max(1, math.isqrt(len(cuts)))
    full = F.size(F.filter(_long_array(cuts[step - 1 :: step]), lambda c: c < key)) * step
    return F.when(key.isNull(), 0).otherwise(full + F.size(F.filter(F.slice(_long_array(cuts), full + 1, step), lambda c: c < key)))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, text, next_text and the place of each row and of the next in the order of descending ids:
    (range, place), (next_range, next_place). After the last row comes the first.

    The ids are cut into ranges at ids that occur, and every range also gets a copy of the row that
    follows it, which is the first of the range below. Null ids come last, equal ids in the order of
    their texts' hashes."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    count = min(MOST_RANGES, max(1, math.ceil(ids.count() / rows_per_range)))
    found = ids.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count + 1)], 10 * count), F.max("doc_id")).first()
    cuts = sorted({*(found[0] or []), *([found[1]] if found[1] is not None else [])})
    if not cuts:
        rows = rows.withColumns({"range": F.lit(0), "role": F.lit(0)})
    else:
        own = F.struct(_range_of(F.col("doc_id"), cuts).alias("range"), F.lit(0).alias("role"))
        rows = rows.withColumn("own", own)
        head = F.col("doc_id") == F.get(_long_array(cuts), F.col("own.range"))
        last = F.col("own.range") == len(cuts) - 1
        copy = F.struct(F.when(last, 0).otherwise(F.col("own.range") + 1).alias("range"), F.when(last, 2).otherwise(1).alias("role"))
        rows = rows.select("doc_id", "text", F.inline(F.when(head, F.array("own", copy)).otherwise(F.array("own"))))
    order = Window.partitionBy("range").orderBy((F.col("role") == 2), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    ahead = F.lead("role").over(order)
    rows = rows.withColumns({
        "next_text": F.coalesce(F.lead("text").over(order), F.first("text").over(order)),
        "place": F.row_number().over(order),
        "ahead": ahead,
    })
    inside = F.col("ahead") == 0
    below = F.when(F.col("range") == 0, max(len(cuts) - 1, 0)).otherwise(F.col("range") - 1)
    return rows.filter("role = 0").select(
        "doc_id", "text", "next_text", "range", "place",
        F.when(inside, F.col("range")).otherwise(below).alias("next_range"),
        F.when(inside, F.col("place") + 1).otherwise(1).alias("next_place"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint per row of docs. A null text is the empty one: zeros. Rows that agree in id
    and text become one."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"), text_or_empty(text_col).alias("text"))
    return signatures(rows, "text", samples).select("doc_id", as_text(F.col("signature"), samples).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has the last half of the code points replaced by the beginning of the next text in
    the order of descending ids. Null texts count as empty; repeated rows are rows of their own; an only
    row is its own next. An empty table gives no rows."""
    rows = with_next(docs, id_col, text_col)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - floor(length(text) / 2))"), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "range", "place", "next_range", "next_place", F.length("text").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    made = shared_table(paired_signatures(rows, "text", "edited", samples), "weighted-signatures")
    following = made.select(F.col("range").alias("next_range"), F.col("place").alias("next_place"), F.col("signature").alias("next_signature"))
    joined = made.join(following, ["next_range", "next_place"])
    return joined.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        as_text(F.col("signature"), samples).alias("fingerprint"),
        as_text(F.col("other_signature"), samples).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("other_signature"), samples).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature"), samples).alias("near_next"),
    )
