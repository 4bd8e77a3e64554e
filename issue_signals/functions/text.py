"""Text column expressions.

Everything here is a native expression: it runs in the JVM, row by row, without a shuffle.
Texts are taken whole; where a model has an input limit the caller passes max_chars.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    CONTENT_TYPE_WORDS,
    CONTEXT_WORDS,
    INVALID_CONTEXT,
    INVALID_SENTIMENT_TEXT,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    REASON_PHRASES,
    TITLE_CHARS,
)

# Unicode white space plus the four separators that Python also counts as white space.
SPACE = r"(?U)[\s\x1c-\x1f]+"
NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once. A plain Column used several times, or inside a lambda, would be
    computed anew at each use and for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cap(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def squeeze(text: Column) -> Column:
    """White-space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip(text: Column) -> Column:
    """White space off both ends; looks at the ends only."""
    return F.btrim(text, F.lit(SPACES))


def any_substring(lowered: Column, words: Sequence[str]) -> Column:
    if not words:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in words])


def count_present(lowered: Column, words: Sequence[str]) -> Column:
    """How many of the words occur; a word counts once however often it occurs."""
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(w)).cast("int") for w in words], F.lit(0))


# ---------------------------------------------------------------------------- cleaning

def clean_issue_text(text: Column | str) -> Column:
    """Letters only, lower case, single blanks."""
    letters = F.regexp_replace(col(text), "[^a-zA-Z]+", " ")
    return F.trim(F.lower(letters))


def drop_model_markers(text: Column | str) -> Column:
    return squeeze(F.regexp_replace(col(text), r"\[CLS\]|\[SEP\]", ""))


def is_valid_text(text: Column | str) -> Column:
    """Not blank, at most five [UNK], at most 30 % non-ASCII characters; NULL is not valid."""
    t = col(text)
    non_ascii = F.length(F.regexp_replace(t, r"[\x00-\x7F]+", ""))
    unknown = F.regexp_count(t, F.lit(r"\[UNK\]"))
    return F.coalesce(
        F.rlike(t, F.lit(NOT_SPACE)) & (unknown <= 5) & (non_ascii <= F.lit(0.30) * F.length(t)), F.lit(False)
    )


def clean_for_sentiment(text: Column | str, max_chars: int | None = None) -> Column:
    t = col(text)
    return F.when(is_valid_text(t), cap(drop_model_markers(t), max_chars)).otherwise(F.lit(INVALID_SENTIMENT_TEXT))


# ---------------------------------------------------------------------------- heuristics

def content_type(text: Column | str, words: dict[str, Sequence[str]] = CONTENT_TYPE_WORDS) -> Column:
    """First type, in the order of the table, with a word inside the text; else general."""

    def first_hit(lowered: Column) -> Column:
        hits = [F.when(any_substring(lowered, ws), F.lit(name)) for name, ws in words.items()]
        return F.coalesce(*hits, F.lit("general"))

    return let(F.lower(col(text)), first_hit)


def _attribute_words(attribute: Column) -> Column:
    """struct(phrase, words): the lowered attribute and, if it has several words, the long ones."""
    words = F.split(squeeze(F.lower(attribute)), " ")
    long_words = F.filter(words, lambda w: F.length(w) > 3)
    none = F.array().cast("array<string>")
    return F.struct(F.lower(attribute).alias("phrase"), F.when(F.size(words) > 1, long_words).otherwise(none).alias("words"))


def _mentions(lowered: Column, attribute: Column) -> Column:
    return F.contains(lowered, attribute["phrase"]) | F.exists(attribute["words"], lambda w: F.contains(lowered, w))


def is_relevant(text: Column | str, attribute: Column | str) -> Column:
    """The attribute, or a word of more than three letters of one with several words, is in the text."""
    pair = F.struct(F.lower(col(text)).alias("text"), _attribute_words(col(attribute)).alias("attribute"))
    return F.coalesce(let(pair, lambda p: _mentions(p["text"], p["attribute"])), F.lit(False))


def override_sentiment(
    text: Column | str,
    sentiment: Column | str,
    confidence: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """struct(sentiment, confidence): flipped to the clear majority of cue words when the
    model was less than 0.90 sure."""
    s, c = col(sentiment), col(confidence)

    def decide(cues: Column) -> Column:
        unsure = c < 0.90
        flipped = F.when(unsure & (s == "-") & (cues["pos"] > cues["neg"] * 2), F.lit("+")).when(
            unsure & (s == "+") & (cues["neg"] > cues["pos"] * 2), F.lit("-")
        )
        return F.struct(
            F.coalesce(flipped, s).alias("sentiment"),
            F.when(flipped.isNotNull(), F.lit(0.70)).otherwise(c).alias("confidence"),
        )

    return let(cue_counts(text, positive, negative), decide)


def cue_counts(text: Column | str, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """struct(pos, neg): distinct words of either list that occur in the text."""
    return let(
        F.lower(col(text)),
        lambda t: F.struct(count_present(t, positive).alias("pos"), count_present(t, negative).alias("neg")),
    )


def split_sentences(text: Column | str) -> Column:
    """Split after . ! ? and white space."""
    return F.split(col(text), r"(?<=[.!?])\s+")


def _joined(sentences: Column) -> Column:
    return F.when(F.size(sentences) > 0, F.array_join(sentences, " "))


def meaningful_context(
    text: Column | str,
    attribute: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    type_words: dict[str, Sequence[str]] = CONTENT_TYPE_WORDS,
    context_words: dict[str, Sequence[str]] = CONTEXT_WORDS,
) -> Column:
    """One or two sentences that show the attribute in the text.

    The two short sentences that mention it with most polarity words; else the first two with a
    word of the text's content type; else its title; else its first thirty words.
    """
    t, polarity = col(text), [*positive, *negative]

    def sentences_of(clean: Column) -> Column:
        """Sentences of at least three words and at most 200 characters, each with its lowered form."""
        usable = F.filter(
            split_sentences(clean), lambda s: (F.length(s) <= 200) & (F.regexp_count(s, F.lit("[^ ]+")) >= 3)
        )
        return F.transform(usable, lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("lowered")))

    def most_opinionated(about: Column) -> Column:
        ranked = F.transform(
            about,
            lambda s, i: F.struct(
                (-count_present(s["lowered"], polarity)).alias("rank"), i.alias("position"), s["sentence"].alias("sentence")
            ),
        )
        return F.transform(F.slice(F.array_sort(ranked), 1, 2), lambda r: r["sentence"])

    def hits_of(p: Column) -> list[Callable[[Column], Column]]:
        return [
            lambda s, name=name, ws=ws: (p["kind"] == name) & any_substring(s["lowered"], ws)
            for name, ws in context_words.items()
        ]

    def choose(p: Column) -> Column:
        about = F.filter(p["sentences"], lambda s: _mentions(s["lowered"], p["attribute"]))
        typed = F.filter(
            p["sentences"],
            lambda s: (F.length(s["sentence"]) < 200) & reduce(lambda x, y: x | y, [h(s) for h in hits_of(p)]),
        )
        first_typed = F.transform(F.slice(typed, 1, 2), lambda s: s["sentence"])
        return F.coalesce(
            let(most_opinionated(about), _joined), let(first_typed, _joined), short_title(p["clean"]), preview(p["clean"])
        )

    def short_title(clean: Column) -> Column:
        title = F.trim(F.regexp_extract(clean, r"(?i)title:\s*([^\n]+)", 1))
        shortened = F.concat(F.substring(title, 1, TITLE_CHARS), F.lit("..."))
        return F.when(F.length(title) > TITLE_CHARS, shortened).when(title != "", title)

    def preview(clean: Column) -> Column:
        return F.concat(F.array_join(F.slice(F.split(clean, " "), 1, 30), " "), F.lit("..."))

    def parts(clean: Column) -> Column:
        return F.struct(
            clean.alias("clean"),
            content_type(clean, type_words).alias("kind"),
            sentences_of(clean).alias("sentences"),
            _attribute_words(col(attribute)).alias("attribute"),
        )

    context = let(let(drop_model_markers(t), parts), choose)
    return F.when(is_valid_text(t), context).otherwise(F.lit(INVALID_CONTEXT))


def sentiment_reason(
    text: Column | str,
    attribute: Column | str,
    sentiment: Column | str,
    confidence: Column | str,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    type_words: dict[str, Sequence[str]] = CONTENT_TYPE_WORDS,
    context_words: dict[str, Sequence[str]] = CONTEXT_WORDS,
) -> Column:
    """A sentence that names sentiment, confidence, attribute and context."""
    t, a, s, c = col(text), col(attribute), col(sentiment), col(confidence)

    def opening(label: Column, sure: Column) -> Column:
        name = F.when(label == "+", F.lit("Positive")).otherwise(F.lit("Negative"))
        # format_number rounds the exact binary value, half to even.
        return F.concat(name, F.lit(" sentiment ("), F.format_number(sure, 2), F.lit(") about "), a, F.lit(": "))

    def compose(p: Column) -> Column:
        final = p["final"]
        phrase = F.coalesce(
            *[
                F.when(p["kind"] == name, F.when(final["sentiment"] == "+", F.lit(good)).otherwise(F.lit(bad)))
                for name, (good, bad) in REASON_PHRASES.items()
            ]
        )
        start = F.when(p["relevant"], phrase).otherwise(F.lit("Content may indirectly relate to"))
        return F.concat(
            opening(final["sentiment"], final["confidence"]), start, F.lit(" "), F.lower(a), F.lit(". "), p["context"]
        )

    parts = F.struct(
        content_type(t, type_words).alias("kind"),
        override_sentiment(t, s, c, positive, negative).alias("final"),
        is_relevant(t, a).alias("relevant"),
        meaningful_context(t, a, positive, negative, type_words, context_words).alias("context"),
    )
    return F.when(is_valid_text(t), let(parts, compose)).otherwise(F.concat(opening(s, c), F.lit(INVALID_CONTEXT)))


# ---------------------------------------------------------------------------- small parsers

def related_words(words: Column | str) -> Column:
    """Comma list or list literal -> array of trimmed, non-empty words. Data is never evaluated."""
    bare = F.regexp_replace(col(words), r"""[\[\]'"]""", "")
    return F.coalesce(
        F.filter(F.transform(F.split(bare, ","), lambda w: squeeze(w)), lambda w: w != ""),
        F.array().cast("array<string>"),
    )


def repository_path(url: Column | str) -> Column:
    return F.replace(col(url), F.lit("https://github.com/"), F.lit(""))


def comments_url(issue_url: Column | str) -> Column:
    return F.concat(col(issue_url), F.lit("/comments"))


def is_repository_url(url: Column | str) -> Column:
    return F.coalesce(F.contains(col(url), F.lit("github.com")), F.lit(False))


def normal_answer(answer: Column | str) -> Column:
    return F.coalesce(F.lower(squeeze(col(answer))) == "yes", F.lit(False))


def nan_to_null(value: Column | str) -> Column:
    v = col(value)
    return F.when(~F.isnan(v), v)


def utc_timestamp(text: Column | str) -> Column:
    """ISO-8601 text to a timestamp; text that is none gives NULL."""
    return F.try_to_timestamp(col(text))


def verdict_json(label: Column | str, score: Column | str) -> Column:
    return F.to_json(F.struct(col(label).alias("label"), col(score).alias("score")))


def graded_label(is_related: Column | str) -> Column:
    g = col(is_related)
    return (
        F.when(g == 1.0, F.lit("maybe-relevant"))
        .when(g == 0.5, F.lit("maybe-not-relevant"))
        .when(g == 0.0, F.lit("not-relevant"))
    )
