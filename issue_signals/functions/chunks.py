"""Splitting texts under a token budget.

Tokens are white-space tokens unless the caller brings a tokenizer. No token is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import small_batches
from .text import NOT_SPACE, col, let

SPLITTERS = {
    "sentence": r"(?<=[\.\n])\s+",
    "paragraph": r"\n\n",
    "newline": r"\n",
}

TOKEN = NOT_SPACE + "+"

Tokenizer = tuple[Callable[[str], list], Callable[[list], str]]


def pieces(text: Column | str, strategy: str = "sentence") -> Column:
    return F.split(col(text), SPLITTERS[strategy], -1)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(TOKEN))


def windows_of(all_tokens: Column | str, size: Column | int) -> Column:
    """Consecutive windows of size tokens, the last one shorter; no tokens, no windows."""
    width = F.lit(size) if isinstance(size, int) else size

    def windows(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(found), width)
        cut = F.transform(starts, lambda i: F.array_join(F.slice(found, i, width), " "))
        return F.when(F.size(found) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(col(all_tokens), windows)


def token_windows(text: Column | str, size: Column | int) -> Column:
    return windows_of(tokens(text), size)


def token_budget(prompt_tokens: Column | int, model_limit: int = 8192, reserve: int = 8) -> Column:
    """Tokens left for the text beside the prompt and the answer, never under 32."""
    used = F.lit(prompt_tokens) if isinstance(prompt_tokens, int) else prompt_tokens
    return F.greatest(F.lit(32), F.lit(min(model_limit, 8192)) - used - F.lit(reserve))


def fit_context(text: Column | str, context: int, answer_tokens: int = 2) -> Column:
    """The trailing tokens that leave room for the answer."""

    def tail(all_tokens: Column) -> Column:
        keep = F.least(F.size(all_tokens), F.lit(context - answer_tokens))
        last = F.slice(all_tokens, F.size(all_tokens) - keep + F.lit(1), keep)
        return F.when(keep > 0, F.array_join(last, " ")).otherwise(F.lit(""))

    return let(tokens(text), tail)


def _white_space() -> Tokenizer:
    return str.split, " ".join


def _packed(counted: list[tuple[str, int]], budget: int) -> list[str]:
    found: list[list[str]] = []
    used = 0
    for piece, n in counted:
        if found and used + n <= budget:
            found[-1].append(piece)
            used += n
        else:
            found.append([piece])
            used = n
    return [" ".join(chunk).strip() for chunk in found]


def packer(
    limits: Sequence[int], strategy: str = "sentence", tokenizer: Callable[[], Tokenizer] = _white_space
) -> Callable[[Column], Column]:
    """A column function: text -> for each token limit the list of chunks.

    Neighbouring pieces are packed greedily into chunks of at most the limit; a piece above it stays
    whole, as a chunk of its own. Packing is a running sum with restarts over the pieces of one text.
    As a fold expression it took thirty times as long as this Arrow function, which splits and counts
    a text once for all limits.
    """
    small_batches()

    @F.arrow_udf("array<array<string>>")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, _ = tokenizer()
        boundary = re.compile(SPLITTERS[strategy])

        def chunks(text: str | None) -> list[list[str]]:
            counted = [(p, len(encode(p))) for p in boundary.split(text or "") if p.strip()]
            return [_packed(counted, limit) for limit in limits]

        for texts in batches:
            yield pa.array([chunks(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.string())))

    return pack


def packed_chunks(text: Column | str, max_tokens: int, strategy: str = "sentence") -> Column:
    return F.get(packer([max_tokens], strategy)(col(text)), F.lit(0))


def _line_chunks(text: str, encode: Callable, decode: Callable, budget: int) -> list[str]:
    def fits(t: str) -> bool:
        return len(encode(t)) <= budget

    if fits(text):
        return [text]
    found: list[str] = []
    held = ""
    for line in text.split("\n"):
        if held and not fits(held + line):
            found.append(held.strip())
            held = ""
        if fits(held + line):
            held += line + "\n"
            continue
        for part in filter(str.strip, line.split(".")):
            ids = encode(part)
            windows = range(0, len(ids), budget)
            found.extend([part.strip()] if len(ids) <= budget else [decode(ids[i : i + budget]) for i in windows])
    if held.strip():
        found.append(held.strip())
    return found


def line_chunker(max_tokens: int = 512, tokenizer: Callable[[], Tokenizer] = _white_space) -> Callable[[Column], Column]:
    """A column function: text -> chunks that prefer to end at a newline, then at a full stop.

    A sentence above the budget is cut into windows.
    tokenizer is a factory that each Python worker calls once.
    """
    small_batches()

    @F.arrow_udf("array<string>")
    def chunk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, decode = tokenizer()
        for texts in batches:
            yield pa.array([[] if t is None else _line_chunks(t, encode, decode, max_tokens) for t in texts.to_pylist()], pa.list_(pa.string()))

    return chunk
