"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes its share of the corpus in groups of documents, collects the distinct pieces that it has
not met, and replays the merges over all of them together. An inverted index maps the rank of a token
pair to the places where the pair stands; the ranks are taken in order from a heap, all places of a
rank are merged at once, and a merge touches nothing but its two neighbours, whose pairs are entered
anew. Which pieces are replayed together doesn't change their ids, so the documents need no shuffle
and a lost task is just run again.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from issue_signals.llm.common import small_batches, together

#: Words, and pieces, whose ids a worker remembers until it forgets those that it didn't meet since the
#: last time. Characters of texts taken together.
MAX_KNOWN, GROUP_CHARS = 150_000, 2 << 20


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: bytes of each token with its rank, which is its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    found = ranks(path)
    table = [b""] * (max(found.values()) + 1)
    for token, rank in found.items():
        table[rank] = token
    return table


def vocabulary_size(path: str) -> int:
    """The first free id."""
    return len(tokens(path))


@lru_cache(maxsize=2)
def _pairs(path: str) -> tuple[np.ndarray, np.ndarray, frozenset[int]]:
    """Every pair of tokens that makes a token: the pair's code, sorted, and the rank of what it makes;
    and the ranks that some pair of a lower rank contains."""
    vocabulary = ranks(path)
    made = [
        (vocabulary[token[:i]] << 20 | vocabulary[token[i:]], rank)
        for token, rank in vocabulary.items()
        for i in range(1, len(token))
        if token[:i] in vocabulary and token[i:] in vocabulary
    ]
    codes, rank = np.array(sorted(made), np.int64).T if made else np.zeros((2, 0), np.int64)
    parts = np.concatenate([codes >> 20, codes & 0xFFFFF])
    return codes, rank, frozenset(parts[parts > np.concatenate([rank, rank])].tolist())


def replay(pieces: list[bytes], path: str) -> list[bytes]:
    """The ids of every piece, as little-endian 32-bit integers in a row: what merging the lowest-ranked,
    leftmost pair of a piece again and again gives.

    All pieces lie in one array with a gap after each. Places of a rank in one piece are merged at once,
    but where the new token may be part of a pair of a lower rank: there the leftmost goes first and
    the others wait until the lower ranks have been applied."""
    codes, made, early = _pairs(path)
    vocabulary = ranks(path)
    of_byte = np.array([vocabulary[bytes([b])] for b in range(256)], np.int64)
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths + 1)
    size = int(ends[-1]) if len(ends) else 0
    ids = np.full(size, -1, np.int64)
    inside = np.ones(size, bool)
    inside[ends - 1] = False
    ids[inside] = of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), lengths + 1)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    rank_at = np.full(size + 1, -1, np.int64)
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def distinct(places: np.ndarray) -> np.ndarray:
        ordered = np.sort(places)
        return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]

    def enter(left: np.ndarray) -> None:
        """Set the ranks of the pairs that start at left, and index those that make a token."""
        pair = ids[left] << 20 | ids[np.minimum(after[left], size - 1)]  # negative at a gap, as no code is
        at = np.minimum(np.searchsorted(codes, pair), len(codes) - 1)
        hit = codes[at] == pair
        rank_at[left] = -1
        left, found = left[hit], made[at[hit]]
        if not len(left):
            return
        rank_at[left] = found
        order = np.argsort(found, kind="stable")
        found, left = found[order], left[order]
        cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
        for a, b, rank in zip(cuts, cuts[1:], found[cuts[:-1]].tolist()):
            if rank in places:
                places[rank].append(left[a:b])
            else:
                places[rank] = [left[a:b]]
                heapq.heappush(heap, rank)

    if len(codes):
        enter(np.flatnonzero(inside))
    while heap:
        rank = heapq.heappop(heap)
        groups = places.pop(rank)
        left = groups[0] if len(groups) == 1 else distinct(np.concatenate(groups))
        left = left[rank_at[left] == rank]
        if len(left) > 1:
            if rank in early:
                of = piece[left]
                again = of[1:] == of[:-1]
                if again.any():
                    places[rank] = [left[1:][again]]
                    heapq.heappush(heap, rank)
                    left = np.concatenate([left[:1], left[1:][~again]])
            else:  # of places that overlap every second one
                overlaps = after[left[:-1]] == left[1:]
                if overlaps.any():
                    number = np.arange(len(left))
                    fresh = np.concatenate([[True], ~overlaps])
                    left = left[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
        if not len(left):
            continue
        right = after[left]
        beyond = after[right]
        ids[left] = rank
        rank_at[right] = -1
        inside[right] = False
        after[left] = beyond
        before[beyond] = left
        lower = before[left]
        lower = lower[lower >= 0]
        changed = np.concatenate([left, lower[ids[lower] >= 0]])
        enter(changed if len(changed) == 1 else distinct(changed))
    kept = ids[inside].astype("<i4").tobytes()
    bounds = np.concatenate([[0], np.cumsum(np.add.reduceat(inside, ends - lengths - 1) if size else [])]).astype(int) * 4
    return [kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


@lru_cache(maxsize=2)
def _known(path: str, pattern: str) -> tuple[regex.Pattern, dict[str, bytes], dict[str, bytes | None], dict[str, bytes | None]]:
    """The compiled pattern, the ids of pieces, and the ids of the words that follow a space: those met
    lately, and those met before."""
    return regex.compile(pattern), {}, {}, {}


def _learn(groups: Iterable[Iterable[str]], path: str, pattern: str) -> None:
    pieces = _known(path, pattern)[1]
    new = list(set().union(*groups).difference(pieces))
    if len(pieces) + len(new) > MAX_KNOWN:
        pieces.clear()
        new = list(set().union(*groups))
    pieces.update(zip(new, replay([p.encode() for p in new], path)))


def forget(path: str, pattern: str) -> None:
    """Give back what a task has remembered: the next one in this worker starts over."""
    for known in _known(path, pattern)[1:]:
        known.clear()


def _by_pieces(text: str, path: str, pattern: str) -> bytes:
    """The ids of a text of any form; a very long one is taken part by part."""
    compiled, pieces, *_ = _known(path, pattern)
    found = iter(compiled.findall(text)) if len(text) < GROUP_CHARS else (m.group() for m in compiled.finditer(text))
    out = []
    while group := list(islice(found, 1_000_000)):
        _learn([group], path, pattern)
        out.append(b"".join([pieces[p] for p in group]))
    return b"".join(out)


def encode_texts(texts: list[str], path: str, pattern: str) -> list[bytes]:
    """For every text its ids, as little-endian 32-bit integers in a row.

    Where one space or line break stands between two other characters, no piece of the pattern crosses
    it, and what follows it is the same everywhere. So a text is cut there into words whose ids are
    remembered; a text with other white space at a cut goes through the pattern as a whole."""
    compiled, pieces, words, earlier = _known(path, pattern)
    cut = [t.replace("\n", " \n").split(" ") for t in texts]
    new = set().union(*(c[1:] for c in cut)).difference(words)
    if len(words) + len(new) > MAX_KNOWN:
        earlier.clear()
        earlier.update(words)
        words.clear()
        new = set().union(*(c[1:] for c in cut))
    again = new & earlier.keys()
    words.update((w, earlier[w]) for w in again)
    new -= again
    parted: dict[str, list[str]] = {}
    for word in new:
        body = word[1:] if word[:1] == "\n" else word
        if body and not body[0].isspace() and not body[-1].isspace():
            parted[word] = compiled.findall(word if word is not body and word[0] == "\n" else " " + word)
        else:
            words[word] = None
    heads = [compiled.findall(c[0]) if c[0] and not c[0][-1].isspace() else [] for c in cut]
    _learn([*parted.values(), *heads], path, pattern)
    words.update((w, b"".join([pieces[p] for p in found])) for w, found in parted.items())
    firsts = [b"".join([pieces[p] for p in head]) for head in heads]
    out = []
    for text, chunks, first in zip(texts, cut, firsts):
        if len(chunks) == 1 and first:
            out.append(first)
            continue
        found = [words[w] for w in islice(chunks, 1, None)]
        out.append(_by_pieces(text, path, pattern) if not first or None in found else first + b"".join(found))
    return out


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def decode_ids(ids: Iterable[int], path: str) -> bytes:
    """The bytes of the tokens, one after the other. An id outside the vocabulary is an IndexError."""
    return b"".join(map(tokens(path).__getitem__, ids))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids (array<int>). No special tokens; a null or empty text has none.

    The pattern parts a text into pieces that are encoded separately. Nulls in the id and repeated ids
    pass through; other columns are not read. An empty table gives no rows."""
    small_batches(docs.sparkSession)
    pattern = pattern or default_pattern()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches, GROUP_CHARS):
            parts = encode_texts([t or "" for t in batch.column("text").to_pylist()], path, pattern)
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])
        forget(path, pattern)

    return rows.mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: Column, path: str) -> Column:
    """The bytes that a column of ids stands for; null for null."""

    @F.arrow_udf(BinaryType())
    def decode(column: pa.Array) -> pa.Array:
        table = tokens(path)
        flat, ends, valid = column.values, column.offsets.to_numpy(), column.is_valid().to_pylist()
        out = []
        for k in range(len(column)):
            if not valid[k]:
                out.append(None)
                continue
            row = flat.slice(ends[k], ends[k + 1] - ends[k]).to_numpy().tolist()
            out.append(b"".join(map(table.__getitem__, row)))
        return pa.array(out, pa.binary())

    return decode(ids)
