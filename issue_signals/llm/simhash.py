"""SimHash near-dedup by pigeonhole blocks.

The 64 bits of a fingerprint are cut into BLOCKS blocks. Two fingerprints that differ in at most
`bits` bits agree in at least BLOCKS - bits blocks, so every choice of that many blocks is a key and
a close pair shares at least one. Only distinct fingerprints are dealt by their keys; those that share
a key are sorted next to each other and verified by Hamming distance in bulk. What a task hands on is
a spanning forest of the links that it found, never the pairs of a group, and a group that is large
is cut again by blocks of the bits that its key leaves open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issue_signals.llm.common import shared_table, small_batches, text_or_empty, whole_row
from issue_signals.llm.components import components

SHINGLE, SEED = 3, 42
#: Bits in which linked fingerprints may differ, and blocks: 20 keys of 31 to 33 bits.
BITS, BLOCKS = 3, 6
#: Rows verified together; group size up to which neighbours are compared by offset, and pairwise.
_ROWS, _NEAR, _DENSE = 200_000, 16, 1_500
_PART = 1 << 22
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def _parts(text: bytes, shingle: int) -> Iterator[list[bytes]]:
    """The lower-case words of the text, some megabytes at a time; parts overlap by shingle - 1 words."""
    if len(text) <= _PART:
        yield text.lower().split()
        return
    carry: list[bytes] = []
    at = 0
    while at < len(text):
        end = _SPACE.search(text, min(at + _PART, len(text)))
        end = end.start() if end else len(text)
        words = carry + text[at:end].lower().split()
        if len(words) >= shingle or end == len(text):
            yield words
            carry = words[1 - shingle :]
        else:
            carry = words
        at = end


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[list[int]]:
    """The hashes of the shingles, part by part; of fewer words the one of all words; of none nothing.

    bytes.lower and bytes.split are those of ASCII: A-Z, and white space [\\x20\\x09-\\x0D]."""
    digest, any_ = xxhash.xxh64_intdigest, False
    for words in _parts(text, shingle):
        if not words:
            continue
        if len(words) < shingle:
            if any_:
                continue
            hashes = [digest(b" ".join(words), SEED)]
        else:
            joined = b" ".join(words)
            starts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist())]
        any_ = True
        yield hashes


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the shingles, repeats included."""
    counts, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += len(hashes)
        packed = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
        for a in range(0, len(packed), 16_384):
            counts += np.unpackbits(packed[a : a + 16_384], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, simhash (the 64 bits as a signed long) per row of docs. No words: 0."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "simhash"])

    return rows.mapInArrow(compute, "doc_id long, text_hash long, simhash long")


def masks(bits: int = BITS, blocks: int = BLOCKS) -> list[int]:
    """The bits of each key, as 64-bit masks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(block, blocks - bits)]


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of size nodes the smallest node that the links a-b reach."""
    label = np.arange(size)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _dense(values: np.ndarray, at: np.ndarray, free: list[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one group: values[at] agree outside the positions in free."""
    if len(at) <= _DENSE or len(free) <= bits + 1:
        own = values[at]
        step = max(1, 1_000_000 // len(at))
        for k in range(0, len(at), step):
            x, y = np.nonzero(np.bitwise_count(own[k : k + step, None] ^ own[None, :]) <= bits)
            link = x + k < y
            if link.any():
                # a forest of the slice's links stands for them
                label = _forest(len(at), x[link] + k, y[link])
                moved = np.flatnonzero(label != np.arange(len(at)))
                yield at[moved], at[label[moved]]
        return
    cuts = [round(len(free) * k / (bits + 1)) for k in range(bits + 2)]
    for k in range(bits + 1):
        inside = free[cuts[k] : cuts[k + 1]]
        part = values[at] & np.uint64(sum(1 << p for p in inside))
        order = np.argsort(part, kind="stable")
        rest = [p for p in free if p not in inside]
        for group in np.split(at[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(group) > 1:
                yield from _dense(values, group, rest, bits)


def _links(key: np.ndarray, values: np.ndarray, which: np.ndarray, bits: int, wide: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among rows that are sorted by (which, key); as pairs of fingerprints."""
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (which[1:] != which[:-1])])
    group = np.cumsum(fresh) - 1
    sizes = np.bincount(group)
    near = np.flatnonzero(sizes[group] <= _NEAR)
    found = []
    for step in range(1, _NEAR):
        near = near[near + step < len(values)]
        near = near[group[near] == group[near + step]]
        if not len(near):
            break
        close = near[np.bitwise_count(values[near] ^ values[near + step]) <= bits]
        found.append((close, close + step))
    starts = np.flatnonzero(fresh)
    for g in np.flatnonzero(sizes > _NEAR).tolist():
        at = np.arange(starts[g], starts[g] + sizes[g])
        mask = wide[int(which[at[0]])]
        found += _dense(values, at, [p for p in range(64) if not mask >> p & 1], bits)
    if not found:
        return values[:0], values[:0]
    distinct, node = np.unique(values, return_inverse=True)
    label = _forest(len(distinct), *(node[np.concatenate(side)] for side in zip(*found)))
    moved = np.flatnonzero(label != np.arange(len(distinct)))
    return distinct[moved], distinct[label[moved]]


def close_links(prints: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) that connect exactly those of the distinct simhash values of prints that chains of
    pairs within `bits` bits connect."""
    small_batches(prints.sparkSession)
    wide = masks(bits, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in wide]
    keys = F.array(*[F.struct(F.lit(k).alias("which"), F.col("simhash").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    dealt = prints.select("simhash").distinct().select("simhash", F.inline(keys)).repartition("which", "key")
    dealt = dealt.sortWithinPartitions("which", "key").select("which", "key", "simhash")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            table = np.concatenate(held) if held else np.zeros((0, 3), np.int64)
            end = len(table)
            if not last:  # the last group may go on
                end = int(np.flatnonzero((table[:, :2] != table[-1, :2]).any(axis=1)).max(initial=-1)) + 1
            ready, rest = table[:end], table[end:]
            held, rows = [rest], len(rest)
            if len(ready):
                u, v = _links(ready[:, 1], ready[:, 2].view(np.uint64), ready[:, 0], bits, wide)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        limit = _ROWS
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("which", "key", "simhash")], axis=1))
            rows += len(batch)
            if rows >= limit:
                yield from flush(False)
                limit = rows + _ROWS  # a group that is larger than that is met whole
        yield from flush(True)

    return dealt.mapInArrow(verify, "u long, v long")


def standing(prints: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """From prints (doc_id, text_hash, key) and the components (node, component) of the values of key, the row
    that stands for the component of each value: key, stays (no_id, doc_id, text_hash)."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    least = prints.groupBy(key).agg(F.min(row).alias("least"))
    named = least.join(linked, least[key] == linked["node"], "left").select(key, "least", F.coalesce("component", key).alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("stays"))
    return named.join(smallest, "component").select(key, "stays")


def _classes(docs: DataFrame, id_col: str, text_col: str, bits: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of docs, and the row that stands for each fingerprint's component."""
    prints = shared_table(fingerprints(docs, id_col, text_col), "simhash")
    return prints, standing(prints, components(close_links(prints, bits, blocks)), "simhash")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of docs: doc_id, simhash, component_id.

    component_id is the smallest id that links reach, the row's own included; equal fingerprints are
    linked. A null or blank text has fingerprint 0 and is linked like any other. Rows with a null id
    link others but are never a component's id, which is null if no row of it has an id. Repeated rows
    are repeated in the result. An empty table gives no rows."""
    prints, classes = _classes(docs, id_col, text_col, bits, blocks)
    return prints.join(classes, "simhash").select("doc_id", "simhash", F.col("stays.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row of docs of each component, with all its columns, whatever their names: the one with the smallest id (a
    null id comes last), and of rows that share it the one with the smallest hash of its text; of rows that are alike in
    both one. Null, empty and very long texts and an empty table are met as in `near_duplicates`."""
    _, classes = _classes(docs, id_col, text_col, bits, blocks)
    return only_standing(docs, classes, id_col, text_col)


def only_standing(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each different `stays` of classes."""
    on = ["id", "no_id", "hash"]
    stays = classes.select("stays").distinct().select(F.coalesce("stays.doc_id", F.lit(0)).alias("id"), F.col("stays.no_id").alias("no_id"), F.col("stays.text_hash").alias("hash"))
    key = F.col(f"`{id_col}`").cast("long")
    text_hash = F.xxhash64(F.encode(text_or_empty(text_col), "UTF-8"))
    rows = docs.select(whole_row(docs), F.coalesce(key, F.lit(0)).alias("id"), key.isNull().alias("no_id"), text_hash.alias("hash"))
    first = Window.partitionBy(*on).orderBy(F.lit(0))
    return rows.join(stays, on, "left_semi").withColumn("place", F.row_number().over(first)).filter("place = 1").select("row.*")
