"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of MATCH bytes that covers it also starts anywhere else, in any text.

1. Anchors. In every string of MATCH bytes the GRAM bytes with the smallest hash (the leftmost of
   equals) are its anchor: equal strings have the same anchor at the same place. Each anchor stands
   for the run of strings that chose it; only anchors whose hash occurs twice go on. That leaves one
   suffix in some 170, and loses no repeat.
2. Suffixes. The bytes from an anchor on, as far as its strings reach, are sorted in each task and
   front-coded: the length of the prefix shared with the one before, and the rest. The bytes before
   the anchor go with them. The runs are exchanged by the anchor's hash, equal suffixes of a task as one.
3. Merge. A loser tree merges the runs of a target. It knows for every run the prefix that its head
   shares with the last suffix given out, decides by these lengths alone where they differ, and
   otherwise compares from there on; known prefixes are never compared again. The lengths come out
   with the sorted suffixes: strings that start l bytes before their anchors are equal if MATCH - l
   bytes agree after it (a run of the sorted order) and l bytes before it.
   The suffixes of a hash that occurs more than HOT times don't meet in a task: their strings of MATCH
   bytes are counted by digest, combined before the shuffle.
4. The covered range of a suffix goes back to all texts that hold it, by a join on its digest.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issue_signals.llm.common import SMALL_PAGES, shared_table, small_reads, text_or_empty
from issue_signals.session import small_batches

MATCH, GRAM = 400, 64
#: Bytes of text hashed together, of suffixes sorted together, and of suffixes merged in one task.
SEGMENT, RUN_BYTES, TARGET_BYTES = 1 << 18, 24 << 20, 16 << 20
#: Suffixes of one anchor hash up to which they are merged in one task.
HOT = TARGET_BYTES // (2 * MATCH - GRAM)
_SPAN = "array<struct<start:int,stop:int>>"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and the powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    powers, back = (np.full(SEGMENT + 2 * MATCH, x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    powers[0] = back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    return np.random.default_rng(5).integers(0, 1 << 63, 256, np.uint64), powers, back


def _choices(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start of MATCH bytes the place of its anchor, and the hashes of all places."""
    of_byte, powers, back = _tables()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(of_byte[data] * powers[: len(data)], dtype=np.uint64)])
    hashes = (sums[GRAM:] - sums[:-GRAM]) * back[: len(data) - GRAM + 1]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    least = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, MATCH - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every text its anchors: hash, place, and the first and last start of the strings that chose it."""
    none = np.zeros(0, np.int64)
    found = [(none.view(np.uint64), none, none, none)] * len(texts)

    def runs(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        return chosen[first], first

    def together(group: list[int]) -> None:
        data = np.frombuffer(b"".join([texts[k] for k in group]), np.uint8)
        chosen, hashes = _choices(data)
        at = 0
        for k in group:
            size = len(texts[k])
            place, first = runs(chosen[at : at + size - MATCH + 1])
            found[k] = hashes[place], place - at, first, np.append(first[1:] - 1, size - MATCH)
            at += size

    group, held = [], 0
    for k, text in enumerate(texts):
        if len(text) < MATCH:
            continue
        if len(text) <= SEGMENT:
            if held + len(text) > SEGMENT:
                together(group)
                group, held = [], 0
            group.append(k)
            held += len(text)
            continue
        parts = []  # a long text segment by segment; segments overlap by what a string needs
        for at in range(0, len(text) - MATCH + 1, SEGMENT):
            chosen, hashes = _choices(np.frombuffer(text, np.uint8, min(SEGMENT + MATCH - 1, len(text) - at), at))
            place, first = runs(chosen)
            parts.append((hashes[place], place + at, first + at))
        hashes, place, first = (np.concatenate(x) for x in zip(*parts))
        fresh = np.diff(place, prepend=-1) != 0
        first = first[fresh]
        found[k] = hashes[fresh], place[fresh], first, np.append(first[1:] - 1, len(text) - MATCH)
    if group:
        together(group)
    return found


def _mismatch(x: bytes, y: bytes, at: int) -> int:
    """The first place from at on where x and y differ, or the length of the shorter."""
    end, step = min(len(x), len(y)), 16
    while at < end and x[at : at + step] == y[at : at + step]:
        at += step
        step *= 2
    if at >= end:
        return end
    high = min(at + step, end)
    if x[at:high] == y[at:high]:
        return end
    while high - at > 1:
        middle = (at + high) // 2
        if x[at:middle] == y[at:middle]:
            at = middle
        else:
            high = middle
    return at


def front_coded(suffixes: list[tuple[bytes, tuple]]) -> tuple[list[int], list[bytes], list[tuple]]:
    """Sorted (suffix, payload): the shared prefixes' lengths, the rests and the payloads."""
    shared, rests, payloads, before = [], [], [], b""
    for suffix, payload in suffixes:
        same = _mismatch(before, suffix, 0)
        shared.append(same)
        rests.append(suffix[same:])
        payloads.append(payload)
        before = suffix
    return shared, rests, payloads


def merged(runs: list[tuple[list[int], list[bytes], list[tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """The suffixes of all front-coded runs in order, with the length that each shares with the one before."""
    count = len(runs)
    if not count:
        return
    heads: list[bytes | None] = [None] * count
    shared, at = [0] * count, [0] * count

    def advance(run: int) -> None:
        lengths, rests, _ = runs[run]
        k = at[run]
        if k == len(rests):
            heads[run] = None
            return
        shared[run] = lengths[k]
        heads[run] = (heads[run] or b"")[: lengths[k]] + rests[k]
        at[run] = k + 1

    def first_of(a: int, b: int) -> tuple[int, int]:
        """The run with the smaller head, and the other, whose shared length then refers to that head."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        same = _mismatch(x, y, shared[a])
        if same == len(x) or (same < len(y) and x[same] < y[same]):
            shared[b] = same
            return a, b
        shared[a] = same
        return b, a

    for run in range(count):
        advance(run)
    losers = [-1] * count  # node k has children 2k and 2k+1; leaf of run r is node count + r

    def build(node: int) -> int:
        if node >= count:
            return node - count
        winner, losers[node] = first_of(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if count > 1 else 0
    while heads[winner] is not None:
        yield heads[winner], shared[winner], runs[winner][2][at[winner] - 1]
        advance(winner)
        node = (winner + count) // 2
        while node >= 1 and count > 1:
            winner, losers[node] = first_of(winner, losers[node])
            node //= 2


def covered(lcp: np.ndarray, before: list[bytes], least: np.ndarray, most: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix of the sorted order the smallest and largest l at which its string is repeated
    (smallest above largest: none). lcp: bytes shared with the suffix before; before: the bytes before
    the anchor; least, most: the l of its strings; copies: places that hold just this suffix."""
    n = len(lcp)
    low, high = np.full(n, MATCH, np.int64), np.full(n, -1, np.int64)
    own = copies > 1
    low[own], high[own] = least[own], most[own]
    ends = np.cumsum([len(b) for b in before])
    flat = np.frombuffer(b"".join(before), np.uint8).astype(np.int64)
    live = np.arange(n)
    left = np.cumsum(lcp < GRAM)  # which suffixes agree in GRAM bytes after and l bytes before the anchor
    for l in range(MATCH - GRAM + 1):
        if l:
            live = live[most[live] >= l]
            _, left[live] = np.unique(left[live] << 8 | flat[ends[live] - l], return_inverse=True)
        live = live[np.bincount(left[live])[left[live]] > 1]
        if not len(live):
            break
        run = np.cumsum(lcp < MATCH - l)
        open_ = live[least[live] <= l]
        _, which = np.unique(run[open_] << 32 | left[open_], return_inverse=True)
        hit = open_[np.bincount(which)[which] > 1] if len(open_) else open_
        low[hit] = np.minimum(low[hit], l)
        high[hit] = np.maximum(high[hit], l)
    return low, high


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return rows.withColumn("sha", F.unhex(F.sha2("text", 256)))


def _anchored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per distinct text: sha, n_bytes, copies, an id that has it, and its anchors."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = anchors(batch.column("text").to_pylist())
            columns = [pa.array([f[k].view(np.int64) if k == 0 else f[k].astype(np.int32) for f in found], pa.list_(pa.int64() if k == 0 else pa.int32())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["sha", "doc_id", "n_bytes", "hash", "place", "first", "last"])

    rows = _texts(docs, id_col, text_col).select("sha", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.length("text").alias("n_bytes"), "text")
    rows = rows.mapInArrow(find, "sha binary, doc_id long, n_bytes int, hash array<long>, place array<int>, first array<int>, last array<int>")
    marks = F.arrays_zip("hash", "place", "first", "last").alias("anchors")
    first = rows.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), *[F.first(c).alias(c) for c in ("hash", "place", "first", "last")])
    return shared_table(first.select("sha", "copies", "doc_id", "n_bytes", marks), "suffix-anchors")


def _runs(rows: DataFrame, targets: int, run_bytes: int = RUN_BYTES) -> DataFrame:
    """From rows (sha, text, anchors): sorted front-coded runs (target, run), the suffixes of hot anchors
    (target -1, run: digest, after, before, smallest l, copies of each) and the texts that hold each suffix
    (suffix, sha, first). A task holds run_bytes of suffixes at most, within a text too."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            dealt: dict[int, list[tuple[bytes, tuple]]] = {}
            hot: list[tuple[bytes, bytes, bytes, int, int]] = []
            for (after, before), entry in held.items():
                if entry[5]:
                    hot.append((entry[4], after, before, entry[1], entry[3]))
                    continue
                dealt.setdefault(entry[0] % targets, []).append((after, (before, entry[1], entry[2], entry[3], entry[4])))
            for target, suffixes in dealt.items():
                suffixes.sort(key=lambda s: s[0])
                yield _row(target=[target], run=[pickle.dumps(front_coded(suffixes))])
            for k in range(0, len(hot), 1_000):
                yield _row(target=[-1], run=[pickle.dumps(hot[k : k + 1_000])])
            held.clear()
            size = 0

        for batch in batches:
            owners: list[tuple[bytes, bytes, int]] = []
            for sha, text, marks in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), batch.column("anchors").to_pylist()):
                for mark in marks:
                    place, first, last = mark["place"], mark["first"], mark["last"]
                    after, before = text[place : last + MATCH], text[first:place]
                    entry = held.get((after, before))
                    if entry is None:
                        digest = blake2b(after, digest_size=16, key=len(before).to_bytes(4, "big"))
                        digest.update(before)
                        # hash, smallest and largest l, copies, digest, whether the hash is hot
                        entry = held[after, before] = [mark["hash"], place - last, place - first, 0, digest.digest(), mark["hot"]]
                        size += len(after) + len(before) + 300
                    entry[3] += 1
                    owners.append((entry[4], sha, first))
                    if size > run_bytes:
                        yield from flush()
            if owners:
                suffix, sha, first = zip(*owners)
                yield _row(suffix=list(suffix), sha=list(sha), first=list(first))
        yield from flush()

    return rows.mapInArrow(sort, "target int, run binary, suffix binary, sha binary, first int")


_COLUMNS = {"target": pa.int32(), "run": pa.binary(), "suffix": pa.binary(), "sha": pa.binary(), "first": pa.int32()}


def _row(**columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), kind) for c, kind in _COLUMNS.items()], names=list(_COLUMNS))


def _repeated(runs: DataFrame) -> DataFrame:
    """suffix and the range of it, from its first byte before the anchor, that repeats cover."""
    schema = pa.schema([("suffix", pa.binary()), ("start", pa.int32()), ("stop", pa.int32())])

    def solve(blobs: list[bytes]) -> pa.RecordBatch:
        lcp, payloads, copies = [], [], []
        seen: dict[bytes, int] = {}
        for _, shared, payload in merged([pickle.loads(b) for b in blobs]):
            at = seen.setdefault(payload[4], len(lcp))
            if at < len(lcp):  # the suffix of another run, with equal bytes after and before: one entry
                copies[at] += payload[3]
                continue
            lcp.append(shared)
            payloads.append(payload)
            copies.append(payload[3])
        before, least, most, _, names = zip(*payloads)
        least, most = np.array(least), np.array(most)
        low, high = covered(np.array(lcp), list(before), least, most, np.array(copies))
        hit = np.flatnonzero(low <= high)
        start, stop = (most - high)[hit], (most - low)[hit] + MATCH
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in hit.tolist()], pa.binary()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, blobs = None, []
        for batch in batches:
            for now, blob in zip(batch.column("target").to_pylist(), batch.column("run").to_pylist()):
                if now != target and blobs:
                    yield solve(blobs)
                    blobs = []
                target = now
                blobs.append(blob)
        if blobs:
            yield solve(blobs)

    dealt = runs.repartition("target").sortWithinPartitions("target")
    return dealt.mapInArrow(merge, "suffix binary, start int, stop int")


def _repeated_by_digest(runs: DataFrame) -> DataFrame:
    """What _repeated gives, for the suffixes of hot anchors: (run)."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("suffix", pa.binary()), ("most", pa.int32()), ("l", pa.int32()), ("string", pa.binary()), ("copies", pa.int64())])
        for batch in batches:
            for blob in batch.column("run").to_pylist():
                suffixes = pickle.loads(blob)
                for k in range(0, len(suffixes), 50):
                    rows = []
                    for suffix, after, before, least, copies in suffixes[k : k + 50]:
                        whole, most = before + after, len(before)
                        rows += [(suffix, most, l, blake2b(whole[most - l : most - l + MATCH], digest_size=16).digest(), copies) for l in range(least, most + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    made = runs.mapInArrow(strings, "suffix binary, most int, l int, string binary, copies long")
    twice = made.groupBy("string").agg(F.sum("copies").alias("n")).filter("n > 1").select("string")
    hit = made.select("suffix", "most", "l", "string").join(twice, "string").groupBy("suffix").agg(F.first("most").alias("most"), F.min("l").alias("low"), F.max("l").alias("high"))
    return hit.select("suffix", (F.col("most") - F.col("high")).alias("start"), (F.col("most") - F.col("low") + MATCH).alias("stop"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sha (of the text's bytes) and spans, the sorted maximal runs of bytes to remove, for every distinct
    text that has any."""
    small_batches(docs.sparkSession)
    small_reads(docs.sparkSession)
    known = _anchored(docs, id_col, text_col)
    marks = known.select("sha", "doc_id", F.inline("anchors"))
    twice = known.select(F.explode("anchors.hash").alias("hash")).groupBy("hash").count().filter("count > 1").select("hash", (F.col("count") > HOT).alias("hot"))
    twice = shared_table(twice, "suffix-hashes")  # a table, so that both sides of the join are shuffled for it and a hot hash is split
    kept = marks.join(twice, "hash")
    per_text = kept.groupBy("sha", "doc_id").agg(F.collect_list(F.struct("hash", "place", "first", "last", "hot")).alias("anchors"))  # a text's own
    per_text = shared_table(per_text, "suffix-candidates")
    size = per_text.select(F.explode("anchors").alias("a")).filter("not a.hot").agg(F.sum(F.col("a.last") - F.col("a.first") + MATCH)).first()[0] or 0
    texts = _texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    rows = texts.join(per_text, ["sha", "doc_id"]).select("sha", "text", "anchors")
    made = shared_table(_runs(rows, 1 + size // TARGET_BYTES), "suffix-runs", **SMALL_PAGES)
    found = _repeated(made.filter("run is not null and target >= 0").select("target", "run"))
    if not twice.filter("hot").isEmpty():
        found = found.unionByName(_repeated_by_digest(made.filter("target = -1").select("run")))
    holders = made.filter("suffix is not null").select("suffix", "sha", "first")
    hit = holders.join(found, "suffix").groupBy("sha").agg(F.collect_list(F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop"))).alias("spans"))
    copied = known.filter((F.col("copies") > 1) & (F.col("n_bytes") >= MATCH)).select("sha", F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").alias("stop"))).alias("spans"))
    return hit.join(copied.select("sha"), "sha", "left_anti").unionByName(copied)


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], stop)
        else:
            out.append((start, stop))
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (removed runs of bytes), kept (the other bytes).

    A null text counts as empty; a text shorter than MATCH loses nothing; a text of at least MATCH bytes
    that occurs in two rows loses all, also if the rows share an id. Matches never cross texts. Null ids
    pass through. An empty table gives no rows."""
    spans = repeated_spans(docs, id_col, text_col)
    rows = _texts(docs, id_col, text_col).join(spans, "sha", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            sizes, united, kept = [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                runs = _united(found)
                edges = [0, *(x for run in runs for x in run), len(text)]
                sizes.append(len(text))
                united.append([{"start": a, "stop": b} for a, b in runs])
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(united, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(cut, f"doc_id long, n_bytes long, spans {_SPAN}, kept binary")
