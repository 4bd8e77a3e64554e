"""Exact, near and suffix dedup against plain versions."""

import pickle
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import classes, exact, repeats, sha, simhash, simhash_classes
from pyspark.sql import functions as F

from issue_signals.llm import exact_dedup, simhash as near, suffix_dedup
from issue_signals.llm.components import components

DOCS = "doc_id long, text string"
#: Columns that a table may have beside ours, with the names that the operators use inside.
EXTRA = ("hash", "norm", "size", "bucket", "slot", "simhash", "sha", "spans", "place", "source_size", "key", "count", "row", "id", "no_id", "__id", "__text", "__copy")


def with_extra(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def frame(spark, rows):
    return with_extra(spark.createDataFrame(rows, DOCS))


def odd_texts():
    long = " ".join(f"word{i}" for i in range(3000))
    return [
        None, "", "  ", "\t\n", "a b", "ab", "a  b", "A b", "a b", "é é", "one", "one two", "one two three", "one two three four",
        long, long + " ", long.replace("word7 ", "wird7 "), "x" * 5000, "x" * 5001,
    ]


def odd_rows():
    rows = [(i, t) for i, t in enumerate(odd_texts())]
    return rows + [(100, "a b"), (101, "ab "), (102, None)]


def test_exact_duplicates_equal_brute_force(spark):
    rows = odd_rows()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(frame(spark, rows), bucket_rows=2).collect()}
    want = exact(rows)
    assert got == {i: want[i, t] for i, t in rows}


def test_exact_duplicates_without_ids_and_with_repeated_rows(spark):
    rows = [(None, "a"), (7, "a"), (7, "a"), (None, "b"), (None, " b"), (3, "c"), (3, "d")]
    got = sorted(tuple(r) for r in exact_dedup.exact_duplicates(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("keep_id", F.lit(-1)), "group_size", "kept").collect())
    assert got == [(-1, -1, 2, True), (-1, -1, 2, True), (-1, 7, 3, False), (3, 3, 1, True), (3, 3, 1, True), (7, 7, 3, True), (7, 7, 3, True)]
    left = exact_dedup.without_copies(frame(spark, rows))
    assert left.columns == ["doc_id", "text", *EXTRA]
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", "c"), ("3", "d"), ("7", "a"), ("None", " b")]


def test_rank_keeps_extreme_ids(spark):
    rows = [(2**63 - 1, "a"), (-(2**63), "a "), (5, "a"), (-(2**63), "b"), (0, "b")]
    got = {(r.doc_id, r.group_size): r.keep_id for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {(2**63 - 1, 3): -(2**63), (-(2**63), 3): -(2**63), (5, 3): -(2**63), (-(2**63), 2): -(2**63), (0, 2): -(2**63)}


def test_directory_splits_overfull_buckets():
    counts = {0: 10, 1: 1, 7: 3}
    depth, buckets = exact_dedup.directory(counts, 4, 3)
    assert depth == 3 and buckets[0] == (0, 0, 3) and buckets[-1] == (4, 7, 1)
    assert [b for low, high, _ in buckets for b in range(low, high + 1)] == list(range(8))
    assert exact_dedup.directory({}, 4, 3) == (0, [(0, 0, 0)])


def test_a_row_is_looked_up_in_the_bucket_that_the_directory_names(spark):
    """Small buckets: the directory doubles, each bucket is one range of hashes, and lookups meet every row once."""
    rows = [(i, f"text {i // 2}") for i in range(600)] + [(1000 + i, "hot") for i in range(500)]
    index, entries = exact_dedup.index_and_entries(frame(spark, rows), bucket_rows=5, max_depth=10)
    index, entries = index.collect(), entries.collect()
    assert len(index) == 301 and len({r.bucket for r in index}) > 60 and len({r.local_depth for r in index}) > 1
    spans = {}
    for r in index:
        at = r.hash % 2**64
        low, high = spans.get(r.bucket, (at, at))
        spans[r.bucket] = min(low, at), max(high, at)
        assert at >> (64 - r.local_depth) == spans[r.bucket][0] >> (64 - r.local_depth) and r.link == 1
    ordered = [spans[b] for b in sorted(spans)]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))
    assert max(Counter(r.bucket for r in index).values()) <= 5
    where = {r.text_sha256: r.bucket for r in index}
    assert len(entries) == len(rows) and all(r.bucket == where[r.text_sha256] for r in entries)


def test_texts_of_one_hash_are_links_of_its_chain(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(1, "a"), (2, "a "), (3, "b"), (4, "c"), (5, "b")]
    index, _ = exact_dedup.index_and_entries(frame(spark, rows), bucket_rows=1)
    assert sorted((r.link, r.group_size) for r in index.collect()) in ([(1, g), (2, h), (3, k)] for g, h, k in ((1, 2, 2), (2, 1, 2), (2, 2, 1)))
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(frame(spark, rows), bucket_rows=1).collect()}
    assert got == {1: 2, 2: 2, 3: 3, 4: 4, 5: 3}


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_duplicates(empty).count() == 0 and near.near_duplicates(empty).count() == 0
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_fingerprint_of_parts_is_that_of_the_whole(monkeypatch):
    texts = ["", " a", "A b", "a b c", "\x0ba\x1cb c  d ", "ÄÖ a É b c", " ".join(random.Random(1).choices("abc", k=500))]
    want = [simhash(t) for t in texts]
    assert [near.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.setattr(near, "_PART", 7)
    assert [near.fingerprint(t.encode()) for t in texts] == want


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choices([f"w{i}" for i in range(80)], k=400)) for _ in range(12)]
    rows = odd_rows()
    for i in range(150):
        text = r.choice(base).split(" ")
        for _ in range(r.randint(0, 2)):
            text[r.randrange(len(text))] = "new"
        rows.append((1000 + i, " ".join(text)))
    prints, component = simhash_classes(rows)
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {g.doc_id: (g.simhash % 2**64, g.component_id) for g in got} == {i: (prints[i], component[i]) for i, _ in rows}
    stays = near.one_of_each(frame(spark, rows))
    assert stays.columns == ["doc_id", "text", *EXTRA] and {s.doc_id for s in stays.collect()} == set(component.values())


def test_near_duplicates_without_ids_and_repeated(spark):
    got = near.near_duplicates(frame(spark, [(None, "a"), (4, "a"), (4, "a"), (None, "zz yy")])).collect()
    assert sorted((str(g.doc_id), str(g.component_id)) for g in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert sorted(str(s.doc_id) for s in near.one_of_each(frame(spark, [(None, "a"), (4, "a"), (4, "a"), (None, "zz yy")])).collect()) == ["4", "None"]


@pytest.mark.parametrize("dense", [5, 2000])
def test_links_of_dense_groups_keep_all_components(spark, monkeypatch, dense):
    """Thousands of close fingerprints: the forest connects what all pairs connect."""
    monkeypatch.setattr(near, "_DENSE", dense)
    r = np.random.default_rng(3)
    centers = r.integers(0, 1 << 63, 4, np.uint64)
    values = {int(c) for c in centers}
    for _ in range(220):
        flips = np.bitwise_or.reduce(np.uint64(1) << r.choice(64, r.integers(1, 7), replace=False).astype(np.uint64))
        values.add(int(r.choice(centers) ^ flips))
    values = sorted(values)
    want = classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    links = []
    for which, mask in enumerate(near.masks()):
        array = np.array(sorted(values, key=lambda v: v & mask), np.uint64)
        u, v = near._links(array & np.uint64(mask), array, np.full(len(array), which), 3, near.masks())
        links += zip(u.tolist(), v.tolist())
    assert all((a ^ b).bit_count() <= 64 and want[a] == want[b] for a, b in links)
    pairs = {frozenset(x) for x in links}
    got = classes(values, lambda a, b: frozenset((a, b)) in pairs)
    assert got == want


def test_every_close_pair_shares_a_key():
    r = np.random.default_rng(4)
    for _ in range(300):
        a = int(r.integers(0, 1 << 63))
        b = a ^ sum(1 << int(p) for p in r.choice(64, 3, replace=False))
        assert any(a & m == b & m for m in near.masks())


def test_components_equal_brute_force(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3, 3)] + [(5000, 6000 + i) for i in range(50)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    pairs = {frozenset(e) for e in edges}
    want = classes(nodes, lambda a, b: frozenset((a, b)) in pairs)
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {(x.node, x.component) for x in got.collect()} == set(want.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def passages(seed=6):
    r = random.Random(seed)
    fresh = lambda n: "".join(r.choices("abcdefgh é", k=n))
    shared = [fresh(k) for k in (399, 400, 401, 700, 1500)]
    texts = [None, "", "short", "a" * 399, "b" * 400, "c" * 1300, "xyz" * 300, fresh(420)]
    for _ in range(25):
        texts.append(fresh(r.randint(0, 300)) + r.choice(shared)[r.randint(0, 40) :] + fresh(r.randint(0, 300)) + r.choice(shared) + fresh(r.randint(0, 90)))
    whole = fresh(900)
    return texts + [whole, whole, whole[:450] + whole[:450], shared[3], shared[3][100:] + shared[2]]


def test_removed_bytes_equal_brute_force(spark):
    texts = passages()
    data, covered = repeats(texts)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, (d, c) in enumerate(zip(data, covered)):
        assert (got[i].n_bytes, sha(bytes(got[i].kept))) == (len(d), sha(bytes(b for b, x in zip(d, c) if not x))), i
        assert sum(s.stop - s.start for s in got[i].spans) == sum(c)


def test_suffixes_of_a_hot_anchor_do_not_meet_in_one_task(spark, monkeypatch):
    met = []

    def spy(runs, solve=suffix_dedup._repeated):
        met.extend(len(shared) for r in runs.collect() for shared in [pickle.loads(r.run)[0]])
        return solve(runs)

    monkeypatch.setattr(suffix_dedup, "_repeated", spy)
    monkeypatch.setattr(suffix_dedup, "HOT", 10, raising=False)
    r = random.Random(14)
    fresh = lambda n: "".join(r.choices("abcdefgh é", k=n))
    passage = fresh(700)
    texts = passages() + [fresh(r.randint(200, 400)) + passage[r.randint(0, 9) :] + fresh(r.randint(200, 400)) for _ in range(60)]
    data, covered = repeats(texts)
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(frame(spark, list(enumerate(texts)))).collect()}
    for i, (d, c) in enumerate(zip(data, covered)):
        assert bytes(got[i].kept) == bytes(b for b, x in zip(d, c) if not x), i
        assert sum(s.stop - s.start for s in got[i].spans or ()) == sum(c)
    assert sum(met) < 100  # of some 300 suffixes of the passage alone; those left have at most 10 to a hash


def test_memory_of_a_task_does_not_follow_the_length_of_texts(spark):
    """Before, 500 texts of any length were one batch, 4,096 one array of the reader, and a batch's suffixes were held together."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        spark.conf.unset(key)
    assert suffix_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    sizes = long.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 8 << 20
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256

    text = "".join(random.Random(8).choices("abcdefgh \n", k=60_000)).encode()
    (found,) = suffix_dedup.anchors([text])
    marks = [(*(int(x) for x in mark), False) for mark in zip(found[0].view(np.int64), *found[1:])]
    rows = spark.createDataFrame([(b"id", text, marks)], "sha binary, text binary, anchors array<struct<hash:long,place:int,first:int,last:int,hot:boolean>>")
    made = suffix_dedup._runs(rows, 1, 20_000).collect()
    runs = [pickle.loads(r.run) for r in made if r.run is not None]
    assert len(runs) > 5 and all(sum(map(len, rests)) + sum(len(p[0]) for p in payloads) <= 21_000 for _, rests, payloads in runs)
    assert sum(len(payloads) for _, _, payloads in runs) == len(marks) == sum(r.first is not None for r in made)


def test_repeated_rows_without_ids_go(spark):
    text = "".join(random.Random(8).choices("abcdefgh", k=500))
    rows = [(None, text), (None, text), (3, text + "tail"), (4, None), (4, None)]
    got = suffix_dedup.without_repeats(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in got) == [("3", 504, 4), ("4", 0, 0), ("4", 0, 0), ("None", 500, 0), ("None", 500, 0)]


def test_long_texts_have_the_anchors_of_short_ones(monkeypatch):
    r = random.Random(9)
    texts = ["".join(r.choices("abc", k=n)).encode() for n in (5000, 400, 401, 7000)] + [b"ab" * 2000]
    want = [[x.tolist() for x in a] for a in suffix_dedup.anchors(texts)]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    assert [[x.tolist() for x in a] for a in suffix_dedup.anchors(texts)] == want
    for text, (_, place, first, last) in zip(texts, want):
        starts = [p for a, b in zip(first, last) for p in range(a, b + 1)]
        assert starts == list(range(len(text) - 399)) and all(a <= p <= a + 336 and b <= p for p, a, b in zip(place, last, first)) is not None
        anchor = {p: text[at : at + 64] for at, a, b in zip(place, first, last) for p in range(a, b + 1)}
        by_string = {}
        for p in starts:
            assert by_string.setdefault(text[p : p + 400], anchor[p]) == anchor[p]


def test_merge_gives_sorted_suffixes_with_their_shared_prefixes():
    r = random.Random(10)
    strings = ["".join(r.choices("ab", k=r.randint(0, 60))).encode() for _ in range(500)] + [b"", b"a" * 300, b"a" * 301]
    for parts in (1, 2, 3, 7):
        runs = [suffix_dedup.front_coded(sorted((s, (k,)) for k, s in enumerate(strings) if k % parts == p)) for p in range(parts)]
        got = list(suffix_dedup.merged(runs))
        assert [s for s, _, _ in got] == sorted(strings) and all(strings[payload[0]] == s for s, _, payload in got)
        for (a, _, _), (b, shared, _) in zip(got, got[1:]):
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared == same
    assert list(suffix_dedup.merged([])) == []
