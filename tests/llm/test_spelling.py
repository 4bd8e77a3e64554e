"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from issue_signals.llm import spelling
from issue_signals.llm.queries import QUERIES

LOW = {c: c + 32 for c in range(65, 91)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain(rows, min_letters=6, min_count=5, ratio=5, damaged=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damaged == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def result(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("word", "n", "run", "h", "id", "near", "own", "root", "form")})
    got = spelling.spelling_variants(docs, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("symbols", [None, 2, 9])
def test_equals_plain_version(spark, monkeypatch, symbols):
    monkeypatch.setattr(spelling, "_PLACES", 7)
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = ["".join(r.choices("abé", k=r.randint(5, 9))) for _ in range(6)]
        rows.append((i, " ".join(r.choices(base, k=40)) + ", Überzahl überzahl"))
    chain = [("kettenwort", 1000), ("ketenwort", 200), ("ketenwrt", 40), ("ketnwrt", 8)]
    rows += [(100 + k, f"{w} " * n) for k, (w, n) in enumerate(chain)]
    rows += [(None, "nullid " * 9), (1, None), (2, ""), (3, "-- 12"), (3, "Straßenbahn×÷ Strasse"), (3, "Straßenbahn×÷ Strasse")]
    rows += [(200 + k, "tiesaa tiesab " * 5 + "tiesac " * 25) for k in range(2)]  # near words of equal n
    want = plain(rows, damaged=7)
    assert len(want) > 100 and any(x[1] != x[2] and x[1] for x in want)
    assert result(spark, rows, symbols=symbols, damaged=7) == want


def test_long_runs_and_empty_table(spark):
    long = "".join(random.Random(1).choices(spelling.LOWER, k=20_000))
    rows = [(i, f"{long[:9000]}x{long[9000:]} " + f"{long} " * 6) for i in range(5)]
    got = result(spark, rows, damaged=10**12)
    assert {(len(w), len(f or ""), n, k) for w, f, _, n, k, _ in got} == {(20_001, 20_000, 5, 1), (20_000, 0, 30, 1)}
    assert result(spark, []) == set()


def test_each_edited_word_is_generated_once():
    import numpy as np
    import pyarrow as pa

    for word in ("aabba", "a", "abcabc", "cc"):
        values = spelling._values(3)
        got = [int(x) for _, near in spelling._edited(pa.array([word]), 3, values) for x in near]
        near = {word[:i] + word[i + 1 :] for i in range(len(word))}
        near |= {word[:i] + s + word[i + 1 :] for i in range(len(word)) for s in "abc"}
        near |= {word[:i] + s + word[i:] for i in range(len(word) + 1) for s in "abc"}
        want = {int(np.uint64(x)) for x in spelling._sums(*spelling._flat(pa.array(sorted(near))), values)[2]}
        assert len(got) == len(set(got)) == len(want) == len(near) and set(got) == want


def test_query_equals_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_spelling_variants"](spark, sf)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain(rows)
