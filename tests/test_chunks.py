import random

import pytest
from pyspark.sql import functions as F

from issue_signals.functions import chunks as C


def test_splitters(one):
    text = "A b.  C d!\nE f\n\nG"
    assert one(C.pieces(F.lit(text), "sentence")) == (["A b.", "C d!\nE f\n", "G"],)
    assert one(C.pieces(F.lit(text), "paragraph")) == (["A b.  C d!\nE f", "G"],)
    assert one(C.pieces(F.lit(text), "newline")) == (["A b.  C d!", "E f", "", "G"],)


def packed_by_hand(pieces, budget):
    found, held = [], ""
    for piece in pieces:
        joined = f"{held} {piece}".strip()
        if len(joined.split()) <= budget:
            held = joined
            continue
        if held:
            found.append(held)
        held = piece
    return [c.strip() for c in [*found, held] if c.strip()]


def test_packing_matches_a_plain_loop(spark):
    random.seed(1)
    texts = [
        "\n".join(" ".join("w" * random.randint(1, 3) for _ in range(random.randint(0, 9))) for _ in range(random.randint(0, 12)))
        for _ in range(200)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for budget in (1, 5, 8):
        rows = df.select("i", C.packed_chunks("t", budget, "newline").alias("c")).collect()
        for r in rows:
            want = packed_by_hand(texts[r.i].split("\n"), budget)
            assert [" ".join(c.split()) for c in r.c] == [" ".join(c.split()) for c in want]


def test_packing_edges(one):
    assert one(C.packed_chunks(F.lit(""), 5)) == ([],)
    assert one(C.packed_chunks(F.lit(None).cast("string"), 5)) == ([],)
    assert one(C.packed_chunks(F.lit("a b c d e f. g"), 3)) == (["a b c d e f.", "g"],)


def test_windows_and_tail(one):
    assert one(C.token_windows(F.lit(" a b  c\nd e"), 2)) == (["a b", "c d", "e"],)
    assert one(C.token_windows(F.lit("  "), 2)) == ([],)
    assert one(C.token_windows(F.lit("a b c"), F.lit(5))) == (["a b c"],)
    assert one(C.fit_context(F.lit("a b c d"), 5), C.fit_context(F.lit("a b c d"), 4)) == ("b c d", "c d")


def test_token_budget(one):
    assert one(C.token_budget(100, 4096), C.token_budget(100, 10**9), C.token_budget(5000, 4096)) == (3988, 8084, 32)


@pytest.mark.parametrize(
    "text, budget, chunks",
    [
        ("short text", 5, ["short text"]),
        ("a b\nc d\ne f", 4, ["a b\nc d", "e f"]),
        ("a b c. d e f g h", 3, ["a b c", "d e f", "g h"]),
    ],
)
def test_line_chunker(spark, text, budget, chunks):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.line_chunker(budget)(F.col("t")).alias("c")).first().c == chunks


def test_line_chunker_keeps_every_word(spark):
    random.seed(2)
    texts = [
        "".join(random.choice(["a", "bb", "ccc"]) + random.choice([" ", " ", " ", ". ", "\n"]) for _ in range(random.randint(1, 80)))
        for _ in range(100)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", C.line_chunker(7)(F.col("t")).alias("c")).collect():
        want = texts[r.i].replace(".", " ").replace("\n", " ").split()
        assert " ".join(r.c).replace(".", " ").replace("\n", " ").split() == want


def test_a_callers_tokenizer_is_used(spark):
    def letters():
        return list, "".join

    df = spark.createDataFrame([("abcdefgh",)], "t string")
    assert df.select(C.line_chunker(3, letters)(F.col("t")).alias("c")).first().c == ["abc", "def", "gh"]
