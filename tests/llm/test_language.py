"""The language models against a plain version, and what may be learned."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from issue_signals.llm import language
from issue_signals.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_symbols(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return [c for w in words for c in (*w, " ")]


class Plain:
    """Interpolated Kneser-Ney over strings of four symbols."""

    def __init__(self, texts):
        self.counts = {4: Counter()}
        for t in texts:
            s = "   " + "".join(plain_symbols(t))
            self.counts[4].update(s[i - 3 : i + 1] for i in range(3, len(s)))
        for size in (3, 2, 1):
            self.counts[size] = Counter(g[1:] for g in self.counts[size + 1])
        self.total, self.kinds, self.discount = defaultdict(Counter), defaultdict(Counter), {}
        for size, level in self.counts.items():
            ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
            self.discount[size] = ones / (ones + 2 * twos) if ones and twos else 0.5
            for g, n in level.items():
                self.total[size][g[:-1]] += n
                self.kinds[size][g[:-1]] += 1

    def p(self, g):
        size = len(g)
        if not size:
            return 2.0**-16
        total = self.total[size][g[:-1]]
        if not total:
            return self.p(g[1:])
        n = self.counts[size][g]
        return (n - self.discount[size] if n else 0) / total + self.discount[size] * self.kinds[size][g[:-1]] / total * self.p(g[1:])

    def log_likelihood(self, text):
        s = "   " + "".join(plain_symbols(text))
        return sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s)))


def place(i):
    return zlib.crc32(str(i).encode())


def given():
    r = random.Random(5)
    kinds = {"aa": ["the", "and", "thing", "with", "over"], "bb": ["der", "und", "über", "mit", "Straße"], "cc": ["où", "et", "là", "avec", "sur"]}
    return [(i, " ".join(r.choices(kinds[lang], k=r.randint(1, 30))) + r.choice([".", "", " 12!"]), lang) for i in range(300) for lang in [r.choice(list(kinds))]]


@pytest.mark.parametrize("window,dense", [(1 << 20, 1 << 25), (37, 0)])
def test_log_likelihoods_equal_a_plain_version(spark, monkeypatch, window, dense):
    monkeypatch.setattr(language, "_WINDOW", window)
    monkeypatch.setattr(language, "_DENSE", dense)
    rows = given()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("key", "n", "size", "value", "out", "best")})
    model = language.trained(docs)
    assert model.langs == ["aa", "bb", "cc"]
    texts = ["the über où xyz", "", None, "12 --", "Ω𝕏 the", *[t for _, t, _ in rows[:20]]]
    got, sizes = model.log_likelihoods(texts)
    assert sizes.tolist() == [len(plain_symbols(t)) for t in texts]
    for k, lang in enumerate(model.langs):
        plain = Plain([t for i, t, own in rows if own == lang and place(i) % 4 != 2 and place(i) % 16 != 3])
        assert np.allclose(got[:, k], [plain.log_likelihood(t) for t in texts], rtol=1e-4)


def test_defined_results_of_odd_rows(spark):
    rows = given() + [(None, "the and", "aa"), (1000, None, "aa"), (1001, "", None), (1002, "12 ?", "bb"), (1003, "und " * 50_000, "bb"), (1003, "und " * 50_000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "entropy", "best", "rejected")})
    model = language.trained(docs)
    got = language.identified(docs, model)
    assert got.columns == ["doc_id", "best", "lang", "score", "entropy", "rejected"] and got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.filter("doc_id IS NULL OR doc_id >= 1000").collect()}
    assert by_id[None].best == "aa" and by_id[1003].best == "bb"
    assert all((by_id[i].best, by_id[i].lang, by_id[i].score, by_id[i].entropy, by_id[i].rejected) == ("und", "und", 0.0, None, False) for i in (1000, 1001, 1002))
    empty = docs.limit(0)
    assert language.identified(empty, language.trained(empty)).count() == 0
    assert {r.best for r in language.identified(docs, language.trained(empty)).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "zqx jkw vvq " * 40)], "doc_id long, text string")
    assert language.identified(strange, model).first().rejected


def test_query_on_held_out_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_language_id"](spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (place(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.99 * len(held)


def test_nothing_is_learned_from_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    one, two = (language.trained(d) for d in (docs, other))
    assert one.langs == two.langs and one.limits == two.limits and one.temperature == two.temperature
    assert all((one.grams[k][1] == two.grams[k][1]).all() for k in one.grams)
