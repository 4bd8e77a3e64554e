"""The pipeline's stages, each against a plain version over what it was given."""

from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from brute import exact, mix, sha, simhash_classes
from pyspark.sql import functions as F

import corpus_pipeline
from issue_signals.llm import bpe, quality
from issue_signals.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.source, r.text) for r in df.collect()]


def test_every_stage_equals_a_plain_version(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = given.limit(3).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = given.unionByName(more).unionByName(given.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    before = rows_of(docs)

    graded = stages["quality"](spark, docs, SF).cache()
    model = quality.trained(docs, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    likely = lambda t: 1 / (1 + np.exp(model.thresholds[-1] - model.score(quality.features(t))))
    assert Counter(rows_of(graded)) == Counter(r for r in before if likely(r[2]) >= quality.KEEP_FROM)

    unique = stages["exact_dedup"](spark, graded, SF).cache()
    want = exact([(i, t) for i, _, t in rows_of(graded)])
    assert Counter(rows_of(unique)) == Counter(r for r in rows_of(graded) if want[r[0], r[2]][2])

    apart = stages["near_dedup"](spark, unique, SF).cache()
    kept = rows_of(unique)
    _, component = simhash_classes([(i, t) for i, _, t in kept if i is not None])
    assert Counter(r for r in rows_of(apart) if r[0] is not None) == Counter(r for r in kept if r[0] in set(component.values()))

    mixed = stages["mixing"](spark, apart, SF).cache()
    kept = rows_of(apart)
    size, _, _, taken = mix(kept)
    got = Counter(i for i, _, _ in rows_of(mixed))
    assert all(got[i] == t // n for (i, _, _), n, t in zip(kept, size, taken) if n)
    for stage in (graded, unique, apart, mixed):
        assert stage.columns == given.columns

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(VOCABULARY), special_tokens={})
    want = Counter()
    for i, _, t in rows_of(mixed):
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t or "")] += 1
    assert Counter(map(tuple, stages["byte_bpe"](spark, mixed, SF).collect())) == want


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < rows.count()
