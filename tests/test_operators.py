import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from issue_signals.operators import combine, keys, keywords, progress, similarity, skew, summaries

ISSUES = "issue_id long, project_id long, title string, body_text string, owner_type string, number int, state string, comments int, created_at timestamp"
COMMENTS = "issue_id long, id long, body_text string"


def issues(spark):
    rows = [
        (1, 1, "t1", "b1", "User"), (2, 1, "t2", None, "User"), (3, 1, None, "b3", "User"),
        (4, 1, None, None, "User"), (5, 2, "t5", "b5", "Bot"), (6, 2, "t6", "", "User"),
    ]
    return spark.createDataFrame([(*r, r[0], "open", 0, None) for r in rows], ISSUES)


def comments(spark):
    rows = [(1, 12, "second"), (1, 11, "first"), (1, 13, None), (3, 14, "c3"), (4, 15, "c4"), (5, 16, None), (99, 17, "orphan")]
    return spark.createDataFrame(rows, COMMENTS)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_combine_labelled(spark):
    assert rows_of(combine.combine_labelled(issues(spark), comments(spark)), "issue_id", "text") == [
        (1, "title: t1 b1 comment: first\nsecond"), (2, "title: t2"), (3, "b3 comment: c3"),
        (5, "title: t5 b5"), (6, "title: t6 "),
    ]
    capped = combine.combine_labelled(issues(spark), comments(spark), max_chars=8)
    assert rows_of(capped, "issue_id", "text")[0] == (1, "title: t")


def test_combine_blank_joined(spark):
    assert rows_of(combine.combine_blank_joined(issues(spark), comments(spark)), "issue_id", "text") == [
        (1, "t1 b1 first\nsecond"), (2, "t2"), (3, "b3 c3"), (5, "t5 b5"), (6, "t6"),
    ]


def test_combined_issues(spark):
    assert rows_of(combine.combined_issues(issues(spark), comments(spark)), "issue_id", "issue_text", "clean_issue_text") == [
        (1, "t1\n\nb1\n\nfirst\n\nsecond", "t b first second"), (3, None, None),
    ]


def test_an_issue_of_many_comments_is_one_row(spark):
    random.seed(3)
    ids = random.sample(range(10**9), 10_001)
    many = spark.createDataFrame([(1, i, f"c{i}") for i in ids] + [(2, 5, "c5")], COMMENTS)
    base = spark.createDataFrame([(i, 7, f"t{i}", f"b{i}", "User", i, "open", 0, None) for i in (1, 2, 3)], ISSUES)
    found = dict(rows_of(combine.combine_labelled(base, many.repartition(5)), "issue_id", "text"))
    assert found[1] == "title: t1 b1 comment: " + "\n".join(f"c{i}" for i in sorted(ids))
    assert found[2] == "title: t2 b2 comment: c5" and found[3] == "title: t3 b3"


def test_insert_if_absent_is_idempotent(spark):
    target = spark.createDataFrame([(1, "old")], "id long, v string")
    incoming = spark.createDataFrame([(1, "x", 1), (2, "b", 2), (2, "a", 1)], "id long, v string, arrival int")
    new = keys.insert_if_absent(target, incoming, ["id"], [F.col("arrival")])
    assert rows_of(new, "id", "v") == [(2, "a")]
    both = target.unionByName(new.select("id", "v"))
    assert keys.insert_if_absent(both, incoming, ["id"], [F.col("arrival")]).isEmpty()


def test_keyed_merge_overwrites_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, l int, v string")
    new = spark.createDataFrame([(1, 10, "A", 1), (1, 10, "AA", 2), (3, 30, "c", 1)], "k int, l int, v string, at int")
    order = [F.desc("at")]
    merged = keys.keyed_merge(old, new, ["k", "l"], order)
    assert rows_of(merged, "k", "v") == [(1, "AA"), (2, "b"), (3, "c")]
    assert rows_of(keys.keyed_merge(merged, new, ["k", "l"], order), "k", "v") == rows_of(merged, "k", "v")


def test_orphans(spark):
    assert rows_of(keys.orphans(comments(spark), issues(spark), "issue_id", "issue_id"), "issue_id", "rows") == [(99, 1)]


def test_text_dedupe_and_way_back(spark):
    rows = [(1, 1, "same"), (2, 1, "same"), (3, 1, "other"), (4, 2, "same")]
    texts = keys.with_text_key(spark.createDataFrame(rows, "issue_id long, project_id long, text string"))
    once = keys.distinct_texts(texts)
    assert rows_of(once, "project_id", "text", "issues") == [(1, "other", 1), (1, "same", 2), (2, "same", 1)]
    assert rows_of(keys.back_to_issues(texts.drop("text"), once), "issue_id", "text") == [(1, "same"), (2, "same"), (3, "other"), (4, "same")]


def test_projects_to_fetch(spark):
    projects = spark.createDataFrame([(3, "u1"), (1, "u1"), (2, "u1"), (4, "u2"), (5, None)], "id long, repository_url string")
    have = spark.createDataFrame([(1,), (4,)], "project_id long")
    assert rows_of(progress.projects_to_fetch(projects, have), "id", "repository_url") == [(2, "u1")]


def test_trackers(spark):
    marks = spark.createDataFrame([(1, 2)], "project_id long, last_issue_id long")
    todo = progress.above_tracker(issues(spark), marks)
    assert rows_of(todo, "issue_id") == [(3,), (4,), (5,), (6,)]
    assert rows_of(progress.unprocessed_projects(issues(spark), marks, 1), "project_id", "issues") == [(1, 2), (2, 2)]
    after = progress.tracker_after(marks, todo)
    assert rows_of(after, "project_id", "last_issue_id") == [(1, 4), (2, 6)]
    assert progress.above_tracker(issues(spark), after).isEmpty()
    lower = progress.tracker_after(after, issues(spark).filter("issue_id = 1"))
    assert rows_of(lower, "project_id", "last_issue_id") == [(1, 4), (2, 6)]


def test_eligible_and_not_analysed(spark):
    assert rows_of(progress.eligible_projects(issues(spark), 2), "project_id", "issues") == [(1, 4)]
    results = spark.createDataFrame([(1,)], "project_id long")
    assert rows_of(progress.not_analysed(issues(spark), results, 1), "project_id") == [(2,)]
    chosen = progress.of_projects(issues(spark), results)
    assert rows_of(chosen, "issue_id") == [(1,), (2,), (3,), (4,)]


def test_watermark_progress_and_paging(spark):
    empty = issues(spark).limit(0)
    assert progress.watermark(empty).first()[0] == 0
    target = issues(spark).filter("issue_id <= 2")
    assert rows_of(progress.above_watermark(issues(spark), target), "issue_id") == [(3,), (4,), (5,), (6,)]
    assert tuple(progress.progress(issues(spark), target).first()) == (6, 2, 4, 2)
    assert [r.issue_id for r in progress.next_batch(issues(spark), 2, 2).collect()] == [3, 4]
    assert [r.issue_id for r in progress.page(issues(spark), 2, 2).collect()] == [5, 6]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_split_by_adaptive_execution(spark, how):
    big = spark.range(20_000).select(F.when(F.col("id") < 15_000, 0).otherwise(F.col("id") % 700).alias("k"), F.col("id"))
    small = spark.range(0, 1400, 2).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = skew.lookup_join(big.repartition(8), small, ["k"], how)
        rows = Counter(map(tuple, joined.collect()))
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    keys_of_small = set(range(0, 1400, 2))
    assert sum(rows.values()) == sum(
        (0 if i < 15_000 else i % 700) in keys_of_small if how in ("inner", "left_semi") else (0 if i < 15_000 else i % 700) not in keys_of_small if how == "left_anti" else 1
        for i in range(20_000)
    )
    assert "skew=true" in plan


def test_bounded_rows(spark):
    assert skew.bounded_rows(spark.range(3), 2) is None and len(skew.bounded_rows(spark.range(3), 3)) == 3


def test_top_n_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = skew.top_n_per_key(df, ["k"], [F.desc("id")], 2, ["id"], parts=5)
    assert rows_of(got, "k", "id") == [(0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]


def vectors(spark, n, dim, name, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, f"{name} long, vector array<float>")


def cosines(texts, words):
    a = np.array([v for _, v in texts], dtype=np.float32).astype(np.float64)
    b = np.array([v for _, v in words], dtype=np.float32).astype(np.float64)
    return (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T


@pytest.mark.parametrize("max_words", [1000, 3])
def test_similarity_join_both_ways(spark, max_words):
    texts, tdf = vectors(spark, 40, 6, "issue_id", 1)
    words, wdf = vectors(spark, 9, 6, "word_no", 2)
    sims = cosines(texts, words)
    hits = similarity.similar_words(tdf, wdf, 0.3, max_words=max_words)
    got = {(r.issue_id, r.word_no): r.similarity for r in hits.collect()}
    want = {(i, j): sims[i, j] for i in range(40) for j in range(9) if sims[i, j] > 0.3}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    catalogue = wdf.withColumn("criteria", F.concat(F.lit("c"), F.col("word_no") % 2)).withColumn("weight", F.col("word_no") / 10)
    totals = similarity.mention_scores(tdf, catalogue, 0.3, max_words=max_words)
    got = {(r.issue_id, r.criteria): (r.words, r.score) for r in totals.collect()}
    by_criteria = defaultdict(list)
    for (i, j), s in want.items():
        by_criteria[i, f"c{j % 2}"].append(s * j / 10)
    assert got.keys() == by_criteria.keys()
    for k, parts in by_criteria.items():
        assert got[k][0] == len(parts) and got[k][1] == pytest.approx(sum(parts))


def test_threshold_is_strict_or_inclusive(spark):
    texts = spark.createDataFrame([(1, [1.0, 0.0])], "issue_id long, vector array<double>")
    words = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "word_no long, vector array<double>")
    assert similarity.similar_words(texts, words, 1.0).count() == 0
    assert similarity.similar_words(texts, words, 1.0, True).count() == 1
    assert similarity.similar_words(texts, words.limit(0), 0.0).count() == 0


def test_word_lookup_last_criteria_wins(spark):
    rows = [(0, "a", "x", 0.9), (1, "b", "x", 0.5), (2, "a", "y", 0.3), (3, "a", "y", 0.4)]
    words = spark.createDataFrame(rows, "word_no long, criteria string, similar_word string, max_w2v_score double")
    assert rows_of(similarity.word_lookup(words), "word_no", "criteria", "word", "weight") == [
        (0, "b", "x", 0.5), (1, "b", "x", 0.5), (2, "a", "y", 0.4), (3, "a", "y", 0.4),
    ]
    assert rows_of(similarity.word_lookup(words, shared_words="each"), "word_no", "criteria", "weight") == [
        (0, "a", 0.9), (1, "b", 0.5), (2, "a", 0.4), (3, "a", 0.4),
    ]
    unscored = words.drop("max_w2v_score")
    assert similarity.score_column(unscored) is None
    assert {r.weight for r in similarity.word_lookup(unscored).collect()} == {1.0}


def test_signed_mentions(spark):
    rows = [(1, 0.5, "+"), (2, 0.5, "-"), (3, 0.0, "+"), (4, 0.05, "+"), (5, -0.2, "-")]
    scores = spark.createDataFrame(rows, "issue_id long, score double, sentiment string")
    found = similarity.mentions_of(scores.withColumn("total", similarity.signed("score", "sentiment")), 0.05)
    assert rows_of(found, "issue_id", "semantic", "similarity_score") == [(1, "+", 0.5), (2, "-", 0.5), (5, "+", 0.2)]


def test_matched_words(spark):
    hits = spark.createDataFrame([(1, 0, 0.5), (1, 2, 0.25), (2, 1, 1.0)], "issue_id long, word_no long, similarity double")
    words = spark.createDataFrame([(0, "a", "x", 1.0), (1, "b", "y", 0.5), (2, "a", "z", 2.0)], "word_no long, criteria string, word string, weight double")
    got = {(r.issue_id, r.criteria): [(m.word, m.score) for m in r.matched] for r in similarity.matched_words(hits, words).collect()}
    assert got == {(1, "a"): [("x", 0.5), ("z", 0.5)], (2, "b"): [("y", 0.5)]}


def test_mean_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0])], "k int, vector array<float>")
    assert rows_of(similarity.mean_vector(df, ["k"]), "k", "vector") == [(1, [2.0, 4.0]), (2, [5.0, 5.0])]


@pytest.mark.parametrize("bounds", [{}, {"max_literal": 1}, {"max_broadcast": 1}])
def test_keyword_matches_three_ways(spark, bounds):
    attributes = spark.createDataFrame(
        [(1, "Cost", None, "price, 100%"), (2, "speed", None, "['fast', 'co_t']"), (3, "none", None, "")],
        "attribute_id int, attribute string, definition string, related_words string",
    )
    texts = spark.createDataFrame(
        [(1, "The PRICE and the cost"), (2, "very fast, 100 percent"), (3, "costly and fast: 100%"), (4, ""), (5, None)],
        "issue_id long, text string",
    )
    found = keywords.keyword_matches(texts, keywords.attribute_terms(attributes), **bounds)
    assert rows_of(found, "issue_id", "attribute_id") == [(1, 1), (2, 2), (3, 1), (3, 2)]


def test_summaries(spark):
    rows = [("a", "+", 1, 0.0), ("a", "-", 1, 0.5), ("b", "+", 2, 1.0), ("c", "-", 2, 1.0), ("c", "-", 2, 0.25)]
    mentions = spark.createDataFrame(rows, "criteria string, semantic string, project_id long, similarity_score double")
    assert [tuple(r) for r in summaries.value_counts(mentions, "criteria", 2).collect()] == [("a", 2), ("c", 2)]
    assert [tuple(r) for r in summaries.sentiment_table(mentions, 2).collect()] == [("a", 1, 1), ("c", 0, 2)]
    bins = {r.bin: r.n for r in summaries.histogram(mentions, "similarity_score", 20).collect()}
    counts, _ = np.histogram([r[3] for r in rows], bins=20)
    assert [bins[i + 1] for i in range(20)] == list(counts)
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert sum(r.n for r in summaries.histogram(same, "x", 4).collect()) == 2


def test_cap_matches(spark):
    rows = [(p, i, "c", float(i)) for p in (1, 2) for i in range(10)]
    mentions = spark.createDataFrame(rows, "project_id long, issue_id long, criteria string, similarity_score double")
    best = summaries.cap_matches(mentions, 2, sample=False)
    assert rows_of(best, "project_id", "issue_id") == [(1, 8), (1, 9), (2, 8), (2, 9)]
    first, again = (rows_of(summaries.cap_matches(mentions.repartition(n), 3, seed=4), "project_id", "issue_id") for n in (1, 7))
    assert first == again and len(first) == 6
