"""The registered queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issue_signals.fixed_values import HYPOTHESIS_TEMPLATES, THRESHOLD_LISTS
from issue_signals.functions import chunks as C
from issue_signals.functions import scores as S
from issue_signals.functions import text as X
from issue_signals.functions.hypotheses import hypotheses, labelling_hypotheses, vote_prompt
from issue_signals.operators import combine, evaluate, keys, keywords, progress, similarity, summaries, word_vectors
from issue_signals.operators.scoring import embed, entailment_scores, sentiment, weighted_compound
from issue_signals.operators.skew import lookup_join
from issue_signals.plans import entailment, health, matches, reports, runs, voting
from issue_signals.plans.corpus import new_corpus_rows
from issue_signals.plans.mentions import criteria_mentions
from issue_signals.session import shared_dir
from issue_signals.sources import buckets, landing, schemas, sinks
from issue_signals.streaming import ingest

from . import standins as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "documents")


# ---------------------------------------------------------------------------- landing and keys

@query
def q_land_issues(spark, sf):
    user = F.struct(F.col("lang").alias("login"), F.lit("User").alias("type"), F.col("doc_id").alias("id"))
    raw = docs(spark, sf).select(
        F.to_json(
            F.struct(
                F.col("doc_id").alias("id"), F.concat(F.lit("https://api.github.com/i/"), "doc_id").alias("url"),
                T.project_id().alias("project_id"), F.lit("https://github.com/a/b").alias("repository_url"),
                F.col("doc_id").cast("int").alias("number"), F.col("source").alias("title"),
                F.when(F.col("lang") != "es", user).alias("user"),
                F.when(F.col("lang") == "en", F.array(F.struct(F.col("source").alias("name")))).alias("labels"),
                F.lit(False).alias("locked"), F.lit("2024-01-02T03:04:05Z").alias("created_at"),
                F.col("text").alias("body_text"),
            )
        ).alias("json")
    )
    rows = landing.issue_rows(landing.parse_issues(raw, "json"))
    return rows.select(
        "issue_id", "url", X.comments_url("url").alias("comments_url"), "project_id",
        X.repository_path("repository_url").alias("repository_path"), "number", "title", "owner", "owner_type",
        "owner_id", "labels", "locked", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        "body_text", "reactions", "state_reason",
    )


@query
def q_land_comments(spark, sf):
    raw = T.table(spark, sf, "conversations").select(
        F.to_json(
            F.struct(
                (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("issue_id"),
                F.struct(F.col("role").alias("login")).alias("user"),
                F.lit("2024-01-02T03:04:05Z").alias("created_at"), F.col("text").alias("body_text"),
            )
        ).alias("json")
    )
    rows = landing.comment_rows(landing.parse_comments(raw, "json"))
    return rows.select(
        "id", "issue_id", "owner", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "body_text"
    )


@query
def q_insert_if_absent(spark, sf):
    incoming = docs(spark, sf).select("doc_id", "source", F.md5("text").alias("text_key"))
    labelled = T.table(spark, sf, "labels").select("doc_id")
    target = docs(spark, sf).join(labelled, "doc_id", "left_semi").select(F.md5("text").alias("text_key"))
    return keys.insert_if_absent(target, incoming, ["text_key"], [F.col("doc_id")])


@query
def q_keyed_merge(spark, sf):
    old = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival")
    )
    return keys.keyed_merge(old, new, ["key"], [F.desc("arrival")])


@query
def q_bucketed_merge(spark, sf):
    """Orders merged into bucketed customers by quarter, then the first quarter again, which changes nothing that came later."""
    at, schema = f"{_fresh_dir(spark)}/balances", T.struct("key long, value double, arrival long")
    old = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"), F.lit(-1).alias("arrival"))
    buckets.insert_into(old, at, 0, ["key"], [F.col("value")], schema)
    new = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("arrival"))
    for run in range(1, 5):
        buckets.merge_into(new.filter(F.col("arrival") % 4 == run - 1), at, run, ["key"], [F.desc("arrival")], schema)
    buckets.insert_into(new, at, 5, ["key"], [F.desc("arrival")], schema)
    return buckets.read_buckets(spark, at, 6, schema)


@query
def q_orphans(spark, sf):
    return keys.orphans(T.table(spark, sf, "labels"), T.table(spark, sf, "embeddings"), "doc_id", "vec_id")


@query
def q_csv_roundtrip(spark, sf):
    path = _fresh_dir(spark)
    table = docs(spark, sf).select("doc_id", "text", "lang")
    sinks.write_csv(table, path)
    return landing.read_csv(spark, path, table.schema)


@query
def q_append_run(spark, sf):
    """Two runs of a results table, the second written twice; a NaN score becomes NULL."""
    path = _fresh_dir(spark)
    rows = T.table(spark, sf, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_type").alias("criteria"), F.lit("+").alias("semantic"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("similarity_score"),
        F.col("event_id").alias("issue_id"),
    )
    sinks.append_run(rows.filter("value < 10"), path, schemas.MENTIONS, "a")
    for _ in range(2):
        sinks.append_run(rows.filter("value >= 10"), path, schemas.MENTIONS, "b")
    stored = landing.read_table(spark, path, schemas.MENTIONS)
    return stored.select("project_id", "criteria", "similarity_score", "issue_id")


def _fresh_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query
def q_land_stream(spark, sf):
    """All documents land twice, the second time under another title; the stream runs after each."""
    at = _fresh_dir(spark)
    raw = docs(spark, sf).select(F.col("doc_id").alias("id"), T.project_id().alias("project_id"), F.col("source").alias("title"))
    for title in (F.col("title"), F.lit("again")):
        raw.withColumn("title", title).write.mode("append").json(f"{at}/in")
        stream = ingest.raw_stream(spark, f"{at}/in", schemas.RAW_ISSUES)
        ingest.land_stream(stream, landing.issue_rows, f"{at}/issues", schemas.ISSUES, "issue_id", f"{at}/mark").awaitTermination()
    return landing.read_table(spark, f"{at}/issues", schemas.ISSUES, ["issue_id", "project_id", "title"])


@query
def q_tracked_runs(spark, sf):
    """Three tracked runs: over the labelled issues, over all, and over all again."""
    at = _fresh_dir(spark)
    issues = T.issues(spark, sf).select("issue_id", "project_id")
    labelled = T.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("issue_id"))

    def analyse(batch):
        return batch.select("project_id", F.lit("c").alias("criteria"), "issue_id")

    for i, seen in enumerate((issues.join(labelled, "issue_id", "left_semi"), issues, issues)):
        ingest.analyse_above_tracker(seen, f"{at}/m{i}", f"{at}/m{i + 1}", analyse, f"{at}/out", schemas.MENTIONS, f"r{i}")
    return landing.read_table(spark, f"{at}/out", schemas.MENTIONS, ["project_id", "issue_id"])


@query
def q_run_mentions(spark, sf):
    """Projects with more than ten issues, in two runs; the second finds nothing new."""
    at = _fresh_dir(spark)
    for run in range(2):
        runs.run_mentions(
            T.issues(spark, sf), T.comments(spark, sf), T.words(spark), at, run, 10, threshold=0.213, positive=T.POSITIVE, negative=T.NEGATIVE
        )
    rows = landing.read_table(spark, f"{at}/mentions", schemas.MENTIONS, schemas.MENTIONS.names)
    return rows.withColumn("similarity_score", F.round("similarity_score", 4))


@query
def q_run_labels(spark, sf):
    """The corpus labelled twice: merged, not added."""
    at = _fresh_dir(spark)
    for run in range(2):
        runs.run_labels(T.corpus(spark, sf), T.attributes(spark), at, run)
    return buckets.read_buckets(spark, f"{at}/labels", 2, schemas.LABELLED).select("issue_id", "project_id", "attribute_id", "nli_label")


@query
def q_run_votes(spark, sf):
    """The second run finds all rules done."""
    at = _fresh_dir(spark)
    for run in range(2):
        runs.run_votes(T.clean_texts(spark, sf), T.truth(spark, sf), T.attributes(spark), at, run, seconds=1.5, model_limit=256)
    return _rounded_measures(buckets.read_buckets(spark, f"{at}/metrics", 2, schemas.METRICS))


@query
def q_run_grid(spark, sf):
    """Two of three chunkings in the first run, all in the second: only the third is scored again."""
    at = _fresh_dir(spark)
    names = [evaluate.threshold_name(t) for t in THRESHOLD_LISTS]
    wanted = entailment.settings(T.attributes(spark), [entailment.DEFAULT_MODEL], threshold_names=names)
    texts = docs(spark, sf).select(F.col("doc_id").alias("issue_id"), "text")
    for run, some in enumerate((wanted.filter("chunking_strategy <> 'newline'"), wanted)):
        runs.run_grid(texts, T.truth(spark, sf), T.attributes(spark), some, at, run, "text", seconds=2.5)
    return _rounded_measures(buckets.read_buckets(spark, f"{at}/metrics", 2, schemas.METRICS))


@query
def q_alert_stream(spark, sf):
    """Days that a watermark of one day has closed, with more than 60 mentions."""
    at = _fresh_dir(spark)
    table = T.table(spark, sf, "events").select(F.col("event_type").alias("criteria"), F.col("ts").cast("timestamp").alias("created_at"))
    table.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{at}/in")
    ingest.alert_stream(stream, 60, "1 day", f"{at}/out", f"{at}/mark").awaitTermination()
    rows = spark.read.schema("day timestamp, criteria string, mentions long").parquet(f"{at}/out")
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# ---------------------------------------------------------------------------- texts

@query
def q_combine_a(spark, sf):
    return combine.combine_labelled(T.issues_with_gaps(spark, sf), T.comments(spark, sf))


@query
def q_combine_b(spark, sf):
    return combine.combine_blank_joined(T.issues_with_gaps(spark, sf), T.comments(spark, sf))


@query
def q_combine_c(spark, sf):
    rows = combine.combined_issues(T.issues_with_gaps(spark, sf), T.comments(spark, sf))
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query
def q_new_corpus_rows(spark, sf):
    target = T.table(spark, sf, "labels").filter("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("issue_id"))
    rows = new_corpus_rows(T.issues(spark, sf), T.comments(spark, sf), target)
    return rows.select("issue_id", "project_id", "issue_text", "clean_issue_text")


@query
def q_text_dedupe(spark, sf):
    rows = docs(spark, sf).select(F.col("doc_id").alias("issue_id"), T.project_id().alias("project_id"), "text")
    texts = keys.with_text_key(rows)
    once = keys.distinct_texts(texts)
    back = keys.back_to_issues(texts.drop("text"), once)
    return back.select("issue_id", "project_id", "text_key", "issues", F.length("text").alias("chars"))


@query
def q_valid_text(spark, sf):
    return docs(spark, sf).select("doc_id", X.is_valid_text("text").alias("valid"))


@query
def q_content_type(spark, sf):
    d = docs(spark, sf)
    return d.select(
        "doc_id", X.content_type("text").alias("content_type"), X.content_type("text", T.TYPE_WORDS).alias("prose_type")
    )


@query
def q_relevance(spark, sf):
    names = F.array(*[F.lit(a[1]) for a in T.ATTRIBUTES], F.lit(T.CONTEXT_ATTRIBUTE))
    rows = docs(spark, sf).select("doc_id", "text", F.explode(names).alias("attribute"))
    return rows.select("doc_id", "attribute", X.is_relevant("text", "attribute").alias("relevant"))


def _judged(spark, sf):
    return docs(spark, sf).select(
        "doc_id", "text",
        F.when(F.col("n_chars") > 1200, F.lit("+")).otherwise(F.lit("-")).alias("sentiment"),
        (F.least("n_chars", F.lit(4000)) / 10000 + 0.55).alias("confidence"),
    )


@query
def q_override(spark, sf):
    final = X.override_sentiment("text", "sentiment", "confidence", T.POSITIVE, T.NEGATIVE)
    rows = _judged(spark, sf).select("doc_id", final.alias("final"))
    return rows.select("doc_id", "final.sentiment", F.round("final.confidence", 4).alias("confidence"))


@query
def q_context(spark, sf):
    attribute = F.lit(T.CONTEXT_ATTRIBUTE)
    context = X.meaningful_context("text", attribute, T.POSITIVE, T.NEGATIVE, T.TYPE_WORDS, T.CONTEXT_TYPE_WORDS)
    titled = F.concat(F.col("text"), F.lit("\n\nTitle:  "), F.col("source"), F.lit(" "), F.col("lang"))
    return docs(spark, sf).select("doc_id", titled.alias("text")).select("doc_id", context.alias("context"))


@query
def q_reason(spark, sf):
    reason = X.sentiment_reason(
        "text", F.lit(T.CONTEXT_ATTRIBUTE), "sentiment", "confidence", T.POSITIVE, T.NEGATIVE, T.TYPE_WORDS, T.CONTEXT_TYPE_WORDS
    )
    return _judged(spark, sf).select("doc_id", reason.alias("reason"))


@query
def q_clean_sent(spark, sf):
    marked = F.concat(F.lit("[CLS] "), F.col("text"), F.lit(" [SEP]"))
    return docs(spark, sf).select("doc_id", X.clean_for_sentiment(marked).alias("clean"))


@query
def q_clean_issue(spark, sf):
    cleaned = keys.update_column(docs(spark, sf).select("doc_id", "text"), "clean_issue_text", X.clean_issue_text("text"))
    return cleaned.drop("text")


@query
def q_split(spark, sf):
    ways = {"polarity": X.split_sentences("text")} | {s: C.pieces("text", s) for s in C.SPLITTERS}
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), p.alias("pieces")) for n, p in ways.items()])
    return docs(spark, sf).select("doc_id", F.inline(rows)).select(
        "doc_id", "strategy", F.posexplode_outer("pieces").alias("piece_no", "piece")
    )


@query
def q_chunk_pack(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(C.packed_chunks("text", 32)).alias("chunk_no", "chunk"))


@query
def q_chunk_fixed(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(C.token_windows("text", 48)).alias("chunk_no", "chunk"))


@query
def q_chunk_lines(spark, sf):
    chunk = C.line_chunker(48)
    return docs(spark, sf).select("doc_id", F.posexplode(chunk(F.col("text"))).alias("chunk_no", "chunk"))


@query
def q_fit_context(spark, sf):
    return docs(spark, sf).select("doc_id", C.fit_context("text", 130).alias("tail"))


@query
def q_related_words(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(X.related_words("text")).alias("word_no", "word"))


@query
def q_stopwords(spark, sf):
    rows = reports.content_words(docs(spark, sf).select("doc_id", "text"), T.STOP_WORDS)
    return rows.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# ---------------------------------------------------------------------------- projects and progress

@query
def q_eligible_projects(spark, sf):
    return progress.eligible_projects(T.issues(spark, sf), 9).orderBy(F.desc("issues"), "project_id")


@query
def q_projects_todo(spark, sf):
    url = F.concat(F.lit("https://github.com/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))
    projects = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), url.alias("repository_url"))
    urgent = T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    todo = progress.projects_to_fetch(projects, urgent.select(F.col("o_custkey").alias("project_id")))
    return todo.select(
        "id", "repository_url", X.repository_path("repository_url").alias("path"),
        X.is_repository_url("repository_url").alias("fetchable"),
    )


def _tracker(spark, sf):
    done = T.table(spark, sf, "labels").filter("quality = 0").select("doc_id")
    marked = docs(spark, sf).join(done, "doc_id").select(T.project_id().alias("project_id"), "doc_id")
    return marked.groupBy("project_id").agg(F.max("doc_id").alias("last_issue_id"))


@query
def q_unprocessed(spark, sf):
    rows = progress.unprocessed_projects(T.issues(spark, sf), _tracker(spark, sf), 1)
    return rows.orderBy(F.desc("issues"), "project_id")


@query
def q_tracker(spark, sf):
    processed = T.issues(spark, sf).filter("title = 'de'").select("project_id", "issue_id")
    return progress.tracker_after(_tracker(spark, sf), processed)


@query
def q_not_analyzed(spark, sf):
    orders = T.table(spark, sf, "orders").withColumnsRenamed({"o_custkey": "project_id", "o_orderkey": "issue_id"})
    results = orders.filter("o_orderpriority = '1-URGENT'")
    return progress.not_analysed(orders, results, 3)


@query
def q_progress(spark, sf):
    source = combine.by_users(T.issues_with_gaps(spark, sf))
    return progress.progress(source, T.table(spark, sf, "labels").select(F.col("doc_id").alias("issue_id")))


@query
def q_next_batch(spark, sf):
    mark = progress.watermark(T.table(spark, sf, "labels").filter("toxic = 1 AND quality = 0"), "doc_id").scalar()
    return progress.next_batch(T.issues(spark, sf).select("issue_id", "project_id"), mark, 100)


@query
def q_page(spark, sf):
    return progress.page(T.issues(spark, sf).select("issue_id", "project_id"), 1, 30)


# ---------------------------------------------------------------------------- vectors

@query
def q_mean_vector(spark, sf):
    means = similarity.mean_vector(T.table(spark, sf, "embeddings"), ["label"], "embedding")
    rows = means.select("label", F.posexplode("vector").alias("position", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query
def q_embed(spark, sf):
    vectors = embed(docs(spark, sf).select("doc_id", "text"), "text", dim=32)
    rows = vectors.select("doc_id", F.posexplode_outer("vector").alias("position", "value"))
    return rows.withColumn("value", F.round("value", 5))


@query
def q_sim_join_v1(spark, sf):
    return T.mentions(spark, sf)


@query
def q_matched_words(spark, sf):
    words = T.vector_words(spark, sf)
    hits = similarity.similar_words(T.vectors(spark, sf), words)
    matched = similarity.matched_words(hits, words)
    rows = matched.select("issue_id", "criteria", F.inline("matched"))
    return rows.select("issue_id", "criteria", "word_no", "word", F.round("score", 4).alias("score"))


@query
def q_sim_join_v2(spark, sf):
    words = T.vector_words(spark, sf).select("word_no", F.col("word").alias("attribute"), "vector")
    rows = sentiment(docs(spark, sf).withColumnRenamed("doc_id", "issue_id"), "text", positive=T.POSITIVE, negative=T.NEGATIVE, neutral=True)
    return similarity.attribute_matches(embed(rows, "text"), words, 0.1, keep=("issue_id", "sentiment"))


@query
def q_large_catalogue(spark, sf):
    """Every word of every language is a catalogue word: far more than a task holds. Texts with the words most like them."""
    words = docs(spark, sf).select("lang", F.explode(F.split(X.clean_issue_text("text"), " ")).alias("word")).filter("word <> ''")
    catalogue = embed(words.distinct().select(F.concat_ws(" ", "lang", "word").alias("word_no")), "word_no")
    texts = embed(docs(spark, sf).select("doc_id", "text"), "text")
    totals = similarity.similar_totals(texts, catalogue, 0.507, keep=("doc_id",), max_words=10_000)
    return totals.select("doc_id", "words", F.round("best", 6).alias("best"), F.round("total", 4).alias("total"))


@query
def q_word_lookup(spark, sf):
    words = docs(spark, sf).select("lang", F.explode(F.split(X.clean_issue_text("text"), " ")).alias("word"))
    counted = words.filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    catalogue = counted.select(
        F.concat_ws(" ", "lang", "word").alias("word_no"), F.col("lang").alias("criteria"),
        F.col("word").alias("similar_word"), (F.lit(1.0) / (F.col("n") + 1)).alias("max_w2v_score"),
    )
    found = similarity.word_lookup(catalogue)
    return found.select("word_no", "criteria", "word", F.round("weight", 6).alias("weight"))


@query
def q_words_per_criteria(spark, sf):
    words = T.vector_words(spark, sf).withColumnRenamed("word", "similar_word")
    return summaries.words_per_criteria(words).select("criteria", F.array_join("words", ",").alias("words"))


# ---------------------------------------------------------------------------- keywords, hypotheses, scores

@query
def q_keyword_join(spark, sf):
    terms = keywords.attribute_terms(T.attributes(spark))
    return keywords.keyword_matches(T.corpus(spark, sf), terms, "clean_issue_text", ("issue_id", "project_id"))


@query
def q_hypotheses(spark, sf):
    catalogue = T.attributes(spark)
    rows = hypotheses(catalogue).unionByName(labelling_hypotheses(catalogue))
    return lookup_join(T.truth(spark, sf).select("issue_id", "attribute_id"), rows, ["attribute_id"])


@query
def q_prompts(spark, sf):
    rows = voting.prompt_chunks(T.clean_texts(spark, sf), T.truth(spark, sf), T.attributes(spark), model_limit=256)
    return rows.select("issue_id", "attribute_id", "version", "max_tokens", "chunk_no", "chunk", F.md5("prompt").alias("prompt_md5"))


@query
def q_truth(spark, sf):
    rows = T.truth(spark, sf)
    return rows.select("issue_id", "attribute_id", "is_related", X.graded_label("is_related").alias("label"))


@query
def q_nli_scores(spark, sf):
    texts = docs(spark, sf).select(F.col("doc_id").alias("issue_id"), "text")
    scores = entailment.score_grid(texts, T.truth(spark, sf), T.attributes(spark), "text", chunkings=["sentence"], limits=[32])
    rows = scores.select(
        "issue_id", "attribute_id", "chunking_strategy", "max_tokens",
        F.posexplode(F.arrays_zip("max_scores", "mean_scores")).alias("position", "s"),
    )
    return rows.select(
        "issue_id", "attribute_id", "chunking_strategy", "max_tokens", "position",
        F.round("s.max_scores", 8).alias("max_score"), F.round("s.mean_scores", 8).alias("mean_score"),
    )


@query
def q_null_text(spark, sf):
    """A text that is missing scores 0 for every hypothesis."""
    asked = F.array(F.lit("the license of it"), F.lit("with that server on"))
    rows = docs(spark, sf).select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("chunk"), asked.alias("hypotheses"))
    scored = entailment_scores(rows)
    return scored.select("doc_id", F.round(F.get("scores", F.lit(0)), 6).alias("first"), F.round(F.get("scores", F.lit(1)), 6).alias("second"))


def wordy_model():
    """A model in the caller's hands: its labels become signs."""

    def classify(texts):
        return [("POSITIVE" if " the " in t else "NEGATIVE", 0.75) for t in texts]

    return classify


@query
def q_model_sentiment(spark, sf):
    rows = sentiment(docs(spark, sf).select("doc_id", "text"), "text", wordy_model)
    return rows.select("doc_id", "sentiment", "confidence", "sentiment_error")


@query
def q_entailment(spark, sf):
    logits = F.transform("embedding", lambda v: v.cast("double") * 10)
    ends = F.array(F.element_at(logits, 1), F.element_at(logits, -1))
    return T.table(spark, sf, "embeddings").select(
        "vec_id", F.round(S.entailment(logits), 7).alias("sweep"), F.round(S.entailment(logits, 0), 7).alias("production"),
        F.round(S.entailment(ends), 7).alias("two_classes"),
    )


@query
def q_cascade(spark, sf):
    scores = F.transform("embedding", lambda v: F.round(F.least(F.abs(v.cast("double")) * 2.5, F.lit(1.0)), 4))
    verdict = S.labelling_verdict("scores")
    rows = T.table(spark, sf, "embeddings").select("vec_id", scores.alias("scores"))
    return rows.select(
        "vec_id", S.passes_cascade("scores", THRESHOLD_LISTS[0]).alias("lenient"),
        S.passes_cascade("scores", THRESHOLD_LISTS[1]).alias("middle"),
        S.passes_cascade("scores", THRESHOLD_LISTS[2]).alias("strict"),
        verdict["label"].alias("nli_label"), X.verdict_json(verdict["label"], verdict["score"]).alias("nli_json"),
    )


@query
def q_label_corpus(spark, sf):
    rows = entailment.label_corpus(T.corpus(spark, sf), T.attributes(spark))
    return rows.select("issue_id", "project_id", "attribute_id", "nli_label", F.round("score", 4).alias("score"))


@query
def q_votes(spark, sf):
    events = T.table(spark, sf, "events").select(
        "user_id", F.date_trunc("day", "ts").alias("trial"),
        F.when(F.col("event_type") == "error", F.lit(" Yes ")).otherwise(F.col("event_type")).alias("answer"),
    )
    return evaluate.vote_results(evaluate.trial_results(events, ["user_id"]), ["user_id"])


@query
def q_vote_eval(spark, sf):
    prompts = voting.prompt_chunks(T.clean_texts(spark, sf), T.truth(spark, sf), T.attributes(spark), model_limit=256)
    rows = voting.evaluate_votes(voting.vote_predictions(prompts))
    return _rounded_measures(rows.drop("tp", "fp", "fn", "tn"))


def _rounded_measures(df: DataFrame, digits: int = 6) -> DataFrame:
    for c in ("precision", "recall", "specificity", "accuracy", "f1_score"):
        df = df.withColumn(c, F.round(c, digits))
    return df


@query
def q_metrics(spark, sf):
    terms = keywords.attribute_terms(T.attributes(spark))
    hits = keywords.keyword_matches(T.clean_texts(spark, sf), terms, "clean_issue_text").withColumn("hit", F.lit(1.0))
    rows = T.truth(spark, sf).join(hits, ["issue_id", "attribute_id"], "left")
    judged = rows.withColumn("prediction", F.coalesce("hit", F.lit(0.0)))
    both = [
        evaluate.quality(judged, ["attribute_id"], half).withColumn("half_label", F.lit(half)) for half in ("drop", "negative")
    ]
    return _rounded_measures(T.union_all(both))


def _grid(spark, sf):
    texts = docs(spark, sf).select(F.col("doc_id").alias("issue_id"), "text")
    scores = entailment.score_grid(texts, T.truth(spark, sf), T.attributes(spark), "text")
    return entailment.evaluate_grid(scores)


@query
def q_grid(spark, sf):
    return _rounded_measures(_grid(spark, sf))


@query
def q_grid_todo(spark, sf):
    done = _grid(spark, sf).filter("f1_score > 0")
    names = [evaluate.threshold_name(t) for t in THRESHOLD_LISTS]
    wanted = entailment.settings(T.attributes(spark), [entailment.DEFAULT_MODEL], threshold_names=names)
    return evaluate.todo(wanted, done, schemas.SCORE_METRICS_KEY)


@query
def q_vote_todo(spark, sf):
    """Wanted groups are users, a rule is an event type; done are groups with all of them on a weekday."""
    events = T.table(spark, sf, "events").filter("value > 20").select(
        "user_id", F.dayofweek("ts").alias("weekday"), F.col("event_type").alias("aggregation_logic")
    )
    wanted = T.table(spark, sf, "events").select("user_id", F.dayofweek("ts").alias("weekday")).distinct()
    return evaluate.vote_todo(wanted, events, ["user_id", "weekday"], 5)


@query
def q_best_config(spark, sf):
    metrics = _rounded_measures(_grid(spark, sf))
    return evaluate.best_setting(metrics, ["attribute_id"], entailment.SETTING)


@query
def q_macro_mean(spark, sf):
    means = evaluate.macro_mean(_rounded_measures(_grid(spark, sf)), ["hypothesis_version", "threshold_config"])
    return _rounded_measures(means, 9)


# ---------------------------------------------------------------------------- sentiment

@query
def q_sentiment(spark, sf):
    rows = sentiment(docs(spark, sf).select("doc_id", "text"), "text", positive=T.POSITIVE, negative=T.NEGATIVE, neutral=True)
    return rows.select("doc_id", "sentiment", F.round("confidence", 5).alias("confidence"))


@query
def q_weighted_sentiment(spark, sf):
    """Lexicon from the benchmark texts: a word's weight is its length less four."""
    words = T.table(spark, sf, "benchmark").select(F.explode(F.split(X.clean_issue_text("text"), " ")).alias("word"))
    lexicon = words.filter("word <> ''").distinct().select("word", (F.length("word") - 4).alias("weight"))
    compound = weighted_compound(docs(spark, sf), lexicon, "text", ["doc_id"])
    return compound.select("doc_id", F.round("compound", 5).alias("compound"), S.sign_of(F.round("compound", 5)).alias("sentiment"))


# ---------------------------------------------------------------------------- whole analyses and reports

@query
def q_mentions(spark, sf):
    rows = criteria_mentions(
        T.issues(spark, sf), T.comments(spark, sf), T.words(spark), 0.213, positive=T.POSITIVE, negative=T.NEGATIVE
    )
    return rows.withColumn("similarity_score", F.round("similarity_score", 4))


@query
def q_matches(spark, sf):
    return matches.matched_attributes(
        T.issues(spark, sf), T.comments(spark, sf), T.attributes(spark), positive=T.POSITIVE, negative=T.NEGATIVE
    )


@query
def q_top_criteria(spark, sf):
    return summaries.value_counts(T.mentions(spark, sf), "criteria", 15)


@query
def q_top_projects(spark, sf):
    return summaries.value_counts(T.mentions(spark, sf), "project_id", 10)


@query
def q_crosstab(spark, sf):
    return summaries.sentiment_table(T.mentions(spark, sf), 5)


@query
def q_histogram(spark, sf):
    rows = summaries.histogram(T.table(spark, sf, "events"), "value", 20)
    return rows.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query
def q_cap_matches(spark, sf):
    rows = summaries.cap_matches(T.mentions(spark, sf), 7, sample=False)
    return rows.select("project_id", "criteria", "issue_id", "similarity_score")


@query
def q_sample_matches(spark, sf):
    return summaries.cap_matches(T.mentions(spark, sf), 7, sample=True).select("project_id", "criteria", "issue_id")


@query
def q_distinct_attributes(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("attribute"), F.col("lang").alias("definition")).distinct()


@query
def q_criteria_report(spark, sf):
    context = X.meaningful_context("text", F.lit(T.CONTEXT_ATTRIBUTE), T.POSITIVE, T.NEGATIVE, T.TYPE_WORDS, T.CONTEXT_TYPE_WORDS)
    rows = T.mentions(spark, sf, text=True).withColumn("context", context).drop("text")
    report = reports.criteria_report(rows)
    return report.select(
        "criteria", "mentions", F.round("positive_share", 5).alias("positive_share"), F.array_join("examples", " | ").alias("examples")
    )


def _neighbours(spark, sf):
    return reports.text_neighbours(docs(spark, sf).select("text"), T.STOP_WORDS)


@query
def q_neighbours(spark, sf):
    return _neighbours(spark, sf)


@query
def q_synonyms(spark, sf):
    criteria = T.inline_table(spark, [(w,) for w in ("license", "test", "that", "with", "on")], "criteria string")
    return reports.synonyms(_neighbours(spark, sf), criteria, 10)


@query
def q_trained_synonyms(spark, sf):
    """Synonyms by vectors that are trained on the whole corpus."""
    criteria = T.inline_table(spark, [(w,) for w in ("license", "test", "that", "with", "on")], "criteria string")
    rows = word_vectors.trained_synonyms(word_vectors.word_vectors(_neighbours(spark, sf)), criteria, 10)
    return rows.withColumn("max_w2v_score", F.round("max_w2v_score", 4))


@query
def q_criteria_daily(spark, sf):
    events = T.table(spark, sf, "events").select(F.col("event_type").alias("criteria"), F.col("ts").alias("created_at"))
    rows = reports.alerts(reports.daily_mentions(events), 60)
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query
def q_criteria_health(spark, sf):
    """Criteria health by day from partials that three runs of arrivals added to, each with late rows of all days."""
    at = f"{_fresh_dir(spark)}/health"
    events = T.table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("criteria"), F.col("ts").alias("created_at"), F.col("value").alias("similarity_score"),
        F.when(F.col("value") >= 10, "+").otherwise("-").alias("semantic"),
    )
    for run in range(3):
        health.add_mentions(events.filter(F.col("event_id") % 3 == run), at, run, 8)
    rows = health.criteria_health(buckets.read_buckets(spark, at, 3, health.HEALTH), 7)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_score", "recent_positive_share", "change")]
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "criteria", "mentions", "recent", "preceding", *rounded)
