"""Driver tables in the roles of the domain tables, and the parameters of the registered queries.

The prose of the tables is invented, so word lists are chosen among strings that occur in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from issue_signals.functions.text import clean_issue_text
from issue_signals.operators.combine import combined_issues
from issue_signals.operators.scoring import embed, sentiment
from issue_signals.operators.similarity import mean_vector, mention_scores, mentions_of, signed, word_lookup
from issue_signals.session import spread

ATTRIBUTES = [
    (1, "license", "the terms under which a thing may be used", "apache, mit, license"),
    (2, "testability", "how a thing can be put to the test", "test, token, erst"),
    (3, "reliability", "that it does the same as before and is free of errors", "free, ment, error"),
    (4, "availability", "that the server is there for all", "server, com"),
    (5, "usability", "what it is like to work with this", "with this, tion la"),
    (6, "execution time", "how long it is until the end of a run", "date, time"),
    (7, "security", None, ""),
    (8, "cost", "what one has to pay for it", "['sell', 'free', 'hand']"),
]
ATTRIBUTE_SCHEMA = "attribute_id int, attribute string, definition string, related_words string"

WORDS = [
    (0, "license", "the apache license", 0.9),
    (1, "license", "released under the mit license", 0.8),
    (2, "reliability", "and the error is on", 0.7),
    (3, "cost", "that is free for", 0.6),
    (4, "reliability", "that is free for", 0.5),
    (5, "usability", "with this to be of it", 0.75),
    (6, "usability", "la que de", 0.65),
    (7, "usability", "la que de", 0.55),
]
WORD_SCHEMA = "word_no long, criteria string, similar_word string, max_w2v_score double"

POSITIVE = ["hand", "there", "rest", "tion", "able"]
NEGATIVE = ["heat", "then", "thing", "que", "ment", "wrong"]
TYPE_WORDS = {
    "bug_fix": ["heat", "error"],
    "feature": ["thing", "ment"],
    "dependency": ["version", "ther"],
    "documentation": ["doc", "tion"],
}
CONTEXT_TYPE_WORDS = {
    "bug_fix": ["heat", "error"],
    "feature": ["thing"],
    "dependency": ["ther"],
    "documentation": ["tion"],
}
CONTEXT_ATTRIBUTE = "Thin there"
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "is", "la", "de"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of parameters."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    entries = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*entries)))


def attributes(spark: SparkSession) -> DataFrame:
    return inline_table(spark, ATTRIBUTES, ATTRIBUTE_SCHEMA)


def words(spark: SparkSession) -> DataFrame:
    return inline_table(spark, WORDS, WORD_SCHEMA)


def project_id():
    return F.substring("source", 4, 10).cast("long")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("issue_id"), project_id().alias("project_id"),
        F.col("doc_id").cast("int").alias("number"), F.lit("open").alias("state"),
        F.length("text").alias("comments"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("created_at"),
        F.col("lang").alias("title"), F.lit("User").alias("owner_type"), F.col("text").alias("body_text"),
    )


def issues_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some titles and bodies NULL, some issues by bots."""
    rows = issues(spark, sf_dir)
    return (
        rows.withColumn("body_text", F.when(F.col("title") != "es", F.col("body_text")))
        .withColumn("owner_type", F.when(F.col("title") == "fr", F.lit("Bot")).otherwise(F.lit("User")))
        .withColumn("title", F.when(F.col("title") != "de", F.col("title")))
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("issue_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("text").alias("body_text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combined_issues(issues(spark, sf_dir), comments(spark, sf_dir))


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("issue_id"), clean_issue_text("text").alias("clean_issue_text")
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute 1 from quality, graded 0.5 when also toxic; attribute 2 from toxic."""
    quality = F.when((F.col("quality") == 1) & (F.col("toxic") == 1), F.lit(0.5)).otherwise(F.col("quality").cast("double"))
    rows = F.array(
        F.struct(F.lit(1).alias("attribute_id"), quality.alias("is_related")),
        F.struct(F.lit(2).alias("attribute_id"), F.col("toxic").cast("double").alias("is_related")),
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("issue_id"), F.inline(rows))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("issue_id"), F.col("embedding").alias("vector")
    )


def vector_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue from the vectors: one word per label, four criteria, the mean vector of the label."""
    labelled = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("word_no"), F.col("embedding").alias("vector"))
    means = mean_vector(labelled, ["word_no"])
    named = means.select(
        "word_no", F.format_string("c%d", F.col("word_no") % 4).alias("criteria"),
        F.format_string("w%d", F.col("word_no") % 9).alias("similar_word"),
        (F.col("word_no") * 0.05 + 0.5).alias("max_w2v_score"), "vector",
    )
    looked_up = word_lookup(named.drop("vector"))
    return looked_up.join(means, "word_no")


def text_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("issue_id"), project_id().alias("project_id"), "text")
    return sentiment(docs, "text", positive=POSITIVE, negative=NEGATIVE).select("issue_id", "project_id", "sentiment", "text")


def mentions(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """project_id, criteria, semantic, similarity_score, issue_id of all documents, from the vectors of their texts."""
    keep = ("issue_id", "project_id", "sentiment", *(["text"] if text else []))
    scores = mention_scores(embed(text_sentiment(spark, sf_dir)), vector_words(spark, sf_dir), keep=keep)
    found = mentions_of(scores.withColumn("total", signed("score", "sentiment"))).withColumn("similarity_score", F.round("similarity_score", 4))
    columns = ["project_id", "criteria", "semantic", "similarity_score", "issue_id", "words"]
    return found.select(*columns, *(["text"] if text else []))


def struct(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
