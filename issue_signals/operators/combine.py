"""One text per issue from its title, body and comments.

Comments are put together before the join, so issues stay one row each, whatever the number of their
comments: a text is one cell, and everything after it sees the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cap, clean_issue_text, strip


def has_text(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("title").isNotNull() | F.col("body_text").isNotNull())


def by_users(issues: DataFrame) -> DataFrame:
    """Issues with a body, written by people."""
    return issues.filter(
        F.col("body_text").isNotNull() & (F.length("body_text") > 0) & (F.col("owner_type") == "User")
    )


def comment_texts(comments: DataFrame, separator: str) -> DataFrame:
    """issue_id, comment_text: comments in id order; NULL comments are left out."""
    kept = comments.filter(F.col("body_text").isNotNull()).select("issue_id", "id", "body_text")
    ordered = F.array_sort(F.collect_list(F.struct("id", "body_text")))
    text = F.array_join(F.transform(ordered, lambda c: c["body_text"]), separator)
    return kept.groupBy("issue_id").agg(text.alias("comment_text"))


def with_comments(issues: DataFrame, comments: DataFrame, separator: str) -> DataFrame:
    """issues with comment_text (NULL without comments)."""
    return issues.join(comment_texts(comments, separator), "issue_id", "left")


def labelled_parts_text(max_chars: int | None = None) -> Column:
    """title: ..., body, comment: ... joined by blanks; NULL parts left out, no parts gives NULL."""
    title, body, comment = F.col("title"), F.col("body_text"), F.col("comment_text")
    text = F.concat_ws(" ", F.concat(F.lit("title: "), title), body, F.concat(F.lit("comment: "), comment))
    return cap(F.when(F.coalesce(title, body, comment).isNotNull(), text), max_chars)


def blank_joined_text() -> Column:
    """title, body and comments joined by blanks, NULL as '', trimmed."""
    parts = [F.coalesce(c, F.lit("")) for c in ("title", "body_text", "comment_text")]
    return strip(F.concat_ws(" ", *parts))


def paragraph_text() -> Column:
    """title, body and comments as paragraphs; NULL when the title is."""
    comments = F.concat(F.lit("\n\n"), F.col("comment_text"))
    return F.concat(F.col("title"), F.lit("\n\n"), F.col("body_text"), F.coalesce(comments, F.lit("")))


def combine_labelled(issues: DataFrame, comments: DataFrame, max_chars: int | None = None) -> DataFrame:
    """issue_id, project_id, text for mention analysis. Issues without any text drop out."""
    joined = with_comments(has_text(issues), comments, "\n")
    return joined.select("issue_id", "project_id", labelled_parts_text(max_chars).alias("text")).filter(F.col("text").isNotNull())


def combine_blank_joined(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """issue_id, project_id, text for attribute matching."""
    joined = with_comments(has_text(issues), comments, "\n")
    return joined.select("issue_id", "project_id", blank_joined_text().alias("text"))


def combined_issues(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """The corpus table, with the cleaned text beside the text."""
    joined = with_comments(by_users(issues), comments, "\n\n")
    columns = ["issue_id", "project_id", "number", "state", "comments", "created_at"]
    return joined.select(*columns, paragraph_text().alias("issue_text")).withColumn(
        "clean_issue_text", clean_issue_text("issue_text")
    )
