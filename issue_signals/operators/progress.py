"""Projects to do, trackers and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_PROJECT_ISSUES
from .keys import first_by_key, keyed_merge
from .skew import lookup_join


def projects_to_fetch(projects: DataFrame, issues: DataFrame) -> DataFrame:
    """One project per repository URL, the smallest id, of those without issues."""
    with_issues = issues.select(F.col("project_id").alias("id")).distinct()
    todo = projects.filter(F.col("repository_url").isNotNull()).join(with_issues, "id", "left_anti")
    return first_by_key(todo, ["repository_url"], [F.col("id")])


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("project_id").agg(F.count("issue_id").alias("issues"))


def eligible_projects(issues: DataFrame, more_than: int = MIN_PROJECT_ISSUES) -> DataFrame:
    return issue_counts(issues).filter(F.col("issues") > more_than)


def not_analysed(issues: DataFrame, results: DataFrame, more_than: int = MIN_PROJECT_ISSUES) -> DataFrame:
    """Eligible projects without a result. Issues are counted first: one row per project is joined."""
    done = results.select("project_id").distinct()
    return eligible_projects(issues, more_than).join(done, "project_id", "left_anti")


def above_tracker(issues: DataFrame, tracker: DataFrame) -> DataFrame:
    """Issues above the high-water mark of their project; a project without one starts at 0."""
    joined = lookup_join(issues, tracker, ["project_id"], "left")
    return joined.filter(F.col("issue_id") > F.coalesce("last_issue_id", F.lit(0))).drop("last_issue_id")


def unprocessed_projects(issues: DataFrame, tracker: DataFrame, more_than: int = MIN_PROJECT_ISSUES) -> DataFrame:
    return eligible_projects(above_tracker(issues.select("project_id", "issue_id"), tracker), more_than)


def of_projects(issues: DataFrame, projects: DataFrame) -> DataFrame:
    return lookup_join(issues, projects.select("project_id"), ["project_id"], "left_semi")


def tracker_after(tracker: DataFrame, processed: DataFrame) -> DataFrame:
    """The tracker once processed is committed: the highest issue per project, never lower than before."""
    marks = processed.groupBy("project_id").agg(F.max("issue_id").alias("last_issue_id"))
    raised = marks.unionByName(tracker).groupBy("project_id").agg(F.max("last_issue_id").alias("last_issue_id"))
    return keyed_merge(tracker, raised, ["project_id"], [F.desc("last_issue_id")])


def watermark(table: DataFrame, column: str = "issue_id") -> DataFrame:
    """One row: the highest value, 0 for an empty table."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)).alias("last_issue_id"))


def above_watermark(issues: DataFrame, target: DataFrame) -> DataFrame:
    """Issues above the highest id in the target, as a scalar subquery."""
    return issues.filter(F.col("issue_id") > watermark(target).scalar())


def progress(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: issues to transfer, issues transferred, the difference and the watermark."""
    existing = target.agg(F.count("*").alias("n")).scalar()
    total = F.count_distinct("issue_id")
    return source.agg(
        total.alias("total"),
        existing.alias("existing"),
        (total - existing).alias("remaining"),
        watermark(target).scalar().alias("last_issue_id"),
    )


def next_batch(df: DataFrame, after: Column | int, size: int, key: str = "issue_id") -> DataFrame:
    """The next size rows by key above after; the filter reaches the scan."""
    return df.filter(F.col(key) > after).orderBy(key).limit(size)


def page(df: DataFrame, number: int, size: int, key: str = "issue_id") -> DataFrame:
    return df.orderBy(key).offset(number * size).limit(size)
