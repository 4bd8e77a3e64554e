"""Readers for landed JSON, CSV exports, databases and stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utc_timestamp
from .schemas import COMMENTS, ISSUES, RAW_COMMENTS, RAW_ISSUES


def read_raw_issues(spark: SparkSession, path: str) -> DataFrame:
    """Landed issue objects, one per line. Lines can be split over tasks."""
    return spark.read.schema(RAW_ISSUES).json(path)


def read_raw_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_COMMENTS).json(path)


def parse_issues(df: DataFrame, json: str) -> DataFrame:
    """Issue objects from a JSON text column."""
    return df.select(F.from_json(json, RAW_ISSUES).alias("raw")).select("raw.*")


def parse_comments(df: DataFrame, json: str) -> DataFrame:
    return df.select(F.from_json(json, RAW_COMMENTS).alias("raw")).select("raw.*")


def _typed(schema: T.StructType, values: dict[str, Column]) -> list[Column]:
    return [values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]


def issue_rows(raw: DataFrame) -> DataFrame:
    """The 24 issue columns. The user is flattened, NULL user included; labels and reactions stay
    JSON text, [] and {} when missing; times become timestamps."""
    times = {c: utc_timestamp(c) for c in ("created_at", "updated_at", "closed_at")}
    values = {
        "issue_id": F.col("id"),
        "owner": F.col("user.login"),
        "owner_type": F.col("user.type"),
        "owner_id": F.col("user.id"),
        "labels": F.coalesce("labels", F.lit("[]")),
        "reactions": F.coalesce("reactions", F.lit("{}")),
    }
    return raw.select(*_typed(ISSUES, values | times))


def comment_rows(raw: DataFrame) -> DataFrame:
    """The 11 comment columns."""
    times = {c: utc_timestamp(c) for c in ("created_at", "updated_at")}
    return raw.select(*_typed(COMMENTS, {"owner": F.col("user.login")} | times))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Exports with a header, doubled quotes and line breaks inside quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def jdbc_options(
    url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, tasks: int = 1, fetch: int = 10_000
) -> dict[str, str]:
    """Options of a database read. With a key the read is cut in ranges of it, one task each."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch)}
    if url.startswith("jdbc:sqlite:"):
        options["driver"] = "org.sqlite.JDBC"
    elif url.startswith("jdbc:postgresql:"):
        options["driver"] = "org.postgresql.Driver"
    if key:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(tasks)}
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], **ranges) -> DataFrame:
    """The columns of a database table; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **ranges)).load().select(*columns)


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A stored table; one that was never written reads as empty."""
    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df
