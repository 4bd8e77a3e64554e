"""Helpers that the operators share: reading, shared tables, small Arrow batches, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issue_signals.session import shared_dir

#: ASCII white space, and what is not: the words of these operators.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch: a batch of long texts stays at some tens of megabytes.
BATCH_ROWS = 500

#: Rows that a Parquet reader decodes together. Spark's 4,096 put as many whole texts into one array of the heap.
READ_ROWS = 256

#: For a table whose rows hold megabytes: look at a page's size after so few rows that it stays near 1 MB. Codecs
#: keep native buffers of the largest page, which can otherwise hold 10,000 rows.
SMALL_PAGES = {"parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "100"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once to the folder that all executors share, and read back with column pruning; options are the writer's.

    Cuts the lineage as checkpoint() does: a lost executor takes nothing away, and a reader of two
    columns does not read the others. A rerun writes a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session, unless a lower bound is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))


def small_reads(spark: SparkSession) -> None:
    """Bound the rows of a Parquet batch for this session, unless a lower bound is set."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(key)) > READ_ROWS:
        spark.conf.set(key, str(READ_ROWS))


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches as batches of about size bytes; no rows, no batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct `row`, beside which an operator's own columns can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
