"""Streaming forms: landing without duplicates, incremental analysis, alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import above_tracker, tracker_after
from ..plans.health import add_mentions
from ..plans.reports import alerts, daily_mentions
from ..session import materialize
from ..sources.landing import read_table
from ..sources.schemas import TRACKER
from ..sources.sinks import append_run, replace_table

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys that a batch of arrivals is dealt to; a group passes through one worker's memory.
BUCKETS = 2_048
_MICROS, _MICROS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def raw_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Newly landed JSON files, each row with the time its file landed."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return files.withColumn("landed_at", F.col("_metadata.file_modification_time"))


def land_stream(
    raw: DataFrame,
    to_rows: Callable[[DataFrame], DataFrame],
    table: str,
    schema: T.StructType,
    key: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append landed rows to a table, each key once however often and in however many batches it lands.

    raw has id and landed_at; the first arrival of an id wins. key is its name in the table. Which ids have landed is
    kept in the stream's checkpoint, so the stored table is never read. A batch is written under its own number: one that is run again
    after a failure starts from the ids before it and replaces its own rows. Ids of a table that was not written by this
    checkpoint are taken from it when the stream starts for the first time.
    """
    spark = raw.sparkSession
    spark.conf.set(_STATE_STORE, spark.conf.get(_STATE_STORE, None) or _ROCKS)
    stored = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = to_rows(batch)
        old = read_table(batch.sparkSession, adopted, T.StructType([T.StructField(key, schema[key].dataType)])) if adopts else None
        append_run(rows if old is None else rows.join(old, key, "left_anti"), table, schema, _run(batch_id))

    adopted = f"{checkpoint}-adopted"
    adopts = _adopt(spark, table, stored, key, checkpoint, adopted)
    return _once(first_arrivals(raw), write, checkpoint)


def first_arrivals(raw: DataFrame, key: str = "id") -> DataFrame:
    """The rows of a stream whose key has not been met before, the first arrival of each, with landed_at.

    The state is one mark per key; a batch touches the marks of its own keys and no others. Of rows that landed at one
    time the one with the smallest hash is first. NULL is a key. A batch is first brought down to one row per key: within its
    Arrow batches, so that a key that many rows share stays cheap, then in BUCKETS groups of keys, which are many keys each, as
    a call of Python per key takes milliseconds. Spark drops the rows whose key has a mark."""
    fields = T.StructType([f for f in raw.schema.fields if f.name != "landed_at"])
    options = {"timestampFormat": _MICROS, "timestampNTZFormat": _MICROS_NTZ}
    payload = F.to_json(F.struct(*fields.names), {"ignoreNullFields": "false"} | options)
    # a key as text: numbers beside a NULL would become doubles in pandas
    name = F.to_json(F.struct(F.col(key).alias("k")), options)
    narrow = raw.select(name.alias("key"), "landed_at", F.xxhash64(*fields.names).alias("arrival"), payload.alias("payload"))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["landed_at", "arrival"]).drop_duplicates("key")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield first(batch)

    thinned = narrow.mapInPandas(thin, narrow.schema)
    once = thinned.groupBy(F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).applyInPandas(first, narrow.schema)
    new = once.dropDuplicates(["key"])
    return new.select(F.from_json("payload", fields, options).alias("row"), "landed_at").select("row.*", "landed_at")


def _adopt(spark: SparkSession, table: str, stored: T.StructType, key: str, checkpoint: str, adopted: str) -> bool:
    """Whether the table has keys from before this checkpoint; at the stream's first start they are written beside it."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    started = system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/offsets"))
    if not started:
        before = read_table(spark, table, stored).select(key).distinct()
        if before.isEmpty():
            return False
        before.write.mode("overwrite").parquet(adopted)
        return True
    return system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(adopted))


def analyse_stream(
    issues: DataFrame, analyse: Callable[[DataFrame], DataFrame], table: str, schema: T.StructType, checkpoint: str
) -> StreamingQuery:
    """Analyse newly landed issues and append the results. The stream's checkpoint is the tracker: it
    moves only after the results are written, and late issues with low ids are not skipped."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_run(analyse(batch), table, schema, _run(batch_id))

    return _once(issues, write, checkpoint)


def analyse_above_tracker(
    issues: DataFrame,
    tracker_path: str,
    next_tracker_path: str,
    analyse: Callable[[DataFrame], DataFrame],
    table: str,
    schema: T.StructType,
    run_id: str,
) -> None:
    """One tracked run: analyse the issues above the marks, write results, then the raised marks. The
    issues of the run are written once, so that both come from the same rows.

    The new tracker goes to its own path, after the results; a run that fails in between is repeated
    with the old marks and the same run_id.
    """
    tracker = read_table(issues.sparkSession, tracker_path, TRACKER)
    todo = materialize(above_tracker(issues, tracker))
    append_run(analyse(todo), table, schema, run_id)
    replace_table(tracker_after(tracker, todo), next_tracker_path, TRACKER)


def alert_stream(
    mentions: DataFrame, limit: int, delay: str, table: str, checkpoint: str
) -> StreamingQuery:
    """Days on which a criterion passes the limit, written once the watermark has closed the day."""
    closed = alerts(daily_mentions(mentions.withWatermark("created_at", delay)), limit)
    return (
        closed.writeStream.outputMode("append")
        .format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def health_stream(mentions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the daily partials of criteria up to date with a stream of mentions, late ones included; after the batch with
    number b the table has b + 1 runs. A batch that is run again after a failure adds its mentions once."""
    return _once(mentions, lambda batch, batch_id: add_mentions(batch, table, batch_id) and None, checkpoint)


def _run(batch_id: int) -> str:
    return f"batch-{batch_id}"


def _once(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
