"""Keyed tables in buckets: a merge reads and writes the buckets that its keys fall in, and no others.

A row lies in the bucket that the hash of its `by` columns names. The files of a run lie in `data/version=<run>/bucket=<b>`, and
`manifest/<run>` says, once it is written, which version holds which bucket: that one small file is what makes a run's rows
the table. A run reads the manifest of its number and writes that of the next one, so a run that fails half
way has changed nothing, one that is repeated replaces its own files, and readers of an older number see the older table.
Folders that no manifest of interest names any more can be deleted at any time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import first_by_key
from ..session import materialize
from .landing import read_table
from .sinks import ROWS_PER_FILE, conform

#: Buckets of a table. A bucket is written by several tasks, one for ROWS_PER_FILE rows each.
BUCKETS = 64
MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.IntegerType()), T.StructField("rows", T.LongType())])


def bucket_of(by: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str, run: int) -> list[tuple[int, int, int]]:
    """(bucket, version, rows) of the table after `run` runs: a few numbers per bucket. No runs, no rows."""
    rows = read_table(spark, f"{path}/manifest/{run}", MANIFEST).collect()
    return sorted((r["bucket"], r["version"], r["rows"]) for r in rows)


def _read(spark: SparkSession, path: str, parts: list[tuple[int, int, int]], schema: T.StructType) -> DataFrame:
    """The rows of some folders, with their bucket."""
    stored = T.StructType([*schema.fields, T.StructField("version", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    if not parts:
        return spark.createDataFrame([], stored).drop("version")
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v, _ in parts]
    return spark.read.schema(stored).option("basePath", f"{path}/data").parquet(*folders).drop("version")


def read_buckets(spark: SparkSession, path: str, run: int, schema: T.StructType) -> DataFrame:
    """The table after `run` runs."""
    return _read(spark, path, manifest(spark, path, run), schema).drop("bucket")


def read_met(rows: DataFrame, path: str, run: int, schema: T.StructType, by: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets that the keys of some rows fall in, after `run` runs."""
    met = {r[0] for r in rows.select(bucket_of(by, buckets).alias("bucket")).distinct().collect()}
    parts = [p for p in manifest(rows.sparkSession, path, run) if p[0] in met]
    return _read(rows.sparkSession, path, parts, schema).drop("bucket")


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _write(rows: DataFrame, path: str, run: int, keys: Sequence[str], most: int) -> list[tuple[int, int, int]]:
    """Rows with their bucket as version run + 1; most: rows of the largest bucket, about. Returns what was written."""
    parts = max(1, -(-most // ROWS_PER_FILE))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), *keys), F.lit(parts))).repartition("bucket", "part").drop("part")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket").parquet(f"{path}/data/version={run + 1}")
    written = rows.sparkSession.read.schema("bucket int").parquet(f"{path}/data/version={run + 1}")
    return [(b, run + 1, n) for b, n in written.groupBy("bucket").count().collect()]  # a row per bucket


def _close(spark: SparkSession, path: str, run: int, parts: list[tuple[int, int, int]]) -> None:
    spark.createDataFrame(sorted(parts), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{run + 1}")


def merge_into(
    new: DataFrame, path: str, run: int, keys: Sequence[str], order: Sequence[Column], schema: T.StructType, by: Sequence[str] | None = None, buckets: int = BUCKETS
) -> list[int]:
    """Put the rows of new in place of those with the same keys; of several new rows of a key the first in order wins.
    NULL is a key like any other. Returns the buckets that were written.

    by: the part of the keys that names the bucket, and the same for all merges into the table, as is buckets. Only
    buckets with a row that is new or different are written, so merging what is there already writes nothing."""
    spark, by = new.sparkSession, list(by or keys)
    latest = first_by_key(conform(new, schema), keys, order).withColumn("bucket", bucket_of(by, buckets))
    latest = materialize(latest)
    parts = manifest(spark, path, run)
    met = {r[0] for r in latest.select("bucket").distinct().collect()}
    old = _read(spark, path, [p for p in parts if p[0] in met], schema)
    changed = materialize(latest.join(old, _same(latest, old, [*schema.names, "bucket"]), "left_anti"))
    counts = {r[0]: r[1] for r in changed.groupBy("bucket").count().collect()}
    old = _read(spark, path, [p for p in parts if p[0] in counts], schema)
    kept = old.join(changed, _same(old, changed, ["bucket", *keys]), "left_anti")
    before = {b: sum(n for own, _, n in parts if own == b) for b in counts}
    stays = [p for p in parts if p[0] not in counts]
    if counts:
        stays += _write(kept.unionByName(changed), path, run, keys, max(before[b] + n for b, n in counts.items()))
    _close(spark, path, run, stays)
    return sorted(counts)


def insert_into(
    incoming: DataFrame, path: str, run: int, keys: Sequence[str], order: Sequence[Column], schema: T.StructType, by: Sequence[str] | None = None, buckets: int = BUCKETS
) -> list[int]:
    """Add the rows whose keys the table lacks, the first in order of each key, as new files of their buckets.

    Of the stored rows the keys of the buckets that the incoming rows fall in are read; nothing stored is written again."""
    spark, by = incoming.sparkSession, list(by or keys)
    first = materialize(first_by_key(conform(incoming, schema), keys, order).withColumn("bucket", bucket_of(by, buckets)))
    parts = manifest(spark, path, run)
    met = {r[0] for r in first.select("bucket").distinct().collect()}
    stored = _read(spark, path, [p for p in parts if p[0] in met], schema).select("bucket", *keys)
    fresh = materialize(first.join(stored, _same(first, stored, ["bucket", *keys]), "left_anti"))
    counts = {r[0]: r[1] for r in fresh.groupBy("bucket").count().collect()}
    _close(spark, path, run, [*parts, *(_write(fresh, path, run, keys, max(counts.values())) if counts else [])])
    return sorted(counts)
