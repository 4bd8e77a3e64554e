"""Session settings and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "issue_signals") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session, where driver and executors are one process, gets a
    temporary folder of its own when the setting is missing.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="issue_signals_")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """Give a table that is read with fewer tasks than cores, because it has few files, to all cores.
    A large table is read with more tasks than that and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes of one Arrow batch. A Python worker holds a batch several times over, as text, words and results.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Bound the Arrow batches of this session (the active one), unless lower bounds are set. Spark's own bound is 10,000 rows,
    so that the memory of a Python worker grows with the table until it holds 10,000 texts."""
    spark = spark or SparkSession.active()
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"-?\d+", spark.conf.get(name, None) or "")
        if now is None or not 0 < int(now.group()) <= bound:
            spark.conf.set(name, str(bound))


def materialize(df: DataFrame) -> DataFrame:
    """df written to the shared folder once, as Parquet, so that several consumers read the columns
    they need instead of computing them again, and a lost executor does not take it away."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
