"""Writers. A run writes under its own run_id folder with overwrite, so a run that is repeated after
a failure replaces its rows instead of adding them again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nan_to_null

ROWS_PER_FILE = 5_000_000


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema in their types; a column that df lacks is NULL, NaN becomes NULL."""
    def value(field: T.StructField):
        if field.name not in df.columns:
            return F.lit(None)
        floating = isinstance(df.schema[field.name].dataType, (T.FloatType, T.DoubleType))
        return nan_to_null(field.name) if floating else F.col(field.name)

    return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_run(df: DataFrame, path: str, schema: T.StructType, run_id: str) -> None:
    """Add the rows of one run to a table. The table reads as one, with run_id as partition column."""
    (
        conform(df, schema)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .parquet(f"{path}/run_id={run_id}")
    )


def replace_table(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Write a whole table, for merged or updated rows. path must not be read by df."""
    conform(df, schema).write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
