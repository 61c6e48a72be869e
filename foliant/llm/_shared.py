"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's ``spark.checkpoint.dir``.

    A temporary folder stands in for it in local mode alone, where driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A place of its own in the shared folder, among the tables of this application."""
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the path that holds it."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends there: later stages that are run again after a lost executor see the same
    rows, and a branch that is used twice is computed once. The table stays for as long as results
    may be read from it; :func:`clear` removes all tables of the application.
    """
    return written(df)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table or folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Remove what this application wrote with :func:`durable`, once its results are stored elsewhere."""
    forget(spark, f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}")


#: Rows that a task turns into Python objects at a time. Spark itself bounds the bytes of an Arrow batch.
SLICE_ROWS = 500


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can never clash with the operator's own."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
