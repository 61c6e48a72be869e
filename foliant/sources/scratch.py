"""The folder that driver and executors share, for what a query must write on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode alone a temporary folder stands in for it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
    return spark.sparkContext.getCheckpointDir()


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}/{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is made twice of it sees the same rows."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on_its_file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _on_its_file_system(spark, path)
    return system.exists(target)


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    system, target = _on_its_file_system(spark, path)
    system.delete(target, True)


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a stored table's first partition column, by the names of its folders."""
    system, target = _on_its_file_system(spark, path)
    names = [f.getPath().getName() for f in system.listStatus(target)]
    return [n.removeprefix(f"{column}=") for n in names if n.startswith(f"{column}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as a URI; one without a scheme is on the session's default file system."""
    system, target = _on_its_file_system(spark, path)
    uri = system.makeQualified(target).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
