"""Session helpers: where iterative plans cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return found or context.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new name below the shared folder."""
    return f"{_folder(spark).rstrip('/')}/codeterra-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. For loops of many rounds: its size is known, where a checkpoint's estimate is
    multiplied by each join and has more digits every round."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forget(*tables: DataFrame | None) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            if "/codeterra-" in path:
                drop_folder(df.sparkSession, path)
