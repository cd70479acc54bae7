"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, set where it is not.

    It is taken from ``spark.checkpoint.dir`` of the session; only where that is
    unset too (single-JVM tests) is a temporary one made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="pagequarry-checkpoint-")
            atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a frame that reads it.

    Smaller than a checkpoint, and read by column. The table is deleted with the
    application.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, where)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def _delete(spark: SparkSession, where: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the application has ended
        pass
