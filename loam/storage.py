"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and the master is local, as in tests on one machine, a fresh folder is made and set."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="loam-shared-")
        spark.sparkContext.setCheckpointDir(there)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loam-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors."""
    path = f"{_session_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> bool:
    """Deletes all tables that written() made in this application; DataFrames that read them end with it. Whether there were any."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
