"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a local session gets a temporary one; a cluster has none that all machines see, so that is an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="partloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table: its rows are written to the shared folder, so lost executors cost nothing."""
    spark = df.sparkSession
    shared_dir(spark)
    kept = df.checkpoint(eager=True)
    # A checkpoint keeps its origin's size estimate and constraints. In a loop of joins these multiply every round until the driver's memory is full;
    # a frame over the same checkpointed rows starts without them, and adaptive execution goes by the real sizes. Spark offers no public call for that.
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
    del df, kept
    # Shuffle files and checkpoints go when the driver's garbage is collected; in a loop of small jobs that would come too late.
    gc.collect()
    spark._jvm.System.gc()
    return out
