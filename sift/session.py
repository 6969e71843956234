"""Small helpers about the session: lineage cuts, parallelism."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Inputs up to this size may be shuffled for parallelism alone.
SPREAD_BYTES = 256 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where none is named (tests) take a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = os.path.join(tempfile.gettempdir(), f"sift-checkpoints-{os.getpid()}")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it came as fewer partitions than there are cores and its optimizer's size is within
    SPREAD_BYTES; larger inputs are left as their files are, never shuffled as a whole. Rows don't change."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """df as a stage of its own for the optimizer: expressions above aren't merged with those below, nor filters pushed
    through it. Without it, the staged formulas of scoring would be substituted into one another and grow
    exponentially while planning. At run time it only counts rows."""
    return df.observe(f"stage-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per session's context, so that they needn't have it
    installed or share the driver's search path. The archive is served by the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_sift_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="sift-"), "sift_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    sc._sift_shipped = True
