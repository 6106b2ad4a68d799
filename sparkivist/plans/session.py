"""Session factory, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, partitions: int = 8, app: str = "sparkivist") -> SparkSession:
    """A single-JVM session in UTC, for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARKIVIST_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``; Catalyst prunes its columns."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from the files.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a local master without that
    setting gets a temporary one; on a cluster a missing setting is an error, since a
    machine-local folder would be lost with its executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkivist-checkpoint-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the files of shuffles and checkpoints that no frame needs any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def parallelism(spark: SparkSession) -> int:
    """Partitions to cut a stage into; follows ``spark.sql.shuffle.partitions``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
