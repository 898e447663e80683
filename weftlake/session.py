"""Session factory and the few settings the operators depend on."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "weftlake", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine with adaptive execution on and time in UTC."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("WEFTLAKE_DRIVER_MEMORY", "8g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: that of checkpoints.

    It is the cluster's ``spark.checkpoint.dir``.  Where none is set, a session
    on one machine takes a temporary folder of that machine; any other session
    fails, as its executors would not share such a folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftlake-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Splits of a scan that may be spread at most, some gigabytes.
SPREAD_SPLITS = 64


def spread(df: DataFrame) -> DataFrame:
    """``df``, in as many partitions as there are cores where a scan of few files has fewer.

    Only for scans and what is narrow upon them, as looking at the partitions
    of others would run their shuffles.  Inputs of many splits are left as
    they are, so no more than SPREAD_SPLITS splits ever go through a shuffle;
    for these, smaller splits (``spark.sql.files.maxPartitionBytes``) do the same.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores and splits <= SPREAD_SPLITS else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_weftlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="weftlake-")) / "weftlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._weftlake_shipped = True
