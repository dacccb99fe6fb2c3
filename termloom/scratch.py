"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local master (one JVM, one disk) gets a folder of its own; on a cluster, whose
    machines don't see each other's disks, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    The rows are computed once; what follows reads columnar files instead of repeating the work. What is
    read again and again within an operator goes by ``discard`` once nothing refers to it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/termloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote. Only for those that no result still to be computed reads."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path).getParent()
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
