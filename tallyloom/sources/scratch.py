"""Written intermediate tables, which cut lineage and are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local session without that setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again (as ``schema``); Spark deletes the shuffle files of the write when it ends."""
    spark = df.sparkSession
    folder, before = scratch_folder(spark), spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(schema or df.schema).parquet(folder)


def dropped(df: DataFrame) -> None:
    """Deletes the folders that a table read from ``written`` lies in, once nothing reads it any more."""
    spark, folders = df.sparkSession, {f.split("/tables-")[0] + "/tables-" + f.split("/tables-")[1].split("/")[0] for f in df.inputFiles() if "/tables-" in f}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
