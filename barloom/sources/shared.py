"""Tables that cut lineage: written below the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local folder serves a local master only: executors of a cluster would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/barloom-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table: iterations built on it start anew and survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes written tables: what is built on them has been written itself."""
    for table in tables:
        folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._settled_at)
        folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
