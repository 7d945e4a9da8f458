"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only a local session may go without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="corvane-tables-"))
        atexit.register(_local[0].cleanup)
    return f"file://{_local[0].name}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and read back: its lineage ends here, a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
