"""File sources and schema probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def optional(df: DataFrame, name: str, default) -> Column:
    """The column, or a constant of its name if the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(default).alias(name)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table, or no rows if it does not exist."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size and modification time of all files below ``path``; contents are not read. Spark
    does not see files whose names begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified"))


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """What ``list_files`` gives, and the folders on the way to the files: their size is zero, they are as old as
    their youngest file. Folders without files are unknown to an object store and to this listing."""
    base = path.rstrip("/")
    files = list_files(spark, base).withColumn("is_dir", F.lit(False))
    below = F.regexp_replace("path", f"^.*?\\Q{base.split(':', 1)[-1].lstrip('/')}\\E/", "")
    steps = F.split(below, "/")
    above = files.where(F.size(steps) > 1).select("path", "modified", below.alias("below"), F.explode(F.sequence(F.lit(1), F.size(steps) - 1)).alias("k"))
    cut = F.concat(F.expr("substring(path, 1, length(path) - length(below))"), F.array_join(F.slice(F.split("below", "/"), F.lit(1), F.col("k")), "/"))
    folders = above.select(cut.alias("path"), "modified").groupBy("path").agg(F.max("modified").alias("modified"))
    folders = folders.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(0).cast("long").alias("size"), "modified", F.lit(True).alias("is_dir"))
    return files.unionByName(folders)
