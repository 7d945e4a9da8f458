"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the operators' contracts define it: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_scratch: dict[str, str] = {}
#: What each session has written: folders, and tables of the catalog with their folders.
_written: WeakKeyDictionary[SparkSession, list[tuple[str, str | None]]] = WeakKeyDictionary()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "local" not in _scratch:
        folder = tempfile.TemporaryDirectory(prefix="corvane-")
        atexit.register(folder.cleanup)
        _scratch["local"] = f"file://{folder.name}"
    return _scratch["local"]


def scratch_path(spark: SparkSession, tag: str, table: str | None = None) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append((path, table))
    return path


def scratch_mark(spark: SparkSession) -> int:
    """How much the session has written so far, for ``drop_scratch``."""
    return len(_written.get(spark, []))


def drop_scratch(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the intermediate tables that this session wrote between two marks; results that still
    read them must have been stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    held = _written.get(spark, [])
    gone = held[since:until]
    n = 0
    for name, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        if name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            n += bool(path.getFileSystem(conf).delete(path, True))
    held[since:until] = [("", None)] * len(gone)  # marks taken later stay good
    while held and held[-1] == ("", None):
        held.pop()
    return n


def materialize(df: DataFrame, tag: str, *partition_by: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. With
    ``release`` the driver collects its garbage afterwards, upon which Spark
    deletes the shuffle files that led to the table; without it they would stay
    on the executors' disks until the driver happens to run short of memory.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)


def sorted_buckets(df: DataFrame, tag: str, *keys: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder in buckets by ``keys``, each sorted by them, and read it back.

    Joins and aggregations on ``keys`` with as many shuffle partitions as the
    table has buckets need no exchange of it, and find each file in order.
    ``release`` is that of ``materialize``.
    """
    spark = df.sparkSession
    table = f"corvane_{uuid.uuid4().hex}"
    path = scratch_path(spark, tag, table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    if release:
        spark.sparkContext._jvm.System.gc()
    return spark.table(table)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(df: DataFrame, column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)
