"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Tables that take more in memory are joined by shuffling, however few their rows.
BROADCAST_BYTES = 32 << 20

_own_root: str | None = None
_held: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = f"file://{tempfile.mkdtemp(prefix='lumen3d-')}"
    return _own_root


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, most_bytes: int = 2 << 20):
    """Arrow batches of at most so many rows and bytes, or one row, meanwhile: rows may hold long texts, and a batch is held whole on both sides."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": most_bytes}
    before = {name: spark.conf.get(name) for name in wanted}
    lower = {name: str(most) for name, most in wanted.items() if not 0 < _in_bytes(before[name]) <= most}
    for name, most in lower.items():
        spark.conf.set(name, most)
    try:
        yield
    finally:
        for name in lower:
            spark.conf.set(name, before[name])


def _in_bytes(setting: str) -> int:
    """A setting's number, which may end with a unit of bytes."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << 10 * ("bkmgt".index(unit[0]) if unit else 0)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the driver ends or releases its tables."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _held.append(path)
    _file_system(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def finished_table(df: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """shared_table of what df() gives; the shared tables that were written for it are deleted."""
    before = len(_held)
    done = shared_table(df(), name)
    for path in _held[before:-1]:
        _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    del _held[before:-1]
    return done


def release_tables(spark: SparkSession) -> int:
    """Deletes the shared tables that this driver has written, which otherwise go when it ends; results that are not written yet are lost with them."""
    n = len(_held)
    while _held:
        path = _held.pop()
        _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return n


def _width(column: Column, kind: DataType) -> Column:
    """About the bytes that a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        each = kind.elementType
        if isinstance(each, (StringType, BinaryType, ArrayType, MapType, StructType)):
            return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(16).cast("long"), lambda total, x: total + _width(x, each).cast("long"))
        return F.greatest(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(kind, MapType):
        return _width(F.map_keys(column), ArrayType(kind.keyType)) + _width(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def size_of(df: DataFrame) -> tuple[int, int]:
    """Rows of a table, and about the bytes that they take in memory."""
    per_row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(16)).cast("long")
    rows, held = df.agg(F.count("*"), F.sum(per_row)).first()
    return rows, held or 0


def broadcast_if_small(df: DataFrame, rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table, marked for broadcasting if it holds at most so many rows and bytes; a row may hold arrays of any length."""
    n, held = size_of(df)
    return F.broadcast(df) if n <= rows and held <= most_bytes else df


def ranked(points: DataFrame, order: list[str]) -> DataFrame:
    """points with place, their number from 0 in an order without ties.

    Each part of a range partitioning numbers its own rows; only the parts' sizes, one row each, meet in one task.
    """
    rows = shared_table(points.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked-parts")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return rows.join(F.broadcast(starts), "_part").withColumn("place", (F.col("_start") + own - 1).cast("long")).drop("_part", "_start")


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values and their numbers from 0 in order, by ranked()."""
    return ranked(values.select(column).distinct(), [column]).select(column, F.col("place").cast("int").alias(name))
