"""Parquet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_parquet_factors(spark: SparkSession, path: str) -> DataFrame:
    """A factor table stored as a directory of parquet files."""
    return spark.read.parquet(path)


def scan_parquet_temporal_window(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Entities alive through [start, end]: created before ``start`` and
    deleted after ``end``; both lifetime columns are dropped.  The range
    predicates reach the parquet reader as pushed filters."""
    df = spark.read.parquet(path)
    return (df.where((F.col("creationDay") < F.lit(start)) & (F.col("deletionDay") > F.lit(end)))
            .drop("creationDay", "deletionDay"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of ``path`` (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` (none if it doesn't exist)."""
    if not path_exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(st.getPath().getName() for st in found if st.isDirectory())


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Put folder ``source`` in the place of ``target``."""
    remove_path(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def scan_batch_partition(spark: SparkSession, path: str, schema, batch_id: str) -> DataFrame:
    """One ``batch_id=`` partition of an entity stored partitioned by batch.

    The partition filter prunes every other directory; a batch without rows
    for this entity (no directory at all) reads as an empty table."""
    from pyspark.sql.types import StructType

    data_schema = StructType([f for f in schema.fields if f.name != "batch_id"])
    if not path_exists(spark, path):
        return spark.createDataFrame([], data_schema)
    full = StructType(list(data_schema.fields)).add("batch_id", "string")
    return spark.read.schema(full).parquet(path).where(F.col("batch_id") == batch_id).drop("batch_id")
