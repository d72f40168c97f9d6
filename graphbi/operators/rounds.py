"""Round storage for iterative DataFrame operators.

Each round of a loop is written as a parquet table below the shared folder of
``spark.checkpoint.dir`` and read back.  That cuts the lineage (the next
round's plan starts at a file scan), survives lost executors, and gives AQE
exact sizes for its broadcast / partition decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.session import scratch_path
from graphbi.sources.parquet import path_exists


class RoundStore:
    def __init__(self, spark: SparkSession, kind: str):
        self.spark = spark
        self.root = scratch_path(spark, kind)
        self._n = 0

    def put(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Write ``df`` as a new table and return a DataFrame reading it."""
        self._n += 1
        path = f"{self.root}/{name or f'r{self._n:05d}'}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def put_parts(self, df: DataFrame, by: list[str]) -> str:
        """Write ``df`` as a new table with a folder for each value of ``by``; its path."""
        self._n += 1
        path = f"{self.root}/r{self._n:05d}"
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        return path

    def put_rows(self, df: DataFrame) -> DataFrame | None:
        """Write ``df`` as a new table; None if it has no rows (told by the written folder, without another job)."""
        path = f"{self.put_parts(df.withColumn('_some', F.lit(True)), ['_some'])}/_some=true"
        return self.spark.read.schema(df.schema).parquet(path) if path_exists(self.spark, path) else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
