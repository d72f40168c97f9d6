"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphbi.session import scratch_path

#: ASCII white space as the word patterns of this package use it (fixed by the contracts).
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read from there.

    Cuts the lineage; a lost executor costs only the tasks that it ran.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, kind)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of ``stored`` once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null texts as empty ones; other columns can't clash with what an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def remainder(id_col: str, n: int):
    """crc32 of the id as decimal text, mod n: the rule by which rows are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


#: Bytes of an Arrow batch of whole texts.
_BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of about ``_BATCH_BYTES`` (a longer row is one of its own).

    10,000 whole texts at once take a task, its Python worker and the way back several times their size; a smaller limit of the session stays."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= _BATCH_BYTES:
        spark.conf.set(name, str(_BATCH_BYTES))
    return df


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_map(df: DataFrame, ddl: str, start: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]]) -> DataFrame:
    """mapInArrow with columns given as Python lists or arrays.

    ``start()`` runs once in each task and returns a function from a batch to {column: values}.
    """
    schema = fields(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, work = to_arrow_schema(schema), start()
        for batch in batches:
            if batch.num_rows:
                yield to_batch(arrow, work(batch))

    return df.mapInArrow(run, schema)


def to_batch(arrow: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else
         x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)


def partition_map(df: DataFrame, ddl: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """mapInArrow for work over a whole partition: ``run`` gets its batches and yields {column: values}."""
    schema = fields(ddl)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for columns in run(batches):
            yield to_batch(arrow, columns)

    return df.mapInArrow(convert, schema)


#: By byte: A-Z to a-z; other ASCII but digits and letters to a space; bytes of other characters stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: By byte: A-Z to a-z, all others stay.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def sampled_labels(labels: DataFrame, value: str, most: int, where=None) -> DataFrame:
    """(doc_id, value): labelled ids in a sample of about ``most`` rows at most, chosen by a hash of the id.

    Repeated labels of an id count once, as the largest; null labels don't count.
    """
    rows = labels.select(F.col("doc_id"), F.col(value).cast("int").alias(value)).where(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
    rows = (rows if where is None else rows.where(where)).groupBy("doc_id").agg(F.max(value).alias(value))
    n, slots = rows.count(), 1 << 20
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < F.lit(slots * most // n))
