"""What the corpus operators share: white space, intermediate tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, one in the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Folders written by this process and not yet removed.
_written: list[str] = []


def _folder(spark: SparkSession) -> str:
    _written.append(f"{shared_dir(spark)}/framekit-{uuid.uuid4().hex}")
    return _written[-1]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = f"{_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, in as many buckets of ``key`` as a shuffle has partitions: joins and sums on it don't move it again.

    Buckets need a table for the moment of reading; it is dropped at once, its files stay as those of ``cut`` do.
    """
    spark, path = df.sparkSession, _folder(df.sparkSession)
    name = "framekit_" + path[-32:]
    df.write.bucketBy(partitions(df), key).option("path", path).format("parquet").saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def cleanup(spark: SparkSession) -> int:
    """Remove the intermediate tables of all operators of this process; frames that read them can't be used any more. Returns their number."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def let(value: Column, body) -> Column:
    """``body`` with its argument bound to ``value``, which is then evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def partitions(df: DataFrame, least: int = 1) -> int:
    """A shuffle width for explicitly dealt stages: the session's, which the cluster sizes to its input."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: from ``folder`` if given, else from the installed public tokenizers."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``size`` bytes, so that a worker holds few texts as Python objects at a time.

    At the end memory goes back to the system: workers outlive their tasks and share an executor's limit.
    """
    try:
        for b in batches:
            step = max(1, b.num_rows * size // max(b.nbytes, 1))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
    finally:
        give_back()


def give_back() -> None:
    """Return what this process has freed to the system, where the allocators know how to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
