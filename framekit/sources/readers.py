"""Sources and sinks: CSV with a schema, names, column choice, skipped rows, dates and converters; parquet; raw arrays; listings; images' bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame
from ..functions.collections import as_category
from ..functions.missing import nan_to_null
from ..functions.udf import value_function

#: Spark type of a Python or NumPy type's name. Unsigned integers take the next wider type.
TYPES = {
    "int": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float": "double", "float32": "float", "float64": "double", "bool": "boolean", "str": "string", "object": "string", "datetime64[ns]": "timestamp_ntz", "date": "date",
}


def spark_type(kind) -> str:
    name = kind if isinstance(kind, str) else getattr(kind, "__name__", str(kind))
    return TYPES.get(name, name)


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", delimiter: str | None = None, names: list[str] | None = None, usecols: list | None = None, dtype: dict | None = None,
    converters: dict[str, Callable] | None = None, skiprows: int | None = None, parse_dates: list | None = None, sample: float = 0.1,
) -> Frame:
    """A CSV file, folder or glob as a frame; the scan reads only the columns that are used later.

    With ``names`` there is no header. Types come from ``dtype`` (a dictionary, complete or not); for columns without, from a sample of the rows.
    A converter is a function from Column to Column (the text), or (function, type) for a Python function. ``skiprows`` drops that many lines
    at the start of each file (quoted cells then hold no line ends). Empty cells are missing. A dtype of ("category", [values]) gives codes.
    """
    dtype, converters, sep = dict(dtype or {}), converters or {}, delimiter or sep
    reader = spark.read.option("sep", sep).option("header", names is None and not skiprows).option("nullValue", "")
    source = path
    if skiprows:
        lines, head = _lines_after(spark, path, skiprows, names is None)
        names_found, source = names or head.split(sep), lines
    else:
        names_found = names or reader.csv(path, enforceSchema=False).columns

    def load(schema: T.StructType | None, fraction: float | None = None) -> DataFrame:
        if skiprows:
            kind = schema or T.StructType([T.StructField(n, T.StringType()) for n in names_found])
            parsed = F.from_csv("line", kind.simpleString()[7:-1].replace(":", " "), {"sep": sep, "nullValue": ""})
            return source.select(parsed.alias("r")).select("r.*")
        r = reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", fraction)
        df = r.csv(path)
        return df if schema else df.toDF(*names_found)

    typed = {c: spark_type(k) for c, k in dtype.items() if not isinstance(k, tuple)}
    typed |= {c: "string" for c in [*converters, *[c for c, k in dtype.items() if isinstance(k, tuple)]]}
    dates = [names_found[c] if isinstance(c, int) else c for c in parse_dates or []]
    typed |= dict.fromkeys(dates, "timestamp_ntz")
    if missing := [n for n in names_found if n not in typed]:
        guessed = dict(load(None, sample).dtypes) if not skiprows else dict.fromkeys(missing, "string")
        typed |= {n: guessed[n] for n in missing}
    schema = T._parse_datatype_string(", ".join(f"`{n}` {typed[n]}" for n in names_found))
    df = load(schema)
    if usecols is not None:
        wanted = {names_found[c] if isinstance(c, int) else c for c in usecols}
        df = df.select([n for n in names_found if n in wanted])
    for c, how in converters.items():
        if c in df.columns:
            expr: Column = value_function(how[0], how[1])(F.col(f"`{c}`")) if isinstance(how, tuple) else how(F.col(f"`{c}`"))
            df = df.withColumn(c, expr)
    for c, k in dtype.items():
        if isinstance(k, tuple) and c in df.columns:
            df = as_category(df, c, list(k[1]))
    return Frame(nan_to_null(df))


def _lines_after(spark: SparkSession, path: str, skip: int, header: bool) -> tuple[DataFrame, str | None]:
    """The lines (``line``) of each file after the first ``skip`` and, if there is one, the header, which is also returned.

    Files are split as ever. A line's number is known where it matters, in the split that begins its file: numbers within
    a task, less the file's first.
    """
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    first = text.where("start = 0").groupBy("file").agg(F.min("id").alias("first"))
    numbered = text.join(first, "file", "left").withColumn("number", F.when(F.col("start") == 0, F.col("id") - F.col("first")))
    lines = numbered.where((F.col("number").isNull() | (F.col("number") >= skip + int(header))) & (F.col("line") != "")).select("line")
    found = numbered.where(F.col("number") == skip).orderBy("file").first() if header else None
    return lines, found["line"] if found else "" if header else None


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, **keys) -> Frame:
    df = spark.read.parquet(path)
    return Frame.of(df.select(*columns) if columns else df, **keys)


def from_dict(spark: SparkSession, data: dict, index: list | None = None, schema: str | None = None) -> Frame:
    """A frame of columns given as lists; its order is the lists'."""
    rows = [(i, *([index[i]] if index is not None else []), *r) for i, r in enumerate(zip(*data.values(), strict=True))]
    kinds = T._parse_datatype_string(schema) if schema else None
    names = ["__row", *(["index"] if index is not None else []), *data]
    if kinds:
        label = [T.StructField("index", T.StringType() if index and isinstance(index[0], str) else T.LongType())] if index is not None else []
        df = spark.createDataFrame(rows, T.StructType([T.StructField("__row", T.LongType()), *label, *kinds.fields]))
    else:
        df = spark.createDataFrame(rows, names)
    return Frame.of(df, columns=list(data), index=["index"] if index is not None else (), order=["__row"])


def series(spark: SparkSession, data: list, index: list | None = None, kind: str | None = None, name: str = "value"):
    frame = from_dict(spark, {name: data}, index, f"`{name}` {spark_type(kind)}" if kind else None)
    return frame[name]


def from_pandas(spark: SparkSession, pdf) -> Frame:
    """The input connector: an unnamed range index becomes the order, other indexes label columns."""
    flat = pdf.reset_index(names="index") if pdf.index.name is None and not str(type(pdf.index)).endswith("RangeIndex'>") else pdf.reset_index() if pdf.index.name else pdf
    labels = [c for c in flat.columns if c not in pdf.columns]
    df = spark.createDataFrame(flat.assign(__row=range(len(flat))))
    return Frame.of(df, columns=list(pdf.columns), index=labels, order=["__row"])


def paths(spark: SparkSession, pattern: str) -> DataFrame:
    """The files of a glob, one a row, by Spark's own file systems."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def from_file(spark: SparkSession, path: str, kind: str = "float64") -> Frame:
    """Raw arrays: place in the file and value. Files are read whole, each by one task."""
    dtype = np.dtype(kind)
    schema = f"path string, pos long, value {spark_type(dtype.name)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values = np.frombuffer(content, dtype)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(values)), pa.array(np.arange(len(values))), pa.array(values)], ["path", "pos", "value"])

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    return Frame.of(df, columns=["value"], order=["path", "pos"])


def to_file(values: DataFrame, column: str, order: list[str], path: str, kind: str = "float64") -> None:
    """A column's values in order, as one raw file without header in any store of Spark's; ``from_file`` reads it again.

    One file has one writer: the driver, which gets the sorted values batch by batch.
    """
    dtype, spark = np.dtype(kind), values.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy(zero_copy_only=False).astype(dtype).tobytes()])], ["bytes"])

    write_bytes(spark, path, (bytes(r["bytes"]) for r in values.orderBy(*order).select(column).mapInArrow(run, "bytes binary").toLocalIterator()))


def write_bytes(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    """One file of bytes, by Spark's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        for part in parts:
            stream.write(bytearray(part))
    finally:
        stream.close()


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and bytes of image files; ``images.read_images`` decodes PNG, other formats need a Python function of the user's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp}").load(path).select("path", "content")


def to_csv(frame: Frame, path: str, header: bool = True, sep: str = ",") -> None:
    frame.spark().write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def to_parquet(frame: Frame, path: str, partition_by: list[str] | None = None) -> None:
    writer = frame.spark().write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
