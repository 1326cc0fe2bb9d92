"""Scans of folders with broken files, and what they lost: every file with its size, the rows that were read, and whether it is whole."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file without rows that are opened to see why; larger ones are reported as unread.
OPENED = 256 << 20


def unified(path: Column) -> Column:
    """Local paths are written with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def listed(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """(path, bytes) of all files below a folder whose name fits; contents are not read. Readers pass over files of no bytes, so those come from the list of names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    names = files.inputFiles()  # the list that Spark's driver has of any table
    if not names:
        return spark.createDataFrame([], "path string, bytes long")
    every = spark.createDataFrame([(n,) for n in names], "path string").select(unified(F.col("path")).alias("path"))
    sizes = files.select(unified(F.col("path")).alias("path"), F.col("length").alias("bytes"))
    return every.join(sizes, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to (path, held, reason): the rows that a Parquet file's footer names, or why it has none."""
    import pyarrow.parquet as pq

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held, reason = None, None
            try:
                held = pq.ParquetFile(io.BytesIO(content.as_py())).metadata.num_rows
            except (pa.ArrowException, OSError) as error:
                reason = str(error).split("\n")[0][:200]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([held], pa.int64()), pa.array([reason], pa.string())], names=["path", "held", "reason"])


def tolerant_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows that can be read of the Parquet files below a folder, with the file of each in ``source_file``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true")
    rows = (reader.schema(schema) if schema else reader).parquet(path)
    return rows.select("*", F.col("_metadata.file_path").alias("source_file"))


def scan_report(spark: SparkSession, rows: DataFrame, path: str, opened: int = OPENED) -> DataFrame:
    """(path, bytes, rows, status, reason) of every file below ``path`` for the rows of ``tolerant_table``.

    ``status``: read (rows came from it), empty (a whole file without rows), broken (its footer or its pages cannot be read; ``reason`` says why) or unread (no rows, and larger
    than ``opened`` bytes). Only files that gave no rows are opened again. A file whose later part is damaged gives the rows before it and counts as read.
    """
    counts = rows.groupBy(unified(F.col("source_file")).alias("at")).agg(F.count("*").alias("rows"))
    files = listed(spark, path).withColumn("at", F.col("path")).join(counts, "at", "left")
    silent = files.where(F.col("rows").isNull() & (F.col("bytes") <= opened)).select("at")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    contents = contents.where(F.col("length") <= opened).withColumn("at", unified(F.col("path"))).join(silent, "at", "left_semi")
    seen = contents.select(F.col("at").alias("path"), "content").mapInArrow(footers, "path string, held long, reason string").withColumnRenamed("path", "at")
    status = F.when(F.col("rows").isNotNull(), "read").when(F.col("held") == 0, "empty").when(F.col("bytes") > opened, "unread").otherwise("broken")
    reason = F.when(status == "broken", F.coalesce("reason", F.when(F.col("bytes") == 0, "it is empty").otherwise("its pages cannot be read")))
    return files.join(seen, "at", "left").select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"), reason.alias("reason"))


def json_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, bytes, rows, bad) of every JSON lines file below ``path``: lines that parse and lines that do not; empty lines count as neither."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = lines.where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    counts = lines.select("source_file", parsed["__bad"].isNotNull().alias("bad")).groupBy(unified(F.col("source_file")).alias("at")).agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("bad"))
    files = listed(spark, path, "*").withColumn("at", F.col("path"))
    return files.join(counts, "at", "left").select("path", "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bad", F.lit(0)).alias("bad"))
