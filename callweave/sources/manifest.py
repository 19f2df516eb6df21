"""Segment files of recorded calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callweave.functions.shapes import segment_name

# Fixed value: the columns of Spark's binary file source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def describe(files: DataFrame) -> DataFrame:
    """Parse the file names of a listing into case, call, chunk, time and stream label."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file_name", name).select(
        "path", "file_name", *segment_name("file_name"), *[c for c in ("length", "content") if c in files.columns])


def segment_manifest(spark: SparkSession, path: str, with_content: bool = False, stream: bool = False) -> DataFrame:
    """List segment files below ``path``. Their bytes are read only when asked for."""
    reader = spark.readStream.schema(BINARY_FILE) if stream else spark.read
    files = reader.format("binaryFile").option("pathGlobFilter", "*.mp3").option("recursiveFileLookup", "true").load(path)
    return describe(files if with_content else files.drop("content"))
