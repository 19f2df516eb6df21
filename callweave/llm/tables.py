"""Small things that the operators of this subpackage share on the Spark side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import drop, release, run_dir, stored

__all__ = ["by_slices", "documents", "drop", "in_tables", "keep", "release", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Just the columns an operator reads, as ``doc_id``, ``text`` and ``more``, so that extra columns cannot clash.

    A row without an id cannot be reported and is left out; a null text stays null.
    """
    picked = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")]
    return docs.select(*picked, *[F.col(f"`{c}`") for c in more]).where("doc_id is not null")


def keep(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose id is in the one column of ``ids``."""
    wanted = ids.toDF("__kept_id")
    return docs.join(wanted, docs[f"`{id_col}`"] == wanted["__kept_id"], "left_semi")


def by_slices(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` from one on a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)
    return run


def in_tables(df: DataFrame, free: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again; with ``free``, shuffles that only it needed go at once."""
    spark = df.sparkSession
    path = run_dir(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._callweave_table = path
    del df
    if free:
        release(spark)
    return out
