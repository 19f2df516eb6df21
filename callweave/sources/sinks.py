"""Appends, runtime reset and published update events."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from callweave import schemas
from callweave.functions.text import number


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` in order and type. A missing audio duration counts as 0."""
    wanted = [f.strip().split(" ", 1) for f in schemas.TABLES[table].replace("(12,2)", "(12;2)")
              .replace("(10,2)", "(10;2)").split(",")]
    out = []
    for name, kind in wanted:
        kind = kind.replace(";", ",")
        column = F.col(name) if name in df.columns else F.lit(None)
        column = number(column) if name == "audio_duration" else column.cast(kind)
        out.append(column.alias(name))
    return df.select(*out)


def append_transcripts(df: DataFrame, path: str) -> None:
    """Append transcript rows in one commit."""
    conform(df, "call_transcripts").write.mode("append").parquet(path)


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df,
                 ) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each micro-batch to its own folder.

    A batch that is run again after a failure replaces its own folder, so rows are never written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def reset_runtime(df: DataFrame, call_ids: DataFrame | None = None) -> DataFrame:
    """What is left of a runtime table after a reset: nothing, or the rows of all other calls.

    Write the result to a new path and switch readers to it; a table cannot be overwritten while it is read.
    """
    if call_ids is None:
        return df.filter(F.lit(False))
    return df.join(call_ids.select("call_id").distinct(), "call_id", "left_anti").select(*df.columns)


def to_events(df: DataFrame, kind: str, payload: Iterable[str], call_id: str = "call_id", seq: str | None = None,
              ts: str | None = None) -> DataFrame:
    """Every row as an update event: type, call, sequence, time and the payload columns as one JSON object."""
    if kind not in schemas.EVENT_TYPES:
        raise ValueError(f"unknown event type {kind!r}")
    payload = list(payload)
    body = F.to_json(F.struct(*payload)) if payload else F.lit("{}")
    return df.select(
        F.lit(kind).alias("type"),
        F.col(call_id).cast("string").alias("call_id"),
        (F.col(seq) if seq else F.lit(None)).cast("bigint").alias("seq"),
        (F.col(ts) if ts else F.lit(None)).cast("timestamp_ntz").alias("ts"),
        body.alias("payload"),
    )


def all_events(*events: DataFrame) -> DataFrame:
    """One table or stream of all event types."""
    return reduce(lambda a, b: a.unionByName(b), events)
