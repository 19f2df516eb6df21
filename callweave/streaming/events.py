"""Deduplication, latest state, lifecycle and late rows of event streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from callweave.operators.events import last_by_type, lifecycle_aggregates, lifecycle_state


def dedup_stream(df: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """The first row per key; the memory of a key ends ``delay`` after it. Use (call_id, segment_id) or
    (call_id, field_name, field_value)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def last_by_type_stream(events: DataFrame) -> DataFrame:
    """Last event per (call, type, page), to be written in update mode; ``events.state_of`` turns rows into the state."""
    return last_by_type(events)


def call_state_stream(events: DataFrame) -> DataFrame:
    """Lifecycle state per call, to be written in update mode."""
    return events.groupBy("call_id").agg(*lifecycle_aggregates()).select("call_id", lifecycle_state().alias("state"))


class LateRouter:
    """A ``foreachBatch`` function that sends rows older than the watermark to a side table.

    The watermark is the latest time of all earlier batches minus ``delay_seconds``. It is kept in one row per
    batch beside the tables, so a restarted query and a repeated batch route the same rows the same way.
    """

    def __init__(self, path: str, ts: str, delay_seconds: int):
        self.path, self.ts, self.delay = path, ts, delay_seconds

    def _table(self, name: str) -> str:
        return os.path.join(self.path, name)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            marks = spark.read.schema("seen timestamp, batch_id bigint").parquet(self._table("marks"))
            seen = marks.filter(F.col("batch_id") < batch_id).agg(F.max("seen")).first()[0]
        ts = F.col(self.ts).cast("timestamp")
        late = F.lit(False) if seen is None else F.coalesce(
            ts < F.lit(seen) - F.make_dt_interval(secs=F.lit(self.delay)), F.lit(False))
        flagged = batch.withColumn("__late", late)
        for name, wanted in (("on_time", False), ("late", True)):
            flagged.filter(F.col("__late") == wanted).drop("__late").write.mode("overwrite").parquet(
                f"{self._table(name)}/batch_id={batch_id}")
        batch.agg(F.max(ts).alias("seen")).write.mode("overwrite").parquet(f"{self._table('marks')}/batch_id={batch_id}")
