"""Caller-supplied models, run partition-wise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from callweave import schemas
from callweave.functions.text import missing, number
from callweave.session import stored

Model = Callable[[pd.DataFrame], pd.DataFrame]


def map_model(df: DataFrame, fn: Model, in_cols: list[str], out_schema: str, batch: int = 64, retries: int = 1,
              concurrency: int | None = None, carry: list[str] | None = None, store: bool = True) -> DataFrame:
    """``df`` with the columns that ``fn`` computes from ``in_cols``, and an ``error`` column.

    Equal inputs are sent once. ``fn`` gets a frame of ``in_cols`` (and ``carry``) and returns one row per input
    row in ``out_schema``. A failing batch is tried again and then row by row; a row that still fails has NULL
    results and its message in ``error``, and the job goes on. ``concurrency`` bounds the number of calls at a
    time. Results are stored, as asking a model twice may give two answers; ``store=False`` leaves that out.
    """
    spark = df.sparkSession
    names = [f.name for f in StructType.fromDDL(out_schema).fields]
    send = [*in_cols, *(carry or [])]
    key = F.sha2(F.to_json(F.struct(*in_cols), {"ignoreNullFields": "false"}), 256)
    inputs = df.select(key.alias("__key"), *send).dropDuplicates(["__key"])
    if concurrency:
        inputs = inputs.repartition(concurrency, "__key")

    def attempt(rows: pd.DataFrame) -> pd.DataFrame:
        for left in range(retries, -1, -1):
            try:
                out = fn(rows.drop(columns="__key").reset_index(drop=True))
                if len(out) != len(rows):
                    raise ValueError(f"{len(out)} results for {len(rows)} inputs")
                result = out[names].reset_index(drop=True)
                result.insert(0, "__key", rows["__key"].to_numpy())
                result["error"] = None
                return result
            except Exception as e:  # noqa: BLE001 - any failure of the model is a row's error
                if left == 0 and len(rows) == 1:
                    return pd.DataFrame([[rows["__key"].iloc[0], *[None] * len(names), str(e) or type(e).__name__]],
                                        columns=["__key", *names, "error"])
        return pd.concat([attempt(rows.iloc[i:i + 1]) for i in range(len(rows))], ignore_index=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                yield attempt(frame.iloc[start:start + batch])

    results = inputs.mapInPandas(run, f"__key string, {out_schema}, error string")
    if store:
        results = stored(results)
    return df.withColumn("__key", key).join(results, "__key", "left").drop("__key")


class AnswerStore:
    """Answers of models below a folder that all executors see, by the hash of the input.

    An input that has an answer is not asked again, by whichever batch, stream or retry: known answers are read first, and new
    ones are appended in one commit before anything is made of them. Failures are not kept, so they are asked again next time.
    Two jobs that ask the same at the same time may both ask; readers take one of equal inputs' answers.
    """

    def __init__(self, path: str):
        self.path = path

    def _known(self, df: DataFrame, name: str) -> DataFrame:
        spark, place = df.sparkSession, f"{self.path}/{name}"
        schema = "__ask string, result string"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        known = spark.read.schema(schema).parquet(place) if there else spark.createDataFrame([], schema)
        return known.groupBy("__ask").agg(F.min("result").alias("result"))

    def ask(self, df: DataFrame, fn: Model, name: str, in_cols: list[str], **options) -> DataFrame:
        """``df`` with the JSON text ``result`` that ``fn`` gives for ``in_cols``, and ``error``."""
        key = F.sha2(F.to_json(F.struct(*in_cols), {"ignoreNullFields": "false"}), 256)
        keyed, known = df.withColumn("__ask", key), self._known(df, name)
        new = keyed.select("__ask", *in_cols).dropDuplicates(["__ask"]).join(known, "__ask", "left_anti")
        answers = stored(map_model(new, fn, in_cols, "result string", store=False, **options).select("__ask", "result", "error"))
        answers.filter("error is null").select("__ask", "result").write.mode("append").parquet(f"{self.path}/{name}")
        known = self._known(df, name).withColumn("error", F.lit(None).cast("string"))
        return keyed.join(known.unionByName(answers.filter("error is not null")), "__ask", "left").drop("__ask")


@dataclass(frozen=True)
class Models:
    """Models in the place of the rules. Each turns a frame of its input into JSON texts ``result``; None leaves the rule.

    ``extract`` reads ``full_transcript``, ``label`` ``transcript_text``, ``recommend`` the ``prompt`` of a call.
    """

    answers: AnswerStore
    extract: Model | None = None
    label: Model | None = None
    recommend: Model | None = None


def transcribe(manifest: DataFrame, fn: Model, **options) -> DataFrame:
    """Transcripts of segment files: ``fn`` turns ``path`` and ``content`` into a JSON ``result`` per file.

    A file without text gives no row, as there is nothing to store. Audio is read in small Arrow batches; set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` by the size of the files.
    """
    answered = map_model(manifest, fn, ["path"], "result string", carry=["content"], **options).drop("content")
    parsed = F.from_json("result", schemas.TRANSCRIPTION_DDL)
    return answered.withColumns({
        "transcript_text": parsed["text"], "audio_duration": number(parsed["audio_duration"]),
    }).filter(~missing("transcript_text")).drop("result", "error")
