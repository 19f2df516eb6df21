"""Models in the enrichment: equal rows in batch and stream, and one question for each distinct input."""

import json
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from test_streams import TURNS, call, content, worked_example  # noqa: F401

from callweave import schemas
from callweave.config import JobConfig
from callweave.operators import transcript as tr
from callweave.operators.extraction import label_speakers
from callweave.operators.model import AnswerStore, Models
from callweave.plans.enrich import call_times, enrich
from callweave.sources.chunks import read_chunks
from callweave.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests


def asked(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def model(folder, column, answer):
    """A model that leaves a file for every row that it is asked."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        import uuid
        for text in batch[column]:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(text)
        return pd.DataFrame({"result": [answer(t) for t in batch[column]]})
    return run


def fields(text):
    if "leaks" not in text:
        return "no JSON"
    return json.dumps({"response": {"customer_name": "Ruth Okafor", "order_number": "GP400", "product_name": "pond pump", "issue_description": "water leaks from the gasket"}})


def options(prompt):
    return json.dumps({"recommendations": [{"action": f"a{i}", "description": "d", "reasoning": "r", "confidence": "HIGH" if i else None, "icon": "repair" if i else "?"} for i in range(7)]})


@pytest.fixture
def folders(tmp_path):
    out = {k: tmp_path / k for k in ("extract", "recommend", "label")}
    for f in out.values():
        f.mkdir()
    return out


def test_batch_and_stream_ask_once(spark, worked_example, tmp_path, folders):  # noqa: F811
    made = lambda name: Models(AnswerStore(str(tmp_path / name)), model(folders["extract"], "full_transcript", fields), None, model(folders["recommend"], "prompt", options))
    chunks = call(spark, 3).selectExpr("*", "chunk_number = 3 AS ended")
    config, nothing = JobConfig(similarity_threshold_case=0.1, enrichment_min_chars=10**6), spark.createDataFrame([], schemas.TABLES["call_candidate_values"])
    transcripts = tr.full_transcript(chunks).join(call_times(chunks), "call_id")
    one = made("answers")
    batch = enrich(transcripts, worked_example, nothing, config, models=one)
    first = content(batch.events)
    assert len(asked(folders["extract"])) == 1 and len(asked(folders["recommend"])) == 1  # three calls with equal texts
    recs = [json.loads(p)["recommendations"] for t, _, p in first if t == "recommendations"]
    assert [len(r) for r in recs] == [5] * 3 and (recs[0][0]["icon"], recs[0][0]["confidence"], recs[0][1]["confidence"]) == ("replace", "medium", "high")
    assert content(enrich(transcripts, worked_example, nothing, config, models=one).events) == first
    assert len(asked(folders["extract"])) == 1 and len(asked(folders["recommend"])) == 1
    chunks.coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = jobs.enrich_stream(read_chunks(spark, str(tmp_path / "in"), chunks.schema), worked_example, str(tmp_path / "out"), config, models=one)
    assert content(sink.events(spark)) == first and len(asked(folders["extract"])) == 1


def test_labels_and_failures(spark, tmp_path, folders):
    def segments(text):
        if "fails" in text:
            raise ValueError("no answer")
        return json.dumps({"segments": [{"speaker": "AGENT", "text": text[:3]}, {"speaker": "x", "text": text[3:]}]})

    rows = [("a", 0, "good morning"), ("a", 1, "good morning"), ("a", 2, "hm"), ("a", 3, None), ("a", 4, "this fails")]
    chunks = spark.createDataFrame(rows, "call_id string, chunk_number long, transcript_text string")
    models = Models(AnswerStore(str(tmp_path / "answers")), label=model(folders["label"], "transcript_text", segments))
    seen = []
    for _ in range(2):
        out = {r["chunk_number"]: [(s["speaker"], s["text"]) for s in r["segments"]] for r in label_speakers(chunks, models=models).collect()}
        assert out[0] == out[1] == [("agent", "goo"), ("caller", "d morning")]
        assert out[2] == [("caller", "hm")] and out[4] == [("caller", "this fails")] and len(out) == 5
        seen.append([asked(folders["label"]).count(t) for t in ("good morning", "this fails")])
    assert seen[1][0] == seen[0][0] and seen[1][1] > seen[0][1]  # a failing batch is tried again, an answered input never asked again
