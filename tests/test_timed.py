"""Streams by event time: memory that ends, late chunks, and no more work for a chunk of a long call."""

import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import events as ev
from callweave.sources.chunks import read_chunks
from callweave.streaming import jobs, timed, transcripts as st

CHUNK = "call_id string, chunk_number long, created_at timestamp_ntz, transcript_id long, transcript_text string, ended boolean"


def feed(spark, path, batches, schema, transform, out_schema):
    """Batches of rows one after the other through one stream; its rows with their batch, and the rows of state after each."""
    sizes = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        query = (transform(read_chunks(spark, f"{path}/in", schema)).writeStream.outputMode("update").foreachBatch(jobs.batch_writer(f"{path}/out"))
                 .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return spark.read.schema(f"{out_schema}, batch_id long").parquet(f"{path}/out").collect(), sizes


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def chunk(call, n, seconds, text, ended=None):
    return call, n, at(seconds), n, text, ended


def test_silence_ends_a_call_and_its_memory(spark, tmp_path):
    batches = [[chunk("a", 0, 0, "x" * 30), chunk("b", 0, 0, "y" * 5)], [chunk("a", 1, 10, " tail ")], [chunk("z", 0, 5000, "z")], [chunk("zz", 0, 90000, "z")]]
    rows, sizes = feed(spark, tmp_path, batches, CHUNK, lambda s: timed.timed_points(s, 20, "60 seconds", 100_000), st.POINT)
    own = sorted((r["call_id"], r["transcript_chars"], r["reason"]) for r in rows if r["call_id"] in "ab")
    assert own == [("a", 30, "growth"), ("a", 36, "end"), ("b", 5, "end")]
    assert sizes[-1] <= 3 < sizes[1]  # only the last call is left: a chunk, a fold, a timer


def test_late_chunk_gives_the_corrected_transcript_once(spark, tmp_path):
    batches = [[chunk("a", 0, 0, "one"), chunk("a", 2, 20, "three", True)], [chunk("a", 1, 10, "two"), chunk("a", 0, 0, "one")], [chunk("z", 0, 9000, "z")]]
    rows, _ = feed(spark, tmp_path, batches, CHUNK, lambda s: timed.timed_points(s, 100, "60 seconds", 100_000), st.POINT)
    own = sorted((r["batch_id"], r["reason"], r["full_transcript"], r["chunk_number"]) for r in rows if r["call_id"] == "a")
    assert [r[1:] for r in own] == [("end", "one three", 2), ("late", "one two three", 2)]


def test_points_equal_the_batch_form_in_any_cut(spark, sf_dir, tmp_path):
    from callweave.operators import transcript as tr

    rnd = random.Random(4)
    rows = [chunk(f"c{c}", n, 60 * c + n, rnd.choice(["word ", " and more words", "  ", "x"]) * rnd.randint(1, 9)) for c in range(5) for n in range(12)]
    last = {r[0]: r[1] for r in rows}
    rows = [(*r[:5], r[1] == last[r[0]]) for r in rows]
    cuts = [[r for r in rows if r[1] < 4], [r for r in rows if 4 <= r[1] < 5], [r for r in rows if r[1] >= 5]]
    got, _ = feed(spark, tmp_path, cuts, CHUNK, lambda s: timed.timed_points(s, 100, "1 hour", 3_600_000), st.POINT)
    batch = tr.enrichment_points(spark.createDataFrame(rows, CHUNK).drop("ended"), 100).collect()
    keys = ("call_id", "chunk_number", "transcript_chars", "reason")
    assert sorted(tuple(r[k] for k in keys) for r in got) == sorted(tuple(r[k] for k in keys) for r in batch)


def test_a_chunk_of_a_long_call_reads_no_texts():
    """Counted: lookups and updates of a chunk do not grow with the call."""
    reads = []

    class Map(dict):
        def containsKey(self, k):
            return k in self

        def updateValue(self, k, v):
            self[k] = v

        def iterator(self):
            reads.append(len(self))
            return iter(self.items())

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    import pandas as pd

    p = timed._Points(1000, 1000)
    p.texts, p.fold, p.timer = Map(), Value(), lambda due: None
    for n in range(500):
        frame = pd.DataFrame({"chunk": [n], "at": [n], "id": [n], "text": ["0123456789"], "ended": [False]})
        list(p.handleInputRows(("a",), iter([frame]), None))
    assert len(reads) == 5  # 5,499 characters, a point for each thousand


@pytest.fixture(scope="module")
def event_rows():
    rnd = random.Random(6)
    kinds = ["call_started", "call_ended", "playback_ended", "app_reset", "audio_progress", "customer_match", "similar_cases"]
    return [(f"c{rnd.randrange(6)}", n, at(n * 10), rnd.choice(kinds), f'{{"page": {rnd.randrange(2)}}}') for n in range(120)]


EVENT = "call_id string, seq long, ts timestamp_ntz, type string, payload string"


def test_latest_state_and_its_end(spark, tmp_path, event_rows):
    later = [("end", 999, at(10**6), "customer_match", "{}")]
    rows, sizes = feed(spark, tmp_path, [event_rows[:50], event_rows[40:], later, [("end2", 1000, at(2 * 10**6), "x", "{}")]], EVENT,
                       lambda s: timed.timed_last_by_type(s, "1 second", 50_000_000), timed.LAST)
    out = jobs.last_update(spark.createDataFrame(rows, f"{timed.LAST}, batch_id long"), ["call_id", "type", "page"])
    state = ev.state_of(out.where("call_id like 'c%'").select("call_id", "type", "page", F.struct("seq", "payload").alias("last")))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, ev.latest_state(spark.createDataFrame(event_rows, EVENT)).collect()))
    assert sizes[-1] <= 3 < sizes[1]


def test_lifecycle_and_its_end(spark, tmp_path, event_rows):
    later = [[("end", 999, at(k * 10**6), "x", "{}")] for k in (1, 2, 3)]
    rows, sizes = feed(spark, tmp_path, [event_rows[:50], event_rows[50:], *later], EVENT, lambda s: timed.timed_call_state(s, "1 second", 5_000_000, 1000), timed.STATE)
    last = {r["call_id"]: r["state"] for r in sorted(rows, key=lambda r: r["batch_id"]) if r["call_id"] != "end"}
    batch = {r["call_id"]: r["state"] for r in ev.call_state(spark.createDataFrame(event_rows, EVENT)).collect()}
    assert last == {c: "STOPPED" if s == "PLAYING" else s for c, s in batch.items()}
    assert sizes[-1] <= 2 < sizes[1]


class _Counted(dict):
    """A state map that counts what is asked of it."""

    asked = 0

    def getValue(self, k):
        self.asked += 1
        return self.get(k)

    def updateValue(self, k, v):
        self.asked += 1
        self[k] = v

    def removeKey(self, k):
        del self[k]

    def iterator(self):
        return iter(self.items())


@pytest.mark.parametrize("processor", [timed._Lifecycle(1000, 500), timed._LastEvents(1000)], ids=["lifecycle", "last"])
def test_a_bucket_pays_frames_and_timers_once(processor):
    """Counted: one frame and one timer for all calls of a bucket, a read and a write for each call; all memory ends."""
    from types import SimpleNamespace

    import pandas as pd

    timers = []
    processor.slots = _Counted()
    processor.handle = SimpleNamespace(listTimers=lambda: iter(timers), registerTimer=timers.append, deleteTimer=timers.remove)
    n = 300
    frame = pd.DataFrame({"bucket": [7] * n, "call_id": [f"c{i % 100}" for i in range(n)], "type": ["call_started"] * n, "page": [0] * n,
                          "seq": range(n), "payload": ["{}"] * n, "at": [i * 1_000_000 for i in range(n)]})
    if isinstance(processor, timed._Lifecycle):
        frame = frame.drop(columns=["page", "payload"])
    out = list(processor.handleInputRows((7,), iter([frame.iloc[:150], frame.iloc[150:]]), None))
    assert [len(f) for f in out] == [100] and processor.slots.asked == 200 and timers == [201_000]
    stopped = []
    while timers:
        due = timers[0]
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: due + 1)
        stopped += list(processor.handleExpiredTimer((7,), now, SimpleNamespace(getExpiryTimeInMs=lambda: due)))
        timers.remove(due)
    assert not processor.slots
    if isinstance(processor, timed._Lifecycle):
        rows = pd.concat(stopped)
        assert sorted(rows["call_id"]) == sorted(f"c{i}" for i in range(100)) and set(rows["state"]) == {"STOPPED"}
