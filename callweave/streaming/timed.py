"""Streams by event time: enrichment points, latest events and call states whose memory has an end.

Time is that of the rows. The watermark is the latest time seen minus ``delay``; it ends what is silent for long enough, and rows
behind it belong to a side table (``route_late``), not to a call that begins anew.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo

from callweave.functions.text import missing
from callweave.operators.events import CLEARS_CALL, STARTS, page
from callweave.sources.chunks import read_chunks
from callweave.streaming.events import LateRouter
from callweave.streaming.transcripts import POINT, ROCKSDB

# The process that prepares a stateful query does not see shipped packages: send the processors themselves.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAST = "call_id string, type string, page bigint, seq bigint, payload string"
STATE = "call_id string, state string"
_LATE = 2**62
BUCKETS = 1 << 12  # of calls whose small slots are kept together


class _Timed(StatefulProcessor):
    """A slot per call with one timer, which moves on with the call's latest row."""

    def timer(self, due: int) -> None:
        for old in list(self.handle.listTimers()):
            if old == due:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(due)

    def close(self) -> None:
        pass


class _Points(_Timed):
    """Enrichment points of a call.

    The fold holds the joined length, the length at the last point, the latest time, whether the call has ended and the last
    chunk. A chunk costs one lookup and one update; texts are read when there is a point to give, or may be.
    """

    def __init__(self, min_chars: int, silence_ms: int):
        self.min_chars, self.silence_ms = min_chars, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.texts = handle.getMapState("texts", "chunk bigint, at bigint, id bigint", "text string")
        self.fold = handle.getValueState("fold", "chars bigint, n bigint, done bigint, latest bigint, ended boolean")

    def _point(self, key: tuple, reason: str) -> tuple:
        entries = sorted((k, v[0]) for k, v in self.texts.iterator())
        text = " ".join(t for _, t in entries)
        numbered = [k[0] for k, _ in entries if k[0] != _LATE]
        times = [k[1] for k, _ in entries if k[1] != _LATE]
        return (key[0], numbered[-1] if numbered else None, len(text.strip()), reason, text, min(times, default=None), max(times, default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chars, n, done, latest, ended = self.fold.get() if self.fold.exists() else (0, 0, 0, 0, False)
        out, corrected = [], False
        new = sorted((int(c), int(a), int(i), t, bool(e)) for f in rows for c, a, i, t, e in zip(f["chunk"], f["at"], f["id"], f["text"], f["ended"]))
        for chunk, at, ident, text, last in new:
            if at != _LATE:
                latest = max(latest, at // 1000)
            place = (chunk, at, ident)
            if text and not self.texts.containsKey(place):
                self.texts.updateValue(place, (text,))
                chars, n, corrected = chars + len(text), n + 1, corrected or ended
            if not ended and (last or chars + n - 1 - done >= self.min_chars):
                point = self._point(key, "growth")
                if point[2] - done >= self.min_chars:
                    done = point[2]
                    out.append(point)
                elif last:
                    done = point[2]
                    out.append((*point[:3], "end", *point[4:]))
            ended = ended or last
        if corrected:  # after the end: the whole batch at once
            out.append(self._point(key, "late"))
            done = out[-1][2]
        self.fold.update((chars, n, done, latest, ended))
        self.timer(latest + self.silence_ms)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, ended = self.fold.get()[2], self.fold.get()[4]
        point = self._point(key, "end")
        self.texts.clear()
        self.fold.clear()
        if not ended and point[2] > done:
            yield _frame([point])


def _frame(points: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(points, columns=[c.split(" ")[0] for c in POINT.split(", ")])
    return frame.astype({"chunk_number": "Int64", "started_at": "Int64", "updated_at": "Int64"})


class _Slots(_Timed):
    """Small slots of all calls of a bucket, one map entry each: a call costs one read and one write, and frames, timers and keys
    are paid once for a bucket. The bucket's timer is at or before the first time at which one of its calls is due."""

    def fold(self, rows: Iterator[pd.DataFrame], change: Callable[[dict, tuple], None]) -> dict[str, object]:
        """Rows folded by call, each by ``change`` of its call's dictionary."""
        found: dict[str, dict] = {}
        for frame in rows:
            for row in zip(*(frame[c] for c in frame.columns if c not in ("bucket", "ts", "event_time"))):
                change(found.setdefault(row[0], {}), row[1:])
        return found

    def wake(self, due: int | None) -> None:
        if due is not None and not any(old <= due for old in list(self.handle.listTimers())):
            self.timer(due)

    def wake_again(self, due: int | None, expired: ExpiredTimerInfo) -> None:
        """After a timer, which Spark drops itself, the next one."""
        if due is not None and due not in (expired.getExpiryTimeInMs(), *self.handle.listTimers()):
            self.handle.registerTimer(due)


class _Lifecycle(_Slots):
    """The last numbers of what starts, stops, completes and resets a call. A call that plays is STOPPED after a silence; the slot
    goes one ``keep`` later."""

    def __init__(self, silence_ms: int, keep_ms: int):
        self.silence_ms, self.keep_ms = silence_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "call_id string",
                                        "started bigint, stopped bigint, completed bigint, reset bigint, latest bigint, silent boolean")

    @staticmethod
    def _state(started: int, stopped: int, completed: int, reset: int, silent: bool) -> str:
        if reset >= max(started, stopped, completed):
            return "IDLE"
        if stopped > started:
            return "STOPPED"
        if completed > started:
            return "COMPLETE"
        return ("STOPPED" if silent else "PLAYING") if started >= 0 else "IDLE"

    @staticmethod
    def _change(found: dict, row: tuple) -> None:
        kind, seq, at = row
        place = 0 if kind in STARTS else {"call_ended": 1, "playback_ended": 2, "app_reset": 3}.get(kind)
        if place is not None:
            found[place] = max(found.get(place, -1), int(seq))
        found[4] = max(found.get(4, 0), int(at) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, due = [], None
        for call, found in self.fold(rows, self._change).items():
            slot = list(self.slots.getValue((call,)) or (-1, -1, -1, -1, 0, False))
            for place, value in found.items():
                slot[place] = max(slot[place], value)
            slot[5] = False
            self.slots.updateValue((call,), tuple(slot))
            due = slot[4] + self.silence_ms if due is None else min(due, slot[4] + self.silence_ms)
            out.append((call, self._state(*slot[:4], False)))
        self.wake(due)
        yield pd.DataFrame(out, columns=["call_id", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, due = timerValues.getCurrentWatermarkInMs(), [], None
        for call, slot in list(self.slots.iterator()):
            quiet, ends = slot[4] + self.silence_ms, slot[4] + self.silence_ms + self.keep_ms
            if quiet < now and not slot[5]:
                if self._state(*slot[:4], False) != self._state(*slot[:4], True):
                    out.append((call[0], self._state(*slot[:4], True)))
                if ends >= now:
                    self.slots.updateValue(call, (*slot[:5], True))
            if ends < now:
                self.slots.removeKey(call)
            else:
                next_due = ends if quiet < now else quiet
                due = next_due if due is None else min(due, next_due)
        self.wake_again(due, expiredTimerInfo)
        if out:
            yield pd.DataFrame(out, columns=["call_id", "state"])


class _LastEvents(_Slots):
    """The last event of each type and page of a call. What a call's start or a reset clears leaves the memory at once, the rest
    after a silence. The memory holds numbers: payloads are in the output table."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "call_id string", "at bigint, cleared bigint, last array<struct<type: string, page: bigint, seq: bigint>>")

    @staticmethod
    def _change(found: dict, row: tuple) -> None:
        kind, number, seq, payload, time = row
        place, value = (kind, int(number)), (int(seq), payload)
        found[place] = max(found.get(place, value), value, key=lambda v: (v[0], v[1] is not None, v[1]))
        found[None] = max(found.get(None, 0), int(time) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed, due = [], None
        for call, best in self.fold(rows, self._change).items():
            at, cleared, held = self.slots.getValue((call,)) or (0, -1, [])
            last = {(kind, number): seq for kind, number, seq in held}
            at = max(at, best.pop(None))
            cleared = max([cleared, *[seq for (kind, _), (seq, _) in best.items() if kind in CLEARS_CALL]])
            for place, (seq, payload) in best.items():
                if (seq >= cleared or place[0] in CLEARS_CALL) and last.get(place, seq) <= seq:
                    last[place] = seq
                    changed.append((call, *place, seq, payload))
            self.slots.updateValue((call,), (at, cleared, [(*p, n) for p, n in last.items() if n >= cleared or p[0] in CLEARS_CALL]))
            due = at + self.silence_ms if due is None else min(due, at + self.silence_ms)
        self.wake(due)
        if changed:
            yield pd.DataFrame(changed, columns=["call_id", "type", "page", "seq", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, due = timerValues.getCurrentWatermarkInMs(), None
        for call, slot in list(self.slots.iterator()):
            if slot[0] + self.silence_ms < now:
                self.slots.removeKey(call)
            else:
                due = slot[0] + self.silence_ms if due is None else min(due, slot[0] + self.silence_ms)
        self.wake_again(due, expiredTimerInfo)
        yield from ()


def _run(df: DataFrame, ts: Column, delay: str, processor: StatefulProcessor, schema: str, key: str = "call_id") -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = df.withColumn("event_time", ts).withWatermark("event_time", delay)
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Update", "EventTime")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("call_id"), F.lit(BUCKETS)).alias("bucket")


def timed_points(chunks: DataFrame, min_chars: int, delay: str, silence_ms: int) -> DataFrame:
    """Where calls are to be enriched, with the transcript so far.

    A call ends with an ``ended`` chunk or when nothing has come for ``silence_ms`` behind the watermark. A chunk that comes after
    the end but before the watermark has passed it gives the corrected transcript once more (reason ``late``). What is remembered
    of a call goes with its silence.
    """
    ended = F.coalesce("ended", F.lit(False)) if "ended" in chunks.columns else F.lit(False)
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = chunks.select("call_id", "created_at", F.coalesce("chunk_number", F.lit(_LATE)).alias("chunk"), F.coalesce(at, F.lit(_LATE)).alias("at"),
                         F.coalesce("transcript_id", F.lit(0)).alias("id"), F.when(~missing("transcript_text"), F.col("transcript_text")).alias("text"),
                         ended.alias("ended"))
    return _run(rows, F.col("created_at").cast("timestamp"), delay, _Points(min_chars, silence_ms), POINT)


def timed_call_state(events: DataFrame, delay: str, silence_ms: int, keep_ms: int) -> DataFrame:
    """Lifecycle states as they change; a playing call that is silent is STOPPED, and its slot goes ``keep_ms`` later."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select(_bucket(), "call_id", "type", "seq", F.unix_micros(ts).alias("at"), ts.alias("ts"))
    return _run(rows, F.col("ts"), delay, _Lifecycle(silence_ms, keep_ms), STATE, "bucket")


def timed_last_by_type(events: DataFrame, delay: str, silence_ms: int) -> DataFrame:
    """The last event per call, type and page as it changes. Silent calls leave the memory; their rows are in the output table."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select(_bucket(), "call_id", "type", page().alias("page"), "seq", "payload", F.unix_micros(ts).alias("at"), ts.alias("ts"))
    return _run(rows, F.col("ts"), delay, _LastEvents(silence_ms), LAST, "bucket")


def route_late(spark: SparkSession, chunks: DataFrame, path: str, schema: str, ts: str, delay_seconds: int,
               run: Callable[[DataFrame, Callable, str], None]) -> DataFrame:
    """Send rows behind the watermark to the table ``late`` below ``path``, and give the others as a stream.

    The stream's own watermark should lag by a second more, so that it loses none of these.
    """
    run(chunks, LateRouter(os.path.join(path, "routed"), ts, delay_seconds), os.path.join(path, "routed", "checkpoint"))
    return read_chunks(spark, os.path.join(path, "routed", "on_time"), schema)
