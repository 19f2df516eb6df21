"""Update events: latest state, call lifecycle and stale results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# What an event changes on the agent's screen, and which events clear it.
SLOTS: dict[str, str] = {
    "call_started": "call", "transcript_update": "transcript", "extraction_update": "extraction",
    "customer_match": "customer", "product_match": "products", "similar_cases": "cases",
    "recommendations": "recommendations", "playback_started": "playback", "audio_progress": "playback",
}
CLEARS_CALL = ("call_started", "app_reset")
CLEARS_PLAYBACK = ("playback_ended", "call_ended", "app_reset")
STARTS = ("call_started", "playback_started", "audio_progress")


def slot(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in SLOTS.items()])


def page() -> Column:
    """The page of an event's list, 0 for events that have one page only."""
    return F.coalesce(F.get_json_object("payload", "$.page").cast("bigint"), F.lit(0).cast("bigint"))


def last_by_type(events: DataFrame) -> DataFrame:
    """The last event of each (call, type, page), combined before the shuffle."""
    return events.withColumn("page", page()).groupBy("call_id", "type", "page").agg(F.max(F.struct("seq", "payload")).alias("last"))


def latest_state(events: DataFrame) -> DataFrame:
    """What is shown for each call now: all pages of the last event per slot, unless a later event cleared it."""
    return state_of(last_by_type(events))


def state_of(last: DataFrame) -> DataFrame:
    """State from the last events per type and page. Pages of an older event with more of them go with it."""
    call = Window.partitionBy("call_id")
    cleared = lambda kinds: F.max(F.when(F.col("type").isin(*kinds), F.col("last.seq"))).over(call)
    limit = F.when(F.col("slot") == "playback", F.col("playback_cleared")).otherwise(F.col("call_cleared"))
    alive = limit.isNull() | (F.col("last.seq") > limit) | (
        (F.col("type") == "call_started") & (F.col("last.seq") == limit))
    return (
        last.withColumns({
            "call_cleared": cleared(CLEARS_CALL), "playback_cleared": cleared(CLEARS_PLAYBACK),
            "slot": slot(F.col("type")),
        })
        .filter(F.col("slot").isNotNull() & alive)
        .withColumn("newest", F.max(F.struct("last.seq", "type")).over(Window.partitionBy("call_id", "slot")))
        .filter((F.col("last.seq") == F.col("newest.seq")) & (F.col("type") == F.col("newest.type")))
        .select("call_id", "slot", "type", "page", "last.seq", "last.payload")
    )


def lifecycle_aggregates() -> list[Column]:
    def last(*kinds: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("type").isin(*kinds), F.col("seq"))), F.lit(-1).cast("bigint"))
    return [last(*STARTS).alias("started"), last("call_ended").alias("stopped"),
            last("playback_ended").alias("completed"), last("app_reset").alias("reset")]


def lifecycle_state() -> Column:
    """IDLE, PLAYING, COMPLETE or STOPPED from the last sequence numbers. A stopped playback also ends, so
    a stop after the start wins over the end."""
    started, reset = F.col("started"), F.col("reset")
    return (
        F.when(reset >= F.greatest("started", "stopped", "completed"), "IDLE")
        .when(F.col("stopped") > started, "STOPPED")
        .when(F.col("completed") > started, "COMPLETE")
        .when(started >= 0, "PLAYING")
        .otherwise("IDLE")
    )


def call_state(events: DataFrame) -> DataFrame:
    """Lifecycle state of each call, by one aggregation with partial maxima."""
    return events.groupBy("call_id").agg(*lifecycle_aggregates()).select("call_id", lifecycle_state().alias("state"))


def drop_stale(results: DataFrame, call_starts: DataFrame, session: str = "session_id") -> DataFrame:
    """Only results of calls that are still the current one of their session."""
    current = call_starts.groupBy(session).agg(F.max(F.struct("started_at", "call_id")).alias("c")).select(
        session, F.col("c.call_id").alias("call_id"))
    return results.join(current, [session, "call_id"], "left_semi")
