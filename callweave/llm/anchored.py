"""Which windows of a corpus occur elsewhere too: the part that exact repeats of bytes and of words share.

An anchor is the gram with the smallest hash of a window; equal windows have equal anchors at equal places. So a window can
only be repeated if its anchor is, and all places of one anchor are compared by themselves, lined up at it:

1. anchors of all texts; those that occur once go (a count, then a semi-join);
2. a context is the stretch of windows that an anchor stands for. Equal contexts become one row with their number before
   anything is compared, so copies cost no more than their rows;
3. anchors with one context need no comparison: its windows are repeated in full. The others' contexts are fetched from the
   texts, dealt out by anchor in groups of about a megabyte, and compared by the index of the operator;
4. an anchor with very many contexts (a passage that many texts share) is not sent to one group. Its windows are split in
   two by where the anchor stands in them; each half has a longer gram in common, which becomes the new anchor. Contexts cut
   down to a half are often equal and become one row again, or alone and go; what is left is compared, or split further. A
   window as its own anchor has one context only, so this ends after seven splits at most;
5. what is found for a context holds for all its places.

Every step is a join or an aggregation on hashes of 64 bits; nothing is proportional to pairs of places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents, in_tables

MANY = 2048  # contexts of one anchor, beyond which it is split
GROUP_BYTES = 1 << 20

OCCURRENCES = "anchor long, ctx long, doc_id long, pos int, lo int, hi int"
CONTEXTS = "anchor long, ctx long, n long, least long, at int, lo int, low int, high int, text binary"
RANGES = "array<struct<first:int,last:int,least:long>>"
MARKS = f"anchor long, ctx long, ranges {RANGES}"


@dataclass(frozen=True)
class Windows:
    """``window`` consecutive bytes or words, and the length of their anchors."""

    words: bool
    window: int
    gram: int


@dataclass
class Units:
    """The items of some texts: their hash values, where texts begin among them, and their places in the bytes."""

    values: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def units(kind: Windows, data: np.ndarray, bounds: np.ndarray) -> Units:
    if kind.words:
        starts, ends, of_text = arrays.words(data, bounds, arrays.NOT_SPACE)
        return Units(arrays.word_hashes(data, starts, ends), of_text, starts, ends)
    at = np.arange(len(data))
    return Units(arrays.BYTE_VALUES[data], bounds, at, at + 1)


def occurrences(docs: DataFrame, kind: Windows) -> DataFrame:
    """Anchors of ``(doc_id, text)``: at ``pos``, standing for the windows from ``lo`` on that end at ``hi`` or before."""
    size, gram = kind.window, kind.gram

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_numpy()
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            u = units(kind, data, bounds)
            n, b = len(u.values), u.bounds
            if n < size:
                continue
            sums = arrays.prefix_hash(u.values)
            hashes = np.zeros(n, np.uint64)
            hashes[:n - gram + 1] = arrays.span_hash(sums, np.arange(n - gram + 1), np.arange(gram, n + 1))
            p = arrays.sampled_anchors(hashes, b, gram, size)
            if not len(p):
                continue
            doc, value = np.searchsorted(b, p, "right") - 1, hashes[p]
            first, last = np.maximum(p - (size - gram), b[doc]), np.minimum(p, b[doc + 1] - size)
            lower = (doc[1:] == doc[:-1]) & (value[:-1] < value[1:])  # windows with a lower neighbour are the neighbour's
            first[1:][lower] = np.maximum(first[1:], p[:-1] + 1)[lower]
            lower = (doc[1:] == doc[:-1]) & (value[1:] < value[:-1])
            last[:-1][lower] = np.minimum(last[:-1], p[1:] - (size - gram) - 1)[lower]
            some = last >= first
            p, doc, value, first, end = p[some], doc[some], value[some], first[some], last[some] + size
            ctx = arrays.span_hash(sums, first, end) ^ arrays.mix((p - first).astype(np.uint64))
            at = b[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(keys[row + doc]),
                 *(pa.array((x - at).astype(np.int32)) for x in (p, first, end))],
                names=["anchor", "ctx", "doc_id", "pos", "lo", "hi"])

    return docs.mapInArrow(by_slices(find), OCCURRENCES)


def _fetch(kind: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the wanted contexts out of the texts."""
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets)
        for row, data, bounds in arrays.text_slices(batch.column(0)):
            n = len(bounds) - 1
            wanted = lists.values.slice(offsets[row], offsets[row + n] - offsets[row])
            if not len(wanted):
                continue
            u = units(kind, data, bounds)
            doc = np.repeat(np.arange(n), np.diff(offsets[row:row + n + 1]))
            lo, hi, pos = (wanted.field(k).to_numpy() for k in ("lo", "hi", "pos"))
            begin, end = u.starts[u.bounds[doc] + lo], u.ends[u.bounds[doc] + hi - 1]
            raw = data.tobytes()
            text = [raw[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(wanted.field(k) for k in ("anchor", "ctx", "n", "least")), pa.array((pos - lo).astype(np.int32)), wanted.field("lo"),
                 pa.array(np.zeros(len(text), np.int32)), pa.array(np.full(len(text), kind.window - kind.gram + 1, np.int32)), pa.array(text, pa.binary())],
                names=["anchor", "ctx", "n", "least", "at", "lo", "low", "high", "text"])
    return by_slices(cut)


@dataclass
class Group:
    """Contexts of some anchors, lined up: column c of a row is the item ``c - before`` places after its anchor.

    ``group`` numbers the anchors, ``inside`` tells which columns a context has, ``starts`` at which of them a window starts.
    """

    group: np.ndarray
    n: np.ndarray
    least: np.ndarray
    lo: np.ndarray
    at: np.ndarray
    before: int
    values: np.ndarray
    inside: np.ndarray
    starts: np.ndarray


def lined_up(kind: Windows, batch: pa.Table | pa.RecordBatch) -> Group:
    anchor = batch.column("anchor").to_numpy()
    text = batch.column("text")
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    _, data, bounds = next(arrays.text_slices(text, limit=1 << 62))
    u = units(kind, data, bounds)
    at, before = batch.column("at").to_numpy().astype(np.int64), kind.window - kind.gram
    size = np.diff(u.bounds)
    width = before + kind.window
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(row)) - np.repeat(u.bounds[:-1] + at - before, size)
    values, inside = np.zeros((len(size), width), np.uint64), np.zeros((len(size), width), bool)
    values[row, column], inside[row, column] = u.values, True
    c, first = np.arange(width), (before - at)[:, None]
    starts = (c >= first) & (c <= first + (size - kind.window)[:, None])
    return Group(np.unique(anchor, return_inverse=True)[1], batch.column("n").to_numpy(), batch.column("least").to_numpy(),
                 batch.column("lo").to_numpy().astype(np.int64), at, before, values, inside, starts)


Index = Callable[[Windows, Group], tuple[np.ndarray, np.ndarray]]
"""For the windows of a group, rows by columns: whether they are repeated, and the least id that has them."""


def marks_of(batch: pa.Table, g: Group, repeated: np.ndarray, least: np.ndarray) -> pa.Table:
    """For each context the runs of repeated windows with equal least ids, by their numbers in the context."""
    repeated = repeated & g.starts
    wide = np.zeros((len(repeated), repeated.shape[1] + 1), bool)
    wide[:, :-1] = repeated
    same = np.zeros_like(wide)
    same[:, 1:-1] = repeated[:, 1:] & repeated[:, :-1] & (least[:, 1:] == least[:, :-1])
    row, first = np.nonzero(wide & ~same)
    ends = np.zeros_like(wide)
    ends[:, 1:] = wide[:, :-1] & ~same[:, 1:]
    last = np.nonzero(ends)[1]
    shift = g.before - g.at[row]
    runs = pa.StructArray.from_arrays([pa.array((first - shift).astype(np.int32)), pa.array((last - 1 - shift).astype(np.int32)), pa.array(least[row, first])],
                                      names=["first", "last", "least"])
    some, counts = np.unique(row, return_counts=True)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), runs)
    take = pa.array(some)
    return pa.table({"anchor": batch.column("anchor").take(take), "ctx": batch.column("ctx").take(take), "ranges": lists})


def _halves(kind: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contexts cut down to half of their windows. The anchor stands ``low`` to ``high - 1`` items after a window's start."""
    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column("text")
        at, lo, low, high = (batch.column(k).to_numpy().astype(np.int64) for k in ("at", "lo", "low", "high"))
        middle = (low + high) // 2
        for row, data, bounds in arrays.text_slices(text):
            u = units(kind, data, bounds)
            n = len(bounds) - 1
            first, size = u.bounds[:-1], np.diff(u.bounds)
            anchor = first + at[row:row + n]
            sums, raw = arrays.prefix_hash(u.values), data.tobytes()
            for a, b in ((low, middle), (middle, high)):
                a, b = a[row:row + n], b[row:row + n]
                begin, last = np.maximum(anchor - b + 1, first), np.minimum(anchor - a, first + size - kind.window)  # windows' starts
                own = np.flatnonzero((last >= begin) & (b > a))
                if not len(own):
                    continue
                start, end, p, a, b = begin[own], last[own] + kind.window, anchor[own], a[own], b[own]
                gram = arrays.span_hash(sums, p - a, p - b + 1 + kind.window) ^ arrays.mix((a * 4096 + b).astype(np.uint64))
                ctx = arrays.span_hash(sums, start, end) ^ arrays.mix((p - start).astype(np.uint64))
                pieces = [raw[x:y] for x, y in zip(u.starts[start].tolist(), u.ends[end - 1].tolist(), strict=True)]
                take = pa.array(row + own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), batch.column("n").take(take), batch.column("least").take(take),
                     pa.array((p - start).astype(np.int32)), pa.array((lo[row + own] + start - first[own]).astype(np.int32)),
                     pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(pieces, pa.binary()),
                     batch.column("anchor").take(take), batch.column("ctx").take(take), pa.array((start - first[own]).astype(np.int32))],
                    names=["anchor", "ctx", "n", "least", "at", "lo", "low", "high", "text", "of_anchor", "of_ctx", "shift"])
    return by_slices(cut)


def _marks(contexts: DataFrame, kind: Windows, index: Index, many: int, group_bytes: int) -> DataFrame:
    """Marks of contexts, one row for each of ``(anchor, ctx)``."""
    kinds = contexts.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("kinds"))
    contexts = in_tables(contexts.join(kinds, contexts["anchor"] == kinds["a"]).drop("a").where("kinds > 1 or n > 1"))
    compared = contexts.where(F.col("kinds") <= many)
    volume = compared.agg(F.sum(F.length("text"))).first()[0] or 0

    def compare(batch: pa.Table) -> pa.Table:
        g = lined_up(kind, batch)
        repeated, least = index(kind, g)
        return marks_of(batch, g, repeated | (g.n > 1)[:, None], least)

    out = in_tables(compared.groupBy(F.pmod("anchor", F.lit(1 + volume // group_bytes)).alias("g")).applyInArrow(compare, MARKS))
    split = contexts.where(F.col("kinds") > many).drop("kinds")
    if split.isEmpty():
        return out
    halves = in_tables(split.mapInArrow(_halves(kind), f"{CONTEXTS}, of_anchor long, of_ctx long, shift int"))
    distinct = halves.groupBy("anchor", "ctx").agg(F.sum("n").alias("n"), F.min("least").alias("least"), *[F.first(c).alias(c) for c in ("at", "lo", "low", "high", "text")])
    found = _marks(distinct, kind, index, many, group_bytes).select(F.col("anchor").alias("a"), F.col("ctx").alias("c"), "ranges")
    back = halves.select("anchor", "ctx", "of_anchor", "of_ctx", "shift").join(found, (F.col("anchor") == F.col("a")) & (F.col("ctx") == F.col("c")))
    moved = F.transform("ranges", lambda r: F.struct(
        (r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last"), r["least"].alias("least")))
    both = back.select(F.col("of_anchor").alias("anchor"), F.col("of_ctx").alias("ctx"), moved.alias("ranges"))
    return out.unionByName(both.groupBy("anchor", "ctx").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def repeated_spans(docs: DataFrame, kind: Windows, index: Index, of_smaller: bool, many: int = MANY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, spans)`` of the windows that also start elsewhere: anywhere, or only in a text with a smaller id.

    ``docs`` is ``(doc_id, text)``. Spans are numbers of bytes or words in the text, overlapping, in any order.
    """
    found = occurrences(docs, kind)
    often = in_tables(found.groupBy("anchor").count().where("count > 1").select(F.col("anchor").alias("a")))
    places = in_tables(found.join(often, found["anchor"] == often["a"], "left_semi"))
    contexts = in_tables(places.groupBy("anchor", "ctx").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("doc_id", "pos", "lo", "hi")]))
    kinds = contexts.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("kinds"))
    contexts = in_tables(contexts.join(kinds, contexts["anchor"] == kinds["a"]).drop("a"))
    alone = contexts.where("kinds = 1").select("anchor", "ctx", F.array(F.struct(
        F.lit(0).alias("first"), (F.col("hi") - F.col("lo") - kind.window).cast("int").alias("last"), "least")).cast(RANGES).alias("ranges"))
    wanted = contexts.where("kinds > 1").groupBy(F.col("doc_id").alias("d")).agg(
        F.collect_list(F.struct("anchor", "ctx", "n", "least", "pos", "lo", "hi")).alias("wanted"))
    texts = in_tables(docs.join(wanted, docs["doc_id"] == wanted["d"]).select("text", "wanted").mapInArrow(_fetch(kind), CONTEXTS))
    marks = in_tables(alone.unionByName(_marks(texts, kind, index, many, group_bytes)))

    m = marks.select(F.col("anchor").alias("a"), F.col("ctx").alias("c"), "ranges")
    hits = places.join(m, (places["anchor"] == m["a"]) & (places["ctx"] == m["c"]))
    if of_smaller:
        hits = hits.withColumn("ranges", F.filter("ranges", lambda r: r["least"] < F.col("doc_id")))
    own = F.transform("ranges", lambda r: F.struct((F.col("lo") + r["first"]).alias("start"), (F.col("lo") + r["last"] + kind.window).alias("end")))
    return in_tables(hits.where(F.size("ranges") > 0).select("doc_id", own.alias("s")).groupBy("doc_id").agg(F.flatten(F.collect_list("s")).alias("spans")))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)`` for every row of ``docs``."""
    s = spans.select(F.col("doc_id").alias("d"), "spans")
    return docs.join(s, docs["doc_id"] == s["d"], "left").select("doc_id", "text", "spans")


def covered(lists: pa.Array, row: int, bounds: np.ndarray) -> np.ndarray:
    """True for every item of the texts from ``row`` on that lies in one of their spans."""
    n = len(bounds) - 1
    lists = lists.slice(row, n)
    sizes = np.diff(np.asarray(lists.offsets)) if not lists.null_count else np.asarray(lists.value_lengths().fill_null(0))
    doc = np.repeat(np.arange(n), sizes)
    inner = lists.flatten()
    start, end = (inner.field(k).to_numpy().astype(np.int64) for k in ("start", "end"))
    return arrays.cover(int(bounds[-1]), bounds[doc] + start, end - start)


__all__ = ["Group", "Windows", "covered", "documents", "repeated_spans", "units", "with_spans"]
