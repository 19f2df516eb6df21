"""Exact top-k by inner product: columnar branch and bound over blocks of integer vectors.

Candidates lie in blocks in vertical layout (one row per dimension). A query adds up products one block of dimensions after
the other. What the remaining dimensions can still add is at most the product of the remaining lengths of query and
candidate; candidates whose sum plus that bound stays below the k-th best score found so far leave the columns, and the rest
is compacted. Tasks read blocks of candidates and a few blocks of queries, each of fixed size, and compare each with each: no block is copied or
sent to the driver. Each pair returns k rows per query at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.tables import by_slices, in_tables

DIMENSIONS = 16  # per step
CANDIDATES = 8192  # per block
QUERIES = 1024  # per block
ASKED = 16  # blocks of queries that a task holds
SAFE = float(1 << 62)  # sums that could pass this are added up as Python integers

_PACKED = "block long, ids binary, width int, data binary"
_SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """``(vec_id, v)`` with floor(factor * x) of each component x, taken as double.

    Rows whose id or vector is null, or that hold a null, NaN or infinite component, are left out. A scaled component that
    64 bits cannot hold is an error.
    """
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(f"`{vector_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~bad).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.when(F.abs(x * F.lit(float(factor))) < F.lit(float(1 << 63)), F.floor(x * F.lit(float(factor)))).otherwise(
            F.raise_error(F.lit("a scaled component passes 64 bits")).cast("long"))).alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of rows in vertical layout. Rows of different widths are filled up with zeros, which add nothing."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values = part.column(1)
                sizes = np.diff(np.asarray(values.offsets)).astype(np.int64)
                flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                width = max(1, int(sizes.max()))
                wide = np.zeros((len(sizes), width), "<i8")
                row = np.repeat(np.arange(len(sizes)), sizes)
                wide[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                     pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(wide.T).tobytes()], pa.binary())],
                    names=["block", "ids", "width", "data"])
                block += 1
    return rows.mapInArrow(pack, _PACKED)


def _unpack(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids, data = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<i8").reshape(row["width"], -1)
    return ids, np.vstack([data, np.zeros((width - len(data), len(ids)), np.int64)]) if len(data) < width else data


def _rest(columns: np.ndarray, step: int) -> np.ndarray:
    """For each step the length of what remains after it, rounded up."""
    squares = (columns.astype(np.float64) ** 2)[::-1].cumsum(0)[::-1]
    ends = np.arange(step, len(columns) + step, step)
    return np.vstack([np.sqrt(squares[e]) * (1 + 1e-9) if e < len(columns) else np.zeros(columns.shape[1]) for e in ends])


def search_block(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int,
                 step: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """``(places, scores)`` of the k best columns for one query, ties to the smaller id."""
    alive = np.flatnonzero(~skip)
    if len(alive) > 4 * k:  # exact scores of a few columns give the first k-th best
        probe = alive[:4 * k]
        known = np.partition(query @ columns[:, probe], -k)[-k]
    else:
        known = None
    left = _rest(query[:, None], step)[:, 0]
    sums = np.zeros(len(alive), np.int64)
    for i, at in enumerate(range(0, len(query), step)):
        part = query[at:at + step]
        sums += part @ columns[at:at + step, alive]
        if len(alive) > k:
            slack = left[i] * rest[i][alive]
            low = np.partition(sums - slack, -k)[-k]  # k candidates reach this whatever comes
            known = low if known is None else max(known, low)
            stay = sums + slack >= known - 1e-6 * abs(known)
            alive, sums = alive[stay], sums[stay]
    order = np.lexsort((ids[alive], -sums))[:k]
    return alive[order], sums[order]


def search_exact(query: np.ndarray, columns: np.ndarray, skip: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`search_block`, for sums that 64 bits may not hold on the way. A score that they cannot hold is an error."""
    alive = np.flatnonzero(~skip)
    own = [int(x) for x in query]
    sums = np.zeros(len(alive), object)
    for x, row in zip(own, columns, strict=True):
        if x:
            sums += row[alive].astype(object) * x
    order = sorted(range(len(alive)), key=lambda i: (-sums[i], ids[alive[i]]))[:k]
    return alive[order], np.array([sums[i] for i in order], np.int64)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, candidates_per_block: int = CANDIDATES, queries_per_block: int = QUERIES) -> DataFrame:
    """The ``k`` candidates with the highest inner product for each row of ``(vec_id, v)`` that meets ``queries``.

    A row is no candidate for its own id. Ties go to the smaller ``vec_id``; a query with fewer candidates returns all.
    Rows that repeat an id are candidates and queries of their own, and appear once each.
    """
    columns = in_tables(_packed(vectors, candidates_per_block))
    asked = in_tables(_packed(vectors.where(queries), queries_per_block))
    parts = max(1, math.ceil(asked.count() / ASKED))
    right = asked.repartition(parts).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "width", "data")])
    met = columns.select("ids", "width", "data").join(right.hint("shuffle_replicate_nl"))

    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            width = max(row["width"], row["q_width"])
            ids, data = _unpack(row, width)
            q_ids, q_data = _unpack({"ids": row["q_ids"], "width": row["q_width"], "data": row["q_data"]}, width)
            rest = _rest(data, DIMENSIONS)
            largest = np.abs(data.astype(np.float64)).max(initial=0) * width
            out: list[list[np.ndarray]] = [[], [], []]
            for j, own in enumerate(q_ids):
                query = np.ascontiguousarray(q_data[:, j])
                if np.abs(query.astype(np.float64)).max(initial=0) * largest < SAFE:
                    at, score = search_block(query, data, rest, ids == own, ids, k)
                else:
                    at, score = search_exact(query, data, ids == own, ids, k)
                for held, found in zip(out, (np.full(len(at), own), ids[at], score), strict=True):
                    held.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], schema=_SCORES)

    found = met.mapInArrow(by_slices(search), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
