"""Token ids as files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A block holds the ids of consecutive documents. Its ids are ranked by how often they occur in the block (ties: smaller id
first), so that the commonest 256 take one byte, the next 65,280 two, and so on. A control byte holds the lengths of four
codes, two bits each; the codes' bytes lie apart from the control bytes. Decoding looks the lengths of four codes up in a
table of 256 rows and adds the bytes at those places up, all with numpy. Each block carries its own ranking, so a block is
read without any other, and one pass over the texts is enough.

Files are parquet with one row per block: ``part`` and ``first`` (ids before the block in its part), document ids, numbers of
ids, ranking, control bytes, code bytes. Parts are ranges of ``doc_id`` in ascending order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm import arrays, tokens
from callweave.llm.tables import documents

BLOCK_IDS = 1 << 20

BLOCKS = "part int, first long, doc_ids array<long>, sizes array<long>, ranking binary, control binary, codes binary"
_BLOCKS = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                     ("ranking", pa.binary()), ("control", pa.binary()), ("codes", pa.binary())])
DOCS = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"

# How many bytes each of the four codes of a control byte takes.
SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.int64) + 1


def encode(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``(ranking, control bytes, code bytes)`` of a block of ids."""
    found, which, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((found, -counts))
    rank = np.empty(len(found), np.uint32)
    rank[order] = np.arange(len(found), dtype=np.uint32)
    codes = rank[which].astype("<u4")
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[:len(codes)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = codes.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return found[order].astype("<u4").tobytes(), control.tobytes(), used.tobytes()


def decode(ranking: bytes, control: bytes, codes: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes) - sizes
    data = np.frombuffer(codes + b"\0\0\0", np.uint8)
    value = np.zeros(n, np.uint32)
    for k in range(4):
        more = sizes > k
        if not more.any():
            break
        value[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranking, "<u4")[value]


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts of ``(doc_id, text)``, each with the end id after it, in ascending order of ``doc_id``.

    A null or empty text is the end id alone. Repeated ids stay, each as a document of its own.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, encoder = TaskContext.get().partitionId(), 0, tokens.encoder(vocabulary)
        ids: list[np.ndarray] = []
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal first
            everything = np.concatenate(ids)
            row = [part, first, np.concatenate(names), np.concatenate(sizes), *encode(everything)]
            first += len(everything)
            for held in (ids, names, sizes):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, bounds in arrays.text_slices(batch.column(1)):
                found, ends = tokens.with_end(*encoder.encode(data, bounds))
                ids.append(found)
                names.append(keys[row:row + len(ends) - 1])
                sizes.append(np.diff(ends))
                if sum(map(len, ids)) >= block_ids:
                    yield block()
        if ids:
            yield block()

    ordered = documents(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(path)


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document of written files: where it starts among all ids, how many it has, and their checksum."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.asarray(row["sizes"], np.int64)
                ids = decode(row["ranking"], row["control"], row["codes"], int(sizes.sum()))
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    total = F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))
    parts = files.groupBy("part").agg(total.alias("n")).select(  # one row per part
        F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.mapInArrow(read, DOCS)
    return rows.join(parts, rows["part"] == parts["p"]).select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, vocabulary: str | None = None) -> DataFrame:
    """Write, then read back. Nothing of the result comes from memory of the writing."""
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession.read.schema(BLOCKS).parquet(path))


__all__ = ["decode", "encode", "read_tokens", "token_files", "write_tokens"]
