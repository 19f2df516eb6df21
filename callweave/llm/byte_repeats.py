"""Removal of long byte strings that occur elsewhere, by a positional sort of the repetitive part of a corpus.

Contexts that share an anchor are lined up (see ``anchored``). Column by column from the right, the Burrows-Wheeler order of
all suffixes that start in the column is the order of the column before, stably sorted by the new byte. The order is kept as
plain arrays with an entry per context, not as runs. Where a suffix keeps its neighbour, what the two have in common grows by
one; else the common length is found anew by comparing bytes with the new neighbour. The larger of the common lengths with
both neighbours is the matching statistic of the suffix; where it reaches the window, the window occurs elsewhere and is
marked. The statistics are streamed: no column is kept after the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm import arrays
from callweave.llm.anchored import GROUP_BYTES, MANY, Group, Windows, covered, repeated_spans, with_spans
from callweave.llm.tables import by_slices, documents

WINDOW = 200
GRAM = 100

REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def matching_statistics(g: Group) -> Iterator[tuple[int, np.ndarray]]:
    """``(column, statistic of each row)`` from the last column to the first.

    The statistic is the length of the longest string from the column on that another context of the same anchor has at the
    same place.
    """
    rows, width = g.values.shape
    symbol = np.where(g.inside, (np.unique(g.values, return_inverse=True)[1].reshape(g.values.shape) + 1), 0).astype(np.int64)
    end = np.where(g.inside.any(1), width - g.inside[:, ::-1].argmax(1), 0)
    many = int(symbol.max(initial=0)) + 1
    order = np.argsort(g.group, kind="stable")
    above = np.full(rows, -1)  # the neighbour before each row in the order
    common = np.zeros(rows, np.int64)  # with that neighbour
    for column in range(width - 1, -1, -1):
        own = symbol[:, column]
        order = order[np.argsort(g.group[order] * many + own[order], kind="stable")]
        before, after = order[:-1], order[1:]
        linked = (g.group[before] == g.group[after]) & (own[before] == own[after]) & (own[after] > 0)
        kept = linked & (above[after] == before)  # inside a run: the neighbour stays, the common part grows
        length = np.where(kept, common[after] + 1, 0)
        anew = np.flatnonzero(linked & ~kept)  # a run ended here
        for at in range(0, len(anew), 4096):
            some = anew[at:at + 4096]
            a, b = before[some], after[some]
            same = symbol[a, column:] == symbol[b, column:]
            same &= (np.arange(column, width) < np.minimum(end[a], end[b])[:, None])
            length[some] = np.where(same.all(1), width - column, (~same).argmax(1))
        above = np.full(rows, -1)
        above[after] = before
        common = np.zeros(rows, np.int64)
        common[after] = length
        statistic = common.copy()
        statistic[before] = np.maximum(statistic[before], length)
        yield column, statistic


def index(kind: Windows, g: Group) -> tuple[np.ndarray, np.ndarray]:
    repeated = np.zeros(g.inside.shape, bool)
    for column, statistic in matching_statistics(g):
        repeated[:, column] = statistic >= kind.window
    return repeated, np.zeros(g.inside.shape, np.int64)


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Spans of bytes of each text that are covered by strings of ``window`` bytes which also start anywhere else."""
    return repeated_spans(documents(docs), Windows(False, window, gram), index, False, many, group_bytes)


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """How much of each text goes and the checksum of what stays. A null text is empty; rows with equal ids are copies."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            gone = covered(batch.column(2), row, bounds)
            starts, _ = arrays.runs(gone, bounds)
            total = np.concatenate([[0], np.cumsum(gone)])
            sha = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(sha)), pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds])),
                 pa.array(np.diff(np.searchsorted(starts, bounds))), pa.array(sha)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(documents(docs), spans).mapInArrow(by_slices(work), REMOVED)
