"""Removal of word passages that an earlier document has, by sampled anchors of exact repeats.

Contexts that share a sampled gram are lined up (see ``anchored``). Windows at the same distance from an anchor whose hashes
over the full length are equal are repeats, and the smallest document that has one is kept with it. The blocks of the
documents' own grids are a first look only: each context holds its own, so they exclude no window. Neighbouring windows join
to maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm import arrays
from callweave.llm.anchored import GROUP_BYTES, MANY, Group, Windows, covered, repeated_spans, units, with_spans
from callweave.llm.tables import by_slices, documents

WINDOW = 50
GRAM = 16

REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _rolling(g: Group, size: int) -> np.ndarray:
    """Hashes of ``size`` columns from each column on, different for each anchor and column; 0 where a context ends before."""
    rows, width = g.values.shape
    sums = arrays.prefix_hash(g.values.ravel())
    out = np.zeros((rows, width), np.uint64)
    row, column = np.nonzero(g.inside[:, :width - size + 1] & g.inside[:, size - 1:])
    flat = row * width + column
    place = arrays.mix((g.group[row] * width + column + 1).astype(np.uint64))
    out[row, column] = np.maximum(arrays.span_hash(sums, flat, flat + size) ^ place, np.uint64(1))
    return out


def index(kind: Windows, g: Group) -> tuple[np.ndarray, np.ndarray]:
    block = kind.window // 2
    rolling = _rolling(g, block)
    position = g.lo[:, None] + np.arange(rolling.shape[1]) - (g.before - g.at)[:, None]  # word number in the document
    reference = np.unique(rolling[(rolling > 0) & (position % block == 0)])
    hit = (rolling > 0) & np.isin(rolling, reference)
    reach = np.zeros(hit.shape, bool)  # windows that hold a hit
    for back in range(kind.window - block + 1):
        reach[:, :hit.shape[1] - back] |= hit[:, back:]
    full = _rolling(g, kind.window)
    row, column = np.nonzero(reach & g.starts)
    keys, which, counts = np.unique(full[row, column], return_inverse=True, return_counts=True)
    smallest = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, g.least[row])
    repeated, least = np.zeros(hit.shape, bool), np.repeat(g.least[:, None], hit.shape[1], 1)
    repeated[row, column] = counts[which] > 1
    least[row, column] = smallest[which]
    return repeated, least


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, many: int = MANY, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Spans of words of each text that are covered by windows which also start in a text with a smaller id."""
    return repeated_spans(documents(docs), Windows(True, window, gram), index, True, many, group_bytes)


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """How many words of each text go and the checksum of what stays. A null text has no words."""
    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            u = units(Windows(True, 0, 0), data, bounds)
            gone = covered(batch.column(2), row, u.bounds)
            total = np.concatenate([[0], np.cumsum(gone)])
            raw = data.tobytes()
            sha = []
            for a, b in zip(u.bounds[:-1].tolist(), u.bounds[1:].tolist(), strict=True):
                stay = a + np.flatnonzero(~gone[a:b])
                kept = [raw[s:e] for s, e in zip(u.starts[stay].tolist(), u.ends[stay].tolist(), strict=True)]
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, len(sha)), pa.array(np.diff(u.bounds)), pa.array(np.diff(total[u.bounds])), pa.array(sha)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_spans(documents(docs), spans).mapInArrow(by_slices(work), REMOVED)
