"""Benchmark decontamination: passages of training texts that hold a test item's question and answer.

Test items are an inverted index with BM25 weights, each item's divided by what the item scores against itself, so that one
threshold serves all. Every passage of every text is a query; passages overlap by half, so that an item that is no longer
than half a passage lies wholly in one. Block-max WAND answers them: lists know their greatest weight in each block of items.
First the sums of block maxima of all passages of a slice are formed at once; where no block can reach the threshold nothing
else is done. For the rest the pivot is sought list by list, blocks whose maxima cannot reach the threshold are skipped, and all
items at or above it are returned. A find counts when enough of the question's word triples and of the answer's stand in the passage.

The index is sent to the executors in shards of a bounded number of items; there is one pass over the texts for each
``ITEMS_AT_ONCE`` items, so nothing that is sent grows with the number of items.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents, in_tables

PASSAGE = 128  # words; twice the longest item of a shard where that is more
SCORE = 0.5  # of an item's score against itself
OVERLAP = 0.5  # of the word triples of question and of answer
K1, B = 1.2, 0.75
BLOCK = 2  # items; the smaller, the tighter the bounds and the wider the table of block maxima
SHARD = 512  # items
ITEMS_AT_ONCE = 4096
GRAM = 3

FOUND = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("score", pa.float64()),
                    ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def hashed_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and where texts begin among them."""
    low = arrays.LOWER[data]
    starts, ends, of_text = arrays.words(low, bounds, arrays.ALPHANUMERIC)
    return arrays.word_hashes(low, starts, ends), of_text


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]))[0]


def grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of ``size`` consecutive words, or of all where there are fewer."""
    size = min(size, len(words))
    if not size:
        return np.empty(0, np.uint64)
    at = np.arange(len(words) - size + 1)
    return np.unique(arrays.span_hash(arrays.prefix_hash(words), at, at + size))


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words of an item's question and of its answer: the last sentence, or the second half of a single one."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if len(_hashes(p))]
    if len(parts) > 1:
        return _hashes(" ".join(parts[:-1])), _hashes(parts[-1])
    words = _hashes(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


@dataclass
class Shard:
    """An inverted index of some items. Postings of term t are at ``starts[t]:starts[t + 1]``, by item."""

    ids: np.ndarray
    longest: int
    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    block_max: np.ndarray
    list_max: np.ndarray
    parts: list[tuple[tuple[np.ndarray, int], tuple[np.ndarray, int]]]


def build(rows: list[tuple[int, str]], idf_of: dict[int, float], mean: float) -> Shard:
    words = [_hashes(t) for _, t in rows]
    term, item, weight = [], [], []
    for k, w in enumerate(words):
        t, tf = np.unique(w, return_counts=True)
        x = np.array([idf_of[int(v)] for v in t]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        term.append(t)
        item.append(np.full(len(t), k))
        weight.append(x / x.sum())
    terms, which = np.unique(np.concatenate(term), return_inverse=True)
    items, weights = np.concatenate(item), np.concatenate(weight)
    order = np.lexsort((items, which))
    which, items, weights = which[order], items[order], weights[order]
    block_max = np.zeros((len(terms), -(-len(rows) // BLOCK)), np.float32)
    np.maximum.at(block_max, (which, items // BLOCK), weights.astype(np.float32) * np.float32(1 + 1e-6))
    parts = []
    for _, t in rows:
        question, answer = question_and_answer(t)
        parts.append(((grams(question), min(GRAM, len(question))), (grams(answer), min(GRAM, len(answer)))))
    return Shard(np.array([i for i, _ in rows], np.int64), max(map(len, words)), terms, np.searchsorted(which, np.arange(len(terms) + 1)),
                 items, weights, block_max, block_max.max(1), parts)


def wand(shard: Shard, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """``(item, score)`` of all items that score at least ``threshold`` for a passage with these terms."""
    low = threshold - 1e-6
    lists = []
    for t in terms:
        a, b = int(shard.starts[t]), int(shard.starts[t + 1])
        lists.append([shard.items[a:b].tolist(), shard.weights[a:b].tolist(), 0, float(shard.list_max[t]), shard.block_max[t]])
    out, end = [], len(shard.ids)

    def move(entry: list, item: int) -> None:
        entry[2] = bisect_left(entry[0], item, entry[2])

    def current(entry: list) -> int:
        return entry[0][entry[2]] if entry[2] < len(entry[0]) else end

    while True:
        lists = [e for e in lists if e[2] < len(e[0])]
        lists.sort(key=current)
        bound, pivot = 0.0, None
        for k, e in enumerate(lists):
            bound += e[3]
            if bound >= low:
                pivot = current(e)
                upto = k
                break
        if pivot is None:
            return out
        while upto + 1 < len(lists) and current(lists[upto + 1]) == pivot:
            upto += 1
        block = pivot // BLOCK
        if sum(float(e[4][block]) for e in lists[:upto + 1]) < low:
            # no item of this block before the next list's item can reach the threshold
            following = current(lists[upto + 1]) if upto + 1 < len(lists) else end
            target = max(pivot + 1, min((block + 1) * BLOCK, following))
            for e in lists[:upto + 1]:
                move(e, target)
        elif current(lists[0]) == pivot:
            score = 0.0
            for e in lists[:upto + 1]:
                score += e[1][e[2]]
                e[2] += 1
            if score >= low:
                out.append((pivot, score))
        else:
            for e in lists[:upto + 1]:
                move(e, pivot)


def passages(of_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of passages of ``size`` words, each starting half a passage after the one before."""
    n = np.diff(of_text)
    step = size // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - size) // step) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = of_text[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    return text, start, np.minimum(start + size, of_text[text + 1])


def matches(shard: Shard, words: np.ndarray, of_text: np.ndarray, threshold: float, overlap: float) -> Iterator[tuple[int, int, int, float, float, float]]:
    """``(text, item, first word, score, question overlap, answer overlap)`` of all verified finds."""
    place = np.minimum(np.searchsorted(shard.terms, words), len(shard.terms) - 1)
    known = shard.terms[place] == words
    text, start, end = passages(of_text, max(PASSAGE, 2 * shard.longest))
    number = np.cumsum(np.concatenate([[0], known]))  # of known words before each word
    sizes = number[end] - number[start]
    passage = np.repeat(np.arange(len(start)), sizes)
    at = np.arange(len(passage)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + number[start][passage]
    terms = place[known][at]
    pairs = np.unique(passage * len(shard.terms) + terms)
    passage, terms = pairs // len(shard.terms), pairs % len(shard.terms)
    if not len(pairs):
        return
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    for a in range(0, len(first), 512):  # sums of block maxima, some hundred passages at a time
        own = first[a:a + 512]
        stop = first[a + 512] if a + 512 < len(first) else len(passage)
        bound = np.add.reduceat(shard.block_max[terms[own[0]:stop]], own - own[0], axis=0)
        for k in np.flatnonzero(bound.max(1) >= threshold - 1e-4).tolist():
            p = int(passage[own[k]])
            last = own[k + 1] if k + 1 < len(own) else stop
            found = wand(shard, terms[own[k]:last].tolist(), threshold)
            here = words[start[p]:end[p]]
            for item, score in found:
                shares = [float(np.isin(g, grams_all(here, size)).mean()) if len(g) else 1.0 for g, size in shard.parts[item]]
                if min(shares) >= overlap:
                    yield int(text[p]), int(shard.ids[item]), int(start[p] - of_text[text[p]]), min(score, 1.0), shares[0], shares[1]


def grams_all(words: np.ndarray, size: int) -> np.ndarray:
    """All hashes of ``size`` consecutive words; none if there are fewer."""
    if len(words) < size or not size:
        return np.empty(0, np.uint64)
    at = np.arange(len(words) - size + 1)
    return arrays.span_hash(arrays.prefix_hash(words), at, at + size)


def indexes(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE, shard_items: int = SHARD) -> Iterator[Broadcast]:
    """Shards of some thousand items each, on the executors.

    ``benchmark`` is ``(item_id, text)``. Items without words match nothing, repeated ones count once.
    """
    spark = benchmark.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    shares = max(1, -(-wanted.count() // at_once))
    items = in_tables(wanted.withColumn("share", F.pmod(F.xxhash64("item_id", "text"), F.lit(shares))))

    def terms_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in arrays.text_slices(batch.column(1)):
            hashes, of_text = hashed_words(data, bounds)
            item = np.repeat(np.arange(len(bounds) - 1), np.diff(of_text))
            order = np.lexsort((hashes, item))
            hashes, item = hashes[order], item[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1])
            first = np.zeros(len(hashes), bool)
            first[1:] = item[1:] == item[:-1]
            size = np.diff(of_text)[item]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), batch.column(2).take(pa.array(item[new])),
                                              pa.array(np.where(first, 0, size)[new]), pa.array((~first)[new].astype(np.int64))],
                                             names=["term", "share", "words", "items"])

    terms = in_tables(items.select("item_id", "text", "share").mapInArrow(by_slices(terms_of), "term long, share long, words long, items long"))
    total, words = terms.agg(F.sum("items"), F.sum("words")).first()
    often = in_tables(terms.groupBy(F.col("term").alias("t")).agg(F.count("*").alias("n")))
    for share in range(shares if total else 0):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("share") == share).orderBy("item_id", "text").collect()]  # about at_once
        own = terms.where(F.col("share") == share).select("term").distinct()
        idf = {r["t"] % 2**64: float(np.log(1 + (total - r["n"] + 0.5) / (r["n"] + 0.5)))
               for r in often.join(own, often["t"] == own["term"], "left_semi").collect()}
        rows = [r for r in rows if len(_hashes(r[1]))]
        yield spark.sparkContext.broadcast([build(rows[a:a + shard_items], idf, words / total) for a in range(0, len(rows), shard_items)])


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, overlap: float = OVERLAP, at_once: int = ITEMS_AT_ONCE,
                 shard_items: int = SHARD) -> DataFrame:
    """Texts and the test items that they hold: the best passage of each pair. Null texts hold nothing."""
    texts = documents(docs)
    out = docs.sparkSession.createDataFrame([], FOUND)
    for shards in indexes(benchmark, at_once, shard_items):
        def work(batch: pa.RecordBatch, shards=shards) -> Iterator[pa.RecordBatch]:
            keys = batch.column(0).to_numpy()
            for row, data, bounds in arrays.text_slices(batch.column(1)):
                hashes, of_text = hashed_words(data, bounds)
                if not len(hashes):
                    continue
                found = [(int(keys[row + d]), *rest) for s in shards.value for d, *rest in matches(s, hashes, of_text, threshold, overlap)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), _FOUND, strict=True)], schema=_FOUND)

        out = out.unionByName(texts.mapInArrow(by_slices(work), FOUND))
    best = F.struct(F.col("score"), (-F.col("first_word")).alias("earlier"), "question_overlap", "answer_overlap")
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("b"), F.count("*").alias("n_passages")).select(
        "doc_id", "item_id", "n_passages", (-F.col("b.earlier")).alias("first_word"), "b.score", "b.question_overlap", "b.answer_overlap")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose texts hold no test item. Texts are not shuffled."""
    for shards in indexes(benchmark):
        def work(batch: pa.RecordBatch, shards=shards) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, bool)
            for row, data, bounds in arrays.text_slices(batch.column("text")):
                hashes, of_text = hashed_words(data, bounds)
                for s in shards.value if len(hashes) else ():
                    for d, *_ in matches(s, hashes, of_text, threshold, overlap):
                        keep[row + d] = False
            yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(by_slices(work), docs.schema)
    return docs
