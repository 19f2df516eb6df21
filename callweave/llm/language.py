"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier on hashed byte n-grams is trained to tell the
languages with a 1 from those with a 0. A text's language is the one whose codeword has the least logistic loss against the
classifiers' margins; if the next one is almost as near, the text is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents

BUCKETS = 4096
SAMPLE_PER_LANGUAGE = 400  # labelled rows that a model is fitted on, about so many per language and never twice as many
SAMPLE = 32768  # rows about, over all languages: the more languages, the fewer rows of each, but one at least
BLOCK = 4096  # rows that a model is fitted on at once
ROUNDS = 100
LEAST_GAP = 0.05  # of the best score before the next; texts below it are ambiguous
UNKNOWN = "und"

PREDICTED = "doc_id long, lang_pred string, score double, ambiguous boolean"


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row per text: square roots of the shares of hashed 2-grams and 3-grams of bytes.

    Letters are lower-cased (ASCII and Latin-1); other ASCII characters count as spaces. Grams do not cross texts.
    """
    n, size = len(bounds) - 1, len(data)
    low = arrays.LOWER[data]
    low[~arrays.ALPHANUMERIC[low] | ((low >= 48) & (low <= 57))] = 32
    if size > 1:
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E)
        low[1:][upper] += 0x20
    codes = low.astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * BUCKETS)
    for width, salt in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
        if size < width:
            continue
        value = sum(codes[i:size - width + 1 + i] << np.uint32(8 * i) for i in range(width))
        slot = (value * np.uint32(salt)) >> np.uint32(32 - 12)
        inside = text[:size - width + 1] == text[width - 1:]
        out += np.bincount((text[:size - width + 1] * BUCKETS + slot)[inside], minlength=n * BUCKETS)
    out = out.reshape(n, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 per language: all splits of few languages, else the farthest apart of some random codes."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        bits = np.arange(1, 2 ** (n - 1))
        code = np.vstack([np.zeros(len(bits), np.int64), *[(bits >> i) & 1 for i in range(n - 1)]])
        return (2 * code - 1).astype(np.float32)
    rng, best, apart = np.random.default_rng(0), None, -1
    for _ in range(max(2, min(50, 10**8 // n**2))):
        code = rng.choice([-1.0, 1.0], (n, 16 + 4 * int(np.ceil(np.log2(n)))))
        nearest = -np.inf
        for at in range(0, n, 1024):
            products = code[at:at + 1024] @ code.T
            products[np.arange(len(products)), np.arange(at, at + len(products))] = -np.inf
            nearest = max(nearest, products.max())
        distance = (code.shape[1] - nearest) / 2
        if distance > apart and (np.abs(code.sum(0)) < n).all():
            best, apart = code, distance
    return best.astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """A row per text, a column per language, adding up to 1: the nearer its codeword, the more.

        The loss of a 1 is that of a -1 less the margin, so the losses of all codewords are one product of matrices.
        """
        margins = (x @ self.weights + self.bias).astype(np.float64)
        loss = np.logaddexp(0, margins).sum(1, keepdims=True) - margins @ ((self.code + 1) / 2).astype(np.float64).T
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return share / share.sum(1, keepdims=True)


def fit(x: np.ndarray, labels: list[str], rounds: int = ROUNDS, rate: float = 8.0, decay: float = 1e-4) -> Model:
    """One logistic classifier per bit, all at once, by gradient descent with momentum. Every language weighs the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((x.shape[1] if len(x) else BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32))
    number = {v: i for i, v in enumerate(languages)}
    index = np.array([number[v] for v in labels])
    weight = (1 / np.bincount(index)[index] / len(languages)).astype(np.float32)[:, None]
    target = code[index]
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        slope_w, slope_b = decay * w, np.zeros_like(b)
        for at in range(0, len(x), BLOCK):
            part, goal = x[at:at + BLOCK].astype(np.float32), target[at:at + BLOCK]
            pull = weight[at:at + BLOCK] * -goal / (1 + np.exp(np.clip(goal * (part @ w + b), -30, 30)))
            slope_w, slope_b = part.T @ pull + slope_w, slope_b + pull.sum(0)
        step_w, step_b = 0.9 * step_w - rate * slope_w, 0.9 * step_b - rate * slope_b
        w, b = w + step_w, b + step_b
    return Model(languages, code, w, b)


def _with_letters(docs: DataFrame, *more: str) -> DataFrame:
    return documents(docs, "doc_id", "text", *more).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of all labels from labelled rows of ``(doc_id, text, lang)``. The caller leaves out rows that must not be learned from.

    The sample follows a hash of the id, so it is the same in every run, and holds whole texts. The row of each label with the
    smallest hash is always drawn.
    """
    known = _with_letters(docs, "lang").where("letters and lang is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    counts = known.groupBy("lang").agg(F.count("*").alias("count"), F.min(place).alias("least")).collect()
    if not counts:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    per_language = max(1, min(per_language, SAMPLE // len(counts)))
    limits = [(r["lang"], max(min(1.0, per_language / r["count"]) * (1 << 20), r["least"] + 1.0)) for r in counts]
    below = known.sparkSession.createDataFrame(limits, "own string, below double")
    drawn = known.join(F.broadcast(below), (F.col("lang") == F.col("own")) & (place < F.col("below"))).select("doc_id", "text", "lang")

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, data, bounds in arrays.text_slices(batch.column(1), rows=256):
            x = features(data, bounds).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(row, len(x)), pa.array([v.tobytes() for v in x], pa.binary()),
                                              batch.column(0).slice(row, len(x))], names=["lang", "x", "doc_id"])

    sample = drawn.mapInArrow(by_slices(rows), "lang string, x binary, doc_id long").collect()
    taken: dict[str, int] = {}
    chosen = []
    for r in sorted(sample, key=lambda r: (r["doc_id"], r["x"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] < 2 * per_language:
            chosen.append(r)
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in chosen]), [r["lang"] for r in chosen])


def _told(m: Model, data: np.ndarray, bounds: np.ndarray, letters: np.ndarray, least_gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(name, score, ambiguous)`` of some texts."""
    n = len(bounds) - 1
    name, score, ambiguous = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
    own = np.flatnonzero(letters)
    if m.languages and len(own):
        s = m.scores(features(data, bounds)[own])
        best = s.argmax(1)
        name[own], score[own] = np.array(m.languages, object)[best], np.minimum(s.max(1), 1)
        if len(m.languages) > 1:
            two = np.sort(s, 1)[:, -2:]
            ambiguous[own] = two[:, 1] - two[:, 0] < least_gap
    return name, score, ambiguous


def predict(docs: DataFrame, model: Model, least_gap: float = LEAST_GAP) -> DataFrame:
    """Language, score and ambiguity of every text. Null texts and those without a letter are ``und`` with score 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        letters = batch.column(2).to_numpy(zero_copy_only=False)
        for row, data, bounds in arrays.text_slices(batch.column(1), rows=256):
            n = len(bounds) - 1
            name, score, ambiguous = _told(held.value, data, bounds, letters[row:row + n], least_gap)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(name, pa.string()), pa.array(score), pa.array(ambiguous)],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return _with_letters(docs).mapInArrow(by_slices(rows), PREDICTED)


def told(docs: DataFrame, model: Model, least_gap: float = LEAST_GAP) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, with an id and a text whose language can be told. Texts are not shuffled."""
    held, letters = docs.sparkSession.sparkContext.broadcast(model), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flags = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        keep = np.zeros(batch.num_rows, bool)
        for row, data, bounds in arrays.text_slices(batch.column("text"), rows=256):
            name, _, ambiguous = _told(held.value, data, bounds, flags[row:row + len(bounds) - 1], least_gap)
            keep[row:row + len(name)] = (name != UNKNOWN) & ~ambiguous
        yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return docs.where("doc_id is not null").withColumn("__letters", letters).mapInArrow(by_slices(rows), docs.schema)


def held_out() -> Column:
    """Rows that no model learns from: a quarter of all ids."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
