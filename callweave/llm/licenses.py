"""License notices in texts: exact phrases, and short notices with a bounded number of edits.

A text is lower-cased and reduced to its words joined by single spaces. A notice of n characters may have e = n // 10 edits.
Cut into e + 1 pieces, at least one piece is unharmed, so an exact search for all pieces at once finds every place where the
notice can be. There the regex library looks for the notice with at most e insertions, deletions and substitutions.
Edits count in bytes of UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm import arrays
from callweave.llm.tables import by_slices, documents

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Short notices, as words in lower case, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution 4 0 international license": "cc-by",
}

FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, " \
        "spans array<struct<label:string,first_word:long,last_word:long,edits:int,score:double>>"
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                                  ("edits", pa.int32()), ("score", pa.float64())])))])


def edits(notice: str) -> int:
    return len(notice) // 10


@dataclass
class Search:
    """Pieces of all notices in one automaton, and each notice as a pattern."""

    automaton: object
    patterns: list[tuple[object, str, str, int]]


@lru_cache(maxsize=4)
def search(notices: tuple[tuple[str, str], ...]) -> Search:
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for k, (notice, label) in enumerate(notices):
        e = edits(notice)
        cuts = [i * len(notice) // (e + 1) for i in range(e + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            seeds.setdefault(notice[a:b], []).append((k, a))
        patterns.append((regex.compile(f"(?e)(?:{regex.escape(notice)}){{e<={e}}}"), notice, label, e))
    automaton = ahocorasick.Automaton()
    for seed, uses in seeds.items():
        automaton.add_word(seed, (len(seed), uses))
    automaton.make_automaton()
    return Search(automaton, patterns)


def joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
    """Words joined by spaces, texts ended by line ends, one character per byte; and where each word starts."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    word = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at[word] + inside] = low[starts[word] + inside]
    last = bounds[1:][np.diff(bounds) > 0] - 1
    out[at[last] + sizes[last]] = 10
    return out.tobytes().decode("latin-1"), at


def notices_in(text: str, limits: np.ndarray, wanted: Search) -> list[tuple[int, int, int, int]]:
    """``(notice, start, end, edits)`` of all matches in ``text``; ``limits`` are the starts of its documents and its end."""
    where: dict[tuple[int, int], list[int]] = {}
    for end, (size, uses) in wanted.automaton.iter(text):
        doc = int(np.searchsorted(limits, end, "right")) - 1
        for k, offset in uses:
            where.setdefault((k, doc), []).append(end + 1 - size - offset)
    out = []
    for (k, doc), begins in where.items():
        pattern, notice, _, e = wanted.patterns[k]
        low, high = int(limits[doc]), int(limits[doc + 1])
        regions: list[list[int]] = []
        for b in sorted(set(begins)):
            left, right = max(low, b - e), min(high - 1, b + len(notice) + e)
            if regions and left <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], right)
            else:
                regions.append([left, right])
        for left, right in regions:
            out += [(k, left + m.start(), left + m.end(), sum(m.fuzzy_counts)) for m in pattern.finditer(text[left:right])]
    return out


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: number of words, places of the exact phrases, and spans of notices with their edits.

    Null texts count as empty. Words count from 0. Rows with equal ids stay separate rows.
    """
    listed = tuple(notices.items())
    exact = [(p.split(), label) for p, label in phrases.items()]

    def places(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, which = [], []
        for k, (own, _) in enumerate(exact):
            ok = np.ones(max(0, len(hashes) - len(own) + 1), bool)
            for i, w in enumerate(own):
                raw = np.frombuffer(w.encode(), np.uint8)
                ok &= hashes[i:i + len(ok)] == arrays.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
            for i in np.flatnonzero(ok).tolist():
                there = [low[starts[i + j]:ends[i + j]].tobytes() for j in range(len(own))]
                if there == [w.encode() for w in own] and np.searchsorted(bounds, i, "right") == np.searchsorted(bounds, i + len(own) - 1, "right"):
                    at.append(i)
                    which.append(k)
        return np.array(at, np.int64), np.array(which, np.int64)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = batch.column(0).to_pylist()
        wanted = search(listed)
        for row, data, bounds in arrays.text_slices(batch.column(1)):
            low = arrays.LOWER[data]
            starts, ends, of_text = arrays.words(low, bounds, arrays.ALPHANUMERIC)
            n = np.diff(of_text)
            rows = [[keys[row + i], int(n[i]), 0, None, None, [], []] for i in range(len(n))]
            if len(starts):
                text, at = joined(low, starts, ends, of_text)
                for i, k in zip(*places(low, starts, ends, arrays.word_hashes(low, starts, ends), of_text), strict=True):
                    d = int(np.searchsorted(of_text, i, "right")) - 1
                    r, word = rows[d], int(i - of_text[d])
                    r[2] += 1
                    r[3] = word if r[3] is None else min(r[3], word)
                    r[4] = word if r[4] is None else max(r[4], word)
                    if exact[k][1] not in r[5]:
                        r[5].append(exact[k][1])
                limits = np.append(at, len(text))[of_text]
                for k, a, b, e in notices_in(text, limits, wanted):
                    d = int(np.searchsorted(limits, a, "right")) - 1
                    _, notice, label, _ = wanted.patterns[k]
                    first = int(np.searchsorted(at, a, "right")) - 1 - int(of_text[d])
                    last = int(np.searchsorted(at, max(a, b - 1), "right")) - 1 - int(of_text[d])
                    rows[d][6].append({"label": label, "first_word": first, "last_word": last, "edits": e, "score": 1 - e / len(notice)})
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return documents(docs).mapInArrow(by_slices(work), FOUND)


def labels(found: DataFrame) -> DataFrame:
    """Labels as sorted lists joined by commas, and the score of the best find: 1 for an exact phrase, 0 for none."""
    own = F.col("spans.label")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    best = F.coalesce(F.array_max("spans.score"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("base_labels")).alias("base_labels"),
        join(F.concat("base_labels", own)).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
        F.size("spans").alias("n_spans"))
