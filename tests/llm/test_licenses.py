"""Fuzzy notices against an edit-distance search over whole texts, phrases against plain counting."""

import random
import re

import numpy as np

from callweave.llm import arrays, licenses
from callweave.llm.queries import op10_license_notices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").encode().translate(arrays.LOWER.tobytes()))


def least_edits(notice, text):
    """Smallest number of edits that turn ``notice`` into some part of ``text``."""
    row = np.arange(len(notice) + 1)
    best = row[-1]
    for ch in text:
        new = np.empty_like(row)
        new[0] = 0
        for i, x in enumerate(notice):
            new[i + 1] = min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1)
        row = new
        best = min(best, row[-1])
    return best


def expected(text):
    w = words_of(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.encode().split()]
    joined = b" ".join(w).decode("latin-1")
    more = {label for n, label in licenses.NOTICES.items() if least_edits(n, joined) <= licenses.edits(n)}
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more))


def damaged(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1:], text[:i] + rng.choice("abcxyz ") + text[i:], text[:i] + rng.choice("abcxyz ") + text[i + 1:]])
    return text


def texts():
    rng = random.Random(4)
    out = [None, "", "MIT License, mit-license; the MIT\nLICENSE.", "general public", "license", "mit licenses apache license",
           "Çé MIT License é", "a\x7fb mit license", "x" * 3000, "x MIT licensemit license"]
    for notice in licenses.NOTICES:
        for n in (0, 1, licenses.edits(notice), licenses.edits(notice) + 1, licenses.edits(notice) + 4):
            out.append(f"Some {damaged(rng, notice, n).title()}. end")
    out.append(" ".join(n + " é." for n in licenses.NOTICES))
    return out


def test_finds_what_brute_force_finds(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    found = {r["doc_id"]: tuple(r)[1:7] for r in licenses.labels(licenses.scan(docs)).collect()}
    for i, t, _ in rows:
        assert found[i] == expected(t), t


def test_spans_and_scores(spark):
    text = "Intro words. Relaesed under the MIT License. Tail"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    span = r["spans"][0]
    assert (span["label"], span["first_word"], span["last_word"]) == ("mit", 2, 6) and 0 < span["edits"] <= 2 and span["score"] < 1
    assert (r["n_base"], r["first_word"]) == (1, 5)


def test_rows_of_the_table(spark, sf_dir):
    out = op10_license_notices(spark, sf_dir)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = words_of(docs[r["doc_id"]])
        assert r["n_words"] == len(w) and 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.labels(licenses.scan(empty)).count() == 0
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "x")], "doc_id long, text string")
    assert [r["n_base"] for r in licenses.scan(twice).collect()] == [1, 1]
