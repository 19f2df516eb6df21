"""Codewords, held-out accuracy, and texts that no language can be told of."""

import zlib

import numpy as np
import pytest

from callweave.llm import language
from callweave.llm.queries import op3_language_codes


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len(np.unique(code, axis=0)) == n
    assert (np.abs(code.sum(0)) < n).all()  # every bit splits the languages


def test_predicts_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op3_language_codes(spark, sf_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    assert set(rows) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert not any(r["ambiguous"] for r in rows.values() if r["lang_pred"] == truth[r["doc_id"]] and r["score"] > 0.6)


def test_decoding_repairs_wrong_bits():
    code = language.codewords(5)
    model = language.Model(list("abcde"), code, np.zeros((1, code.shape[1]), np.float32), 3 * code[2].copy())
    model.bias[:3] *= -1
    assert model.scores(np.zeros((1, 1), np.float32)).argmax() == 2


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog are here", "en", "x"), (2, "der Hund und die Katze sind hier", "de", None), (3, None, "en", "x"), (4, "123 !?", "de", "x"),
            (5, "", None, "x"), (6, "the house", None, "x"), (7, "é" * 3000, None, "x"), (8, "the", "en", "x"), (8, "the", "en", "x"), (None, "x", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = language.predict(docs, language.learn(docs)).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == 9 and found[6] == found[1] == "en" and found[2] == "de"
    assert all(found[i] == "und" for i in (3, 4, 5)) and found[7] in ("en", "de")
    empty = docs.limit(0)
    assert language.predict(empty, language.learn(empty)).count() == 0
    unlabelled = docs.where("lang is null")
    assert {r["lang_pred"] for r in language.predict(unlabelled, language.learn(unlabelled)).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.predict(docs, language.learn(docs.where("lang = 'en'"))).collect()} == {"und", "en"}


def test_equal_scores_are_ambiguous(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string")
    code = language.codewords(2)
    even = language.Model(["en", "fr"], code, np.zeros((language.BUCKETS, 1), np.float32), np.zeros(1, np.float32))
    assert [(r["lang_pred"], r["ambiguous"]) for r in language.predict(docs, even).collect()] == [("en", True)] * 2


def test_learns_every_label(spark):
    """300 languages of words of their own, the rarer ones with three rows each."""
    rng = np.random.default_rng(3)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(8)] for _ in range(300)]
    rows = [(1000 * i + j, " ".join(rng.permutation(words[i])), f"l{i:03}") for i in range(300) for j in range(6 if i < 256 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert model.languages == [f"l{i:03}" for i in range(300)]
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert np.mean([found[i]["lang_pred"] == lang and not found[i]["ambiguous"] for i, _, lang in rows if lang >= "l256"]) > 0.95


def test_draws_a_row_of_every_label(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 40)
    docs = spark.createDataFrame([(i, f"text {i % 40}", f"l{i % 40:02}") for i in range(2000)], "doc_id long, text string, lang string")
    assert len(language.learn(docs).languages) == 40
