"""The stages one after the other against brute-force versions on a small table."""

import zlib

import numpy as np
import pytest
from test_jaccard import brute as classes

import corpus_pipeline
from callweave.llm import decontaminate, language, pii, tokens
from callweave.llm.queries import QUERIES
from callweave.session import run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What each stage returns, written and read again."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = run_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def leaks(text, bench):
    """Plain search: BM25 of each passage against each item by formula, then triples."""
    words = decontaminate._hashes(text)
    df = {}
    items = [(i, t, decontaminate._hashes(t)) for i, t in bench]
    for _, _, w in items:
        for t in np.unique(w).tolist():
            df[t] = df.get(t, 0) + 1
    mean = sum(len(w) for _, _, w in items) / len(items)
    size = max(decontaminate.PASSAGE, 2 * max(len(w) for _, _, w in items))
    for a in range(0, max(1, len(words) - size // 2), size // 2):
        here = words[a:a + size]
        inside = set(here.tolist())
        for _, text, w in items:
            total = own = 0.0
            for t, tf in zip(*np.unique(w, return_counts=True)):
                x = np.log(1 + (len(items) - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                own, total = own + x, total + x * (int(t) in inside)
            if total >= 0.5 * own:
                shares = []
                for part in decontaminate.question_and_answer(text):
                    n = min(3, len(part))
                    triples = {tuple(here[k:k + n]) for k in range(len(here) - n + 1)}
                    wanted = {tuple(part[k:k + n]) for k in range(len(part) - n + 1)} if n else set()
                    shares.append(len(triples & wanted) / len(wanted) if wanted else 1.0)
                if min(shares) >= 0.5:
                    return True
    return False


def test_stages_are_those_asked_for():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_language_stage_keeps_what_can_be_told(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(any(c.isalpha() for c in t) for t in after.values())
    gone = set(before) - set(after)
    model = language.learn(stages[0].where(~language.held_out()))
    found = {r["doc_id"]: r for r in language.predict(stages[0], model).collect()}
    assert gone == {i for i, r in found.items() if r["lang_pred"] == "und" or r["ambiguous"]}
    assert all(after[i] == before[i] for i in after)


def test_near_copies_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert set(after) == {i for i, _, c in classes(sorted(before.items())) if i == c}
    assert len(after) < len(before)


def test_decontamination_stage(stages, spark, sf_dir):
    before, after = texts(stages[2]), texts(stages[3])
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(before) - set(after) == {i for i, t in before.items() if leaks(t, bench)} != set()


def test_pii_stage(stages, spark):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    import re
    pattern = re.compile(pii.ANY)
    for i, t in before.items():
        if t != after[i]:
            assert pattern.split(t) == pattern.split(after[i]) or len(t) == len(after[i]) or "." in t
        if not pattern.search(t):
            assert t == after[i]


def test_packing_stage(stages):
    model = tokens.Encoder().model
    rows = stages[5].collect()
    expected = {}
    for i, t in texts(stages[4]).items():
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(len(ids), 1024)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[i, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_extra_columns_and_odd_rows(spark, sf_dir):
    rows = [(1, "der Hund und die Katze sind hier im Garten", "de", "s", 1, "x"), (2, "the cat and the dog are in the garden now", "en", "s", 1, "y"),
            (2, "the cat and the dog are in the garden now", "en", "s", 1, "y"), (3, None, None, None, None, None), (None, "the cat", "en", "s", 1, "z"),
            (4, "", "en", "s", 0, None), (5, "the cat and the dog are in the garden now", "en", "s", 1, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    docs = spark.createDataFrame(rows, schema).withColumnRenamed("label", "component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = run_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[-1] == "component_id"
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 2]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
