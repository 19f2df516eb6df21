"""Repeated bytes and words against brute force over all windows."""

import hashlib
import random
from collections import defaultdict

import pytest

from callweave.llm import byte_repeats, word_repeats
from callweave.llm.queries import op1_byte_repeats, op8_word_repeats

SPACE = b" \t\n\x0b\x0c\r"


def brute_bytes(rows, size):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(int)
    for _, t in texts:
        for s in range(len(t) - size + 1):
            seen[t[s:s + size]] += 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - size + 1):
            if seen[t[s:s + size]] > 1:
                gone[s:s + size] = [True] * size
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def brute_words(rows, size):
    texts = [(i, (t or "").encode().translate(bytes(32 if b in SPACE else b for b in range(256))).split(b" ")) for i, t in rows]
    texts = [(i, [w for w in t if w]) for i, t in texts]
    least = {}
    for i, t in texts:
        for s in range(len(t) - size + 1):
            key = tuple(t[s:s + size])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for s in range(len(t) - size + 1):
            if least[tuple(t[s:s + size])] < i:
                gone[s:s + size] = [True] * size
        out.append((i, len(t), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed):
    """Copies, near copies, shared passages, periodic texts and noise, of words short enough that many things meet."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(5, 90))] for _ in range(12)]
    passage = [word() for _ in range(15)]
    texts = []
    for _ in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w[k:k] = passage
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    texts += [None, "", "a", "ab" * 300, "x" * 500, "ab " * 200, "y", " ".join(base[0]), " ".join(base[0]), "é" * 90, " \n "]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,many", [(1, 2048), (2, 2), (3, 1)])
def test_bytes_equal_brute_force(spark, seed, many):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, anchor string, ctx int").repartition(4)
    spans = byte_repeats.repeated_bytes(docs, 20, 9, many, 2000)
    assert sorted(map(tuple, byte_repeats.without_repeats(docs, spans).collect())) == brute_bytes(rows, 20)


@pytest.mark.parametrize("seed,many", [(4, 2048), (5, 2), (6, 1)])
def test_words_equal_brute_force(spark, seed, many):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    spans = word_repeats.repeated_words(docs, 8, 3, many, 2000)
    assert sorted(map(tuple, word_repeats.without_repeats(docs, spans).collect())) == brute_words(rows, 8)


@pytest.mark.parametrize("run", [op1_byte_repeats, op8_word_repeats])
def test_tables_equal_brute_force(spark, sf_dir, run):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute_bytes(rows, 200) if run is op1_byte_repeats else brute_words(rows, 50)
    assert sorted(map(tuple, run(spark, sf_dir).collect())) == expected
    assert sum(r[2] for r in expected) > 0


def test_repeated_rows_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    out = byte_repeats.without_repeats(docs, byte_repeats.repeated_bytes(docs)).collect()
    assert [r["n_removed"] for r in out] == [len(text)] * 2
    out = word_repeats.without_repeats(docs, word_repeats.repeated_words(docs)).collect()
    assert [r["n_removed"] for r in out] == [0, 0]  # the id is not smaller
    empty = docs.limit(0)
    assert byte_repeats.without_repeats(empty, byte_repeats.repeated_bytes(empty)).count() == 0
    assert word_repeats.without_repeats(empty, word_repeats.repeated_words(empty)).count() == 0


def test_different_words_with_equal_sums_of_powers(spark):
    """Only the words that are really equal go: these two differ."""
    from test_tokens import thue_morse

    one, two = thue_morse()
    around = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join([*around, word, *around])) for k, word in ((1, one), (2, two), (3, one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in word_repeats.without_repeats(docs, word_repeats.repeated_words(docs)).collect()}
    assert got == {1: 0, 2: 0, 3: 61}
