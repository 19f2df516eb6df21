"""Classes against all pairs of shingle sets."""

import random
import re
import zlib

import numpy as np
import pytest

from callweave.llm import jaccard
from callweave.llm.queries import op6_jaccard_classes

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        shared = {}
        for s in sets[i]:
            for j in holders[s]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Aé", "b", "cc", "d1", "e", "ff", "gg", "h-h"]) + rng.choice("xyzuvw")
    line = " ".join(word() for _ in range(12))
    base = [[word() for _ in range(rng.choice([3, 6, 20, 60, 150]))] for _ in range(14)]
    texts = []
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        t = " ".join(w)
        texts.append(rng.choice([t, t, t.upper(), t.replace(" ", "\n"), f"{t} {line}", f"{line} {t}"]))
    texts += [None, "", "  \n", "one", "ONE", "one two", "a b c d", "A b c d", "a b c d e", "x " * 400, "X " * 300, line, line]
    rng.shuffle(texts)
    return list(enumerate(texts, 7))


@pytest.mark.parametrize("seed,worth,cells", [(1, 0.1, 1 << 16), (2, 2.0, 1 << 10), (3, 0.0, 16)])
def test_equals_all_pairs(spark, seed, worth, cells):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(4)
    assert sorted(map(tuple, jaccard.similar_classes(docs, worth, cells).collect())) == brute(rows)


def test_table_equals_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op6_jaccard_classes(spark, sf_dir).collect()))
    assert got == brute(rows) and any(c != i for i, _, c in got)


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip_counts_like_sets(seed):
    rng = np.random.default_rng(seed)
    query = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(query, rng.integers(1, len(query) + 1)), rng.integers(0, 90, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(50)]
    sets.append(query)
    expected = [100 * len(set(query) & set(s)) >= 80 * len(set(query) | set(s)) for s in sets]
    assert jaccard.divide_skip(query, sets).tolist() == expected


def test_bound_excludes_no_similar_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n)).astype(np.uint64) for n in (0, 1, 5, 40, 400, 400)]
    for base in sets[:]:
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            keep = base[rng.random(len(base)) >= share]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, len(base) - len(keep)).astype(np.uint64)])))
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    shape = jaccard.spread(np.concatenate(sets), bounds)
    n = np.diff(bounds)
    ok = np.array([jaccard.may_be_similar(shape[[i] * len(sets)], shape, np.full(len(sets), n[i]), n) for i in range(len(sets))])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            shared = len(set(x) & set(y))
            if 100 * shared >= 80 * (len(x) + len(y) - shared):
                assert ok[i, j]
    assert not ok[4, 5]
    full = np.full((1, jaccard.PARTS), 65535, np.uint16)
    assert jaccard.may_be_similar(full, shape[:1], np.array([10**8]), np.array([10**8])).all()


def test_chains_are_one_class(spark):
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(30):
        rows.append((100 - k, " ".join(words)))
        words[(k * 7) % 60] = f"new{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_classes(docs).collect())) == brute(rows)


def test_different_words_with_equal_sums_of_powers(spark):
    """The Thue-Morse word and its complement: their sums of powers are equal modulo 2^64, whatever the letters stand for."""
    one, two = ("".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1))
    rows = [(1, f"q r s {one} t u v"), (2, f"q r s {two} t u v"), (3, one), (4, two), (5, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_classes(docs).collect())) == brute(rows) == [(1, 3, 1), (2, 3, 2), (3, 1, 3), (4, 1, 4), (5, 1, 3)]


def test_passage_shared_by_all(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([5, 30, 200]))) + " " + passage) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.similar_classes(docs).collect())) == brute(rows)


def test_levels_are_exact_counts(spark):
    docs = spark.createDataFrame([(i, "a b c d e" if i < 9 else f"x{i} b c d e") for i in range(12)] + [(20, None)], "doc_id long, text string").repartition(3)
    levels = jaccard.shingle_levels(docs, 1 << 20)
    assert sorted(levels[levels > 0].tolist()) == [3]


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_classes(docs).collect())) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    assert jaccard.similar_classes(docs.limit(0)).count() == 0


def test_crowded_lists_make_few_pairs(spark, monkeypatch):
    """Most texts of a large group of near copies are one class before all pairs of classes meet, and no link is lost."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 2, 2, 2, 2])):
            words[k] = f"new{i}-{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked, possible = [], jaccard.possible
    monkeypatch.setattr(jaccard, "possible", lambda pairs, shapes: (asked.append(pairs.count()), possible(pairs, shapes))[1])
    monkeypatch.setattr(jaccard, "CROWD", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 8)
    assert sorted(map(tuple, jaccard.similar_classes(docs, 2.0, 1 << 12).collect())) == brute(rows)
    assert max(asked) < 150 * 149 / 4, asked  # half of all pairs


def test_runs_are_packed_without_loss():
    rnd = np.random.default_rng(4)
    keys = np.unique(rnd.integers(0, 1 << jaccard.KEY, 5000, dtype=np.uint64))
    raw = jaccard.packed(np.diff(keys, prepend=np.uint64(0)), jaccard.KEY // 8)
    assert np.array_equal(np.cumsum(jaccard.unpacked(raw, jaccard.KEY // 8), dtype=np.uint64), keys)
    assert len(zlib.compress(raw, 1)) < 6 * len(keys)
    counts = np.array([1, 2, 70_000, 2**32 - 1])
    assert jaccard.unpacked(jaccard.packed(counts, 4), 4).tolist() == counts.tolist()


def test_classes_of_single_links_join_in_one_pass(spark, monkeypatch):
    """The first labels come from the links themselves, so links that do not touch take one pass of two tables."""
    from callweave.llm import jaccard

    labels = jaccard.in_tables(spark.createDataFrame([(i, i) for i in range(8)], "node long, label long"))
    links = spark.createDataFrame([(0, 1), (3, 2), (4, 5)], "a long, b long")
    written, write = [], jaccard.in_tables
    monkeypatch.setattr(jaccard, "in_tables", lambda *a, **k: (written.append(1), write(*a, **k))[1])
    out = {r["node"]: r["label"] for r in jaccard.joined_classes(labels, links).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7}
    assert len(written) == 5
