"""WAND against scores of all items, finds against a plain search, and planted passages."""

import random

import numpy as np
import pytest

from callweave.llm import decontaminate as d


def items(rng, n):
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    return [(i, " ".join(word() for _ in range(rng.randint(3, 30))) + ". " + " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(n)]


def shard_of(rows):
    words = {i: d._hashes(t) for i, t in rows}
    df = {}
    for w in words.values():
        for t in np.unique(w).tolist():
            df[t] = df.get(t, 0) + 1
    idf = {t: float(np.log(1 + (len(rows) - n + 0.5) / (n + 0.5))) for t, n in df.items()}
    mean = sum(map(len, words.values())) / len(rows)
    return d.build(rows, idf, mean), idf, mean, words


@pytest.mark.parametrize("seed", range(4))
def test_wand_returns_all_above_threshold(seed):
    rng = random.Random(seed)
    rows = items(rng, 75)
    shard, idf, mean, words = shard_of(rows)

    def score(passage, i):
        w = words[i]
        total = own = 0.0
        for t in np.unique(w).tolist():
            tf = int((w == t).sum())
            x = idf[t] * tf * (d.K1 + 1) / (tf + d.K1 * (1 - d.B + d.B * len(w) / mean))
            own += x
            total += x * (t in passage)
        return total / own

    for _ in range(60):
        passage = set(rng.sample(sorted(idf), rng.randint(1, 20))) | set(np.unique(words[rng.randrange(75)]).tolist()[:rng.randint(0, 30)])
        threshold = rng.choice([0.2, 0.5, 0.9])
        found = dict(d.wand(shard, [int(np.searchsorted(shard.terms, np.uint64(t))) for t in sorted(passage)], threshold))
        expected = {i: s for i, _ in rows if (s := score(passage, i)) >= threshold - 1e-6}
        assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-9 for i in found)


def test_passages_hold_every_stretch_of_half_their_size():
    of_text = np.array([0, 0, 3, 20, 61, 61])
    text, start, end = d.passages(of_text, 10)
    for t in range(5):
        own = [(a, b) for x, a, b in zip(text, start, end) if x == t]
        for a in range(of_text[t], of_text[t + 1] - 4):
            assert any(s <= a and a + 5 <= e for s, e in own)


@pytest.mark.parametrize("at_once,shard_items", [(4096, 512), (9, 4)])
def test_finds_planted_items(spark, at_once, shard_items):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    bench = [(i, " ".join(word() for _ in range(rng.randint(8, 40))).capitalize() + ".\n" + " ".join(word() for _ in range(rng.randint(2, 12))) + ".") for i in range(40)]
    bench += [(100, " ".join(word() for _ in range(20))), (101, None), (102, "..."), (None, "x y z"), (0, bench[0][1])]
    rows, expected = [], set()
    for k in range(120):
        w = [word() for _ in range(rng.choice([0, 5, 300, 900]))]
        i, t = rng.choice(bench[:41])
        kind = rng.randrange(5)
        if kind == 0:
            w[len(w) // 2:len(w) // 2] = t.upper().split()
        elif kind == 1:  # an edit here and there
            p = t.split()
            p[1] = word()
            w[len(w) // 3:len(w) // 3] = p
        elif kind == 2:  # the question alone
            question = t.split("\n")[0].split()
            w += question[:len(question) // 2] if i == 100 else question
        if kind < 2:
            expected.add((k, i))
        rows.append((k, " ".join(w)))
    rows += [(500, None), (501, ""), (None, bench[1][1]), (502, bench[2][1]), (502, bench[2][1])]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    df = spark.createDataFrame([(i, t, "clash") for i, t in bench], "item_id long, text string, part string")
    found = d.contaminated(docs, df, at_once=at_once, shard_items=shard_items).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs == expected | {(502, 2)} and len(found) == len(pairs)
    assert all(r["score"] >= 0.49 and min(r["question_overlap"], r["answer_overlap"]) >= 0.5 for r in found)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "some words here. yes")], "item_id long, text string")
    assert d.contaminated(docs.limit(0), bench).count() == d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.contaminated(docs, spark.createDataFrame([(1, "?!")], "item_id long, text string")).count() == 0
