"""Alignment and counting against whole texts, read by the libraries, and plain counting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from callweave.llm import alignment

ODD = [None, "", " ", "  ", "x ", " x", "a  b   c ", "\n\na\tb \n c", "<s> </s> <unk> <|endoftext|> x<0x41>", "▁a", "a ▁ b", "日本語 テキスト。", "é é à", "\x00 \x1c a",
       "it's don't 'll", "a\u0085 b  c", "  x", "w" * 3000, "word " * 2000, "😀 😀😀", "Ⅷ ﬁ ½", "\r\n \r\n", "the the the the", "the the the the"]


@pytest.fixture(scope="module")
def coder():
    return alignment.Aligner()


def whole(coder, text):
    """``(ids of A, ids of B, groups)`` by the libraries' own calls on the whole text, or nothing."""
    if not text:
        return [], [], []
    a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    pieces = [coder.b.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if coder.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    a_bytes = [coder.a_bytes[i] for i in a]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], []
    a_ends, b_ends = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
    out, start = [], 0
    for end in sorted(set(a_ends) & set(b_ends)):
        out.append(([i for i, e in zip(a, a_ends) if start < e <= end], [i for i, e in zip(b, b_ends) if start < e <= end]))
        start = end
    return a, b, out


def expected(coder, rows):
    read = [(d, *whole(coder, t)) for d, t in rows]
    linked = [Counter((x, y) for g, h in groups for x in g for y in h) for _, _, _, groups in read]
    count = Counter(p for pairs in linked for p in pairs)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (d, a, b, groups), pairs in zip(read, linked):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((d, len(a), len(b), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out), count


def test_odd_texts_and_repeated_rows(spark, coder):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "the  end"), (3, "the  end"), (3, None)]
    df = spark.createDataFrame([(None, "lost"), *rows], "doc_id long, text string").selectExpr("doc_id", "text", "1 AS run", "2 AS bucket", "text AS groups").repartition(3)
    want, count = expected(coder, rows)
    assert sorted(map(tuple, alignment.aligned(df, records=100, fan=2).collect())) == want
    assert {(r["a_id"], r["b_id"]): r["n_docs"] for r in alignment.pair_counts(df, records=100, fan=2).collect()} == dict(count)
    text = {r["doc_id"]: r["groups"] for r in alignment.groups(df).collect()}
    assert text[0] == text[1] == text[9] == "" and text[6].count("|") == text[6].count(";") + 1


def test_random_units(coder):
    rng = random.Random(21)
    parts = ["a", "Zb", " ", "  ", "\n", ".", "'s", "é", "12", " ", "漢", "_", "the", "▁", "\x1f", "<s>", "<|endoftext|>", "ß", "‐", "\t"]
    for text in [t for t in ODD if t] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(4000)]:
        raw = np.frombuffer(text.encode(), np.uint8)
        data, starts, bounds = alignment.spaced(raw, np.array([0, len(raw)]))
        got = alignment.group_texts(coder, coder.units(data.tobytes(), starts), np.searchsorted(starts, bounds))[0]
        assert got == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in whole(coder, text)[2]), repr(text)


@pytest.mark.parametrize(("records", "fan"), [(5000, 2), (1 << 21, 8)])
def test_whole_table(spark, sf_dir, coder, records, fan):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(6)
    want, _ = expected(coder, [tuple(r) for r in df.collect()])
    assert sorted(map(tuple, alignment.aligned(df, records=records, fan=fan, buckets=16).collect())) == want


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_small_memory_changes_nothing(monkeypatch, coder):
    monkeypatch.setattr(alignment, "MEMORY", 3)
    small = alignment.Aligner()
    for text in ["one two three four", "four five one", "two  one seven "]:
        raw = np.frombuffer(text.encode(), np.uint8)
        data, starts, _ = alignment.spaced(raw, np.array([0, len(raw)]))
        of_doc = np.array([0, len(starts)])
        assert alignment.group_texts(small, small.units(data.tobytes(), starts), of_doc) == alignment.group_texts(coder, coder.units(data.tobytes(), starts), of_doc)


def test_wide_groups_count_like_narrow_ones(monkeypatch, coder):
    units = [b" the cat", b" a aaaa", " é日本".encode(), b" x,y;z"]
    monkeypatch.setattr(alignment, "WIDE", 0)
    other = alignment.Aligner()
    for c in (coder, other):
        c._empty()
        c.learn(units)
    assert coder.text == other.text and all(coder.__dict__[k].held[:coder.__dict__[k].n].tolist() == other.__dict__[k].held[:other.__dict__[k].n].tolist()
                                            for k in ("counts", "valid", "ends", "pairs", "links"))


def test_columns_round_trip():
    for columns in ([[], []], [[1, 2**40, 5], [0, 1, 2**62]], [[7], [8], [9]]):
        got = alignment.unpacked(alignment.packed(*[np.array(c, np.int64) for c in columns]))
        assert [g.tolist() for g in got][:len(columns)] == columns
