"""Backtracking against the tiktoken library and against merging step by step."""

import hashlib
import random

import pytest
from public_tokenizers import PATTERN, path

from callweave.llm import byte_bpe

ALPHABETS = ["ab", "aA ", "abc", "ehtn r", "é中 ́", "0123 ", "!?.,-'s", "  \n\t ", "the in on er", "\x00\x7f￿😀"]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Encoder()


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.merges.ranks, special_tokens={})


def test_random_texts(coder, library):
    rng = random.Random(11)
    for alphabet in ALPHABETS:
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert coder.encode(text).tolist() == library.encode_ordinary(text), repr(text)


def test_rows_of_tokens(coder, library):
    rng = random.Random(12)
    for _ in range(20000):
        piece = b"".join(rng.choice(coder.merges.bytes_of) for _ in range(rng.randint(1, 6)))
        assert coder.merges.encode(piece) == library._core_bpe.encode_single_piece(piece)


def merged(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_any_table_of_ranks():
    """Tables built by merging random pairs, with short tokens over two letters: the hardest for backtracking."""
    rng = random.Random(13)
    for _ in range(40):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(30):
            new = rng.choice(tokens[97:99] + tokens[256:]) + rng.choice(tokens[97:99] + tokens[256:])
            ranks = {t: i for i, t in enumerate(tokens)}
            if len(new) < 20 and new not in ranks and len(merged(new, ranks)) == 2:
                tokens.append(new)
        ranks = {t: i for i, t in enumerate(tokens)}
        merges = byte_bpe.Merges(ranks)
        for _ in range(60):
            piece = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40)))
            assert merges.encode(piece) == merged(piece, ranks), (tokens[256:], piece)


def test_long_texts_and_small_memory(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STRETCH", 50)
    monkeypatch.setattr(byte_bpe, "MEMORY", 20)
    coder = byte_bpe.Encoder()
    for text in ["one two three's  four\n\n five 12 six. " * 20, "a" * 3000, "x" * 400 + " y" * 400, "日本語 テキスト。" * 100, " " * 500 + "end"]:
        assert "".join(coder.stretches(text)) == text
        assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_round_trip_of_the_table(spark, sf_dir, library):
    odd = [(9001, None), (9002, ""), (9002, ""), (9003, "<|endoftext|> x"), (9004, "word " * 300000), (9005, "q" * 200000), (None, "lost")]
    extra = spark.createDataFrame([(i, t, "x", 0) for i, t in odd], "doc_id long, text string, ids string, bytes int")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang AS ids", "1 AS bytes").unionByName(extra).repartition(4)
    want = sorted((r["doc_id"], len(ids := library.encode_ordinary(r["text"] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect() if r["doc_id"] is not None)
    assert sorted(map(tuple, byte_bpe.digests(docs).collect())) == want


def test_empty_tables_and_unknown_ids(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r["bytes"]) for r in byte_bpe.decoded(rows).collect()] == [b"", b""]
    with pytest.raises(Exception, match="not in the table"):
        byte_bpe.decoded(spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>"), path(byte_bpe.RANKS)).collect()
