"""Token files and packing against the tokenizers library on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from callweave.llm import arrays, packing, token_output, tokens
from callweave.session import run_dir

ODD = ["", None, "a  b", " \n\n x  y  z", "it's 12　 3 'll\"'s", "\x1c a\x1d b", "a\u0085 b", "<|endoftext|> hi x<|endoftext|>",
       "’ s’s \t\t q\r\n", "é à ñ   k÷× ü.Ä'é", "end  ", "x.y,z!?'s 'tis don't \"quoted\"'s", "­soft­ a–b–.c", "日本語 テキスト。",
       "don'tdon't.'s", "a" * 5000, "word " * 3000, "ab.CD(ef)'ve/x"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    extra = spark.createDataFrame([(1000 + i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, piece string, start int")
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "lang AS piece", "1 AS start")
    return given.unionByName(extra).repartition(5)


@pytest.fixture(scope="module")
def expected(docs):
    model = tokens.Encoder().model
    return {r["doc_id"]: np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}


def test_units_give_the_ids_of_whole_texts():
    coder, rng = tokens.Encoder(), random.Random(3)
    parts = ["'", "'s", "é", "a", "Zb", " ", "  ", "\n", ".", "-", "12", " ", " ", "ß", "×", "—", "’", "漢", "́", "_", "\x1f", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for first, data, bounds in arrays.text_slices(pa.array(texts), 3000):
        ids, ends = coder.encode(data, bounds)
        for i in range(len(ends) - 1):
            text = texts[first + i] or ""
            assert coder.model.encode(text, add_special_tokens=False).ids == ids[ends[i]:ends[i + 1]].tolist(), repr(text)


def thue_morse():
    """Two different words whose sums of powers are equal modulo 2^64, whatever the letters stand for."""
    return ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(1024)) for k in (0, 1)]


def test_units_are_compared_by_their_bytes():
    one, two = thue_morse()
    coder = tokens.Encoder()
    text = f"x {one} {two}"
    data = np.frombuffer(text.encode(), np.uint8)
    assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == coder.model.encode(text).ids


def test_words_have_hashes_of_their_own():
    rng = random.Random(7)
    made = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(5000)} | {"q" * n for n in range(1, 600)} | set(thue_morse())
    words = [w for w in made for _ in range(2)]
    rng.shuffle(words)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = arrays.words(data, np.array([0, len(data)]), arrays.NOT_SPACE)
    found = {}
    for w, h in zip(words, arrays.word_hashes(data, starts, ends).tolist()):
        found.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in found.values()) and len(set.union(*found.values())) == len(made)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_UNITS", 5)
    coder = tokens.Encoder()
    for text in ["one two three", "four five six one", "two one seven eight"] * 2:
        data = np.frombuffer(text.encode(), np.uint8)
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == coder.model.encode(text).ids


@pytest.mark.parametrize("ids", [[], [5], [7] * 9, list(range(70000)), [1, 2, 3, 4, 5, 60000, 2**32 - 1] * 3])
def test_code_round_trip(ids):
    ids = np.array(ids, "<u4")
    ranking, control, codes = token_output.encode(ids)
    assert token_output.decode(ranking, control, codes, len(ids)).tolist() == ids.tolist()
    assert len(control) == -(-len(ids) // 4)


def test_four_byte_codes():
    sizes = token_output.SIZES[0b11100100]
    assert sizes.tolist() == [1, 2, 3, 4]
    codes = bytes([1, 1, 1, 1, 1, 1, 1, 0, 0, 0])
    ranking = np.arange(0x10102, dtype="<u4").tobytes()
    assert token_output.decode(ranking, bytes([0b11100100]), codes, 4).tolist() == [1, 257, 65793, 1]


def test_files_hold_all_ids(spark, docs, expected):
    path = run_dir(spark, "tokens")
    token_output.write_tokens(docs, path, block_ids=5000)
    rows = sorted(token_output.read_tokens(spark.read.parquet(path)).collect(), key=lambda r: r["doc_id"])
    start = 0
    assert [r["doc_id"] for r in rows] == sorted(expected)
    for r in rows:
        ids = expected[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_places_every_piece(docs, expected):
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(expected)
    for doc, ids in expected.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 1024 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(by_doc[doc]) == -(-len(ids) // 1024)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(map(len, expected.values())) // 1024) + 2


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    assert token_output.token_files(empty, run_dir(spark, "tokens")).count() == 0
    odd = spark.createDataFrame([(None, "lost"), (3, None), (3, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, token_output.token_files(odd, run_dir(spark, "tokens")).select("doc_id", "start", "n_tokens").collect())) == [(2, 0, 1), (3, 1, 1), (3, 2, 1)]
    assert packing.pack(odd).count() == 3


def squares(groups):
    return sum(n * sum(g) ** 2 for g, n in groups.items())


def test_exchange_empties_sequences():
    groups = Counter({(6, 3): 4, (5, 4): 2, (7,): 1, (2, 2): 3, (1,): 2})
    better = packing.exchange(groups, 10)
    lengths = lambda g: sum((Counter({x: n for x in [v]}) for k, n in g.items() for v in k), Counter())
    assert lengths(better) == lengths(groups) and all(sum(g) <= 10 for g in better)
    assert squares(better) > squares(groups) and sum(better.values()) < sum(groups.values())


def test_exchange_ends_where_no_pair_has_one():
    rng = random.Random(1)
    groups = packing.exchange(packing.best_fit(Counter(rng.randrange(200, 500) for _ in range(2000)), 1024), 1024)
    under = sorted((g for g in groups if sum(g) < 1024), key=lambda g: (sum(g), g))
    left = [(a, b) for i, a in enumerate(under) for b in under[i:] if (a != b or groups[a] > 1) and packing._better(a, b, 1024)]
    assert len(under) > 100 and not left


def test_best_fit_uses_each_piece_once():
    rng = random.Random(5)
    for _ in range(30):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 200)))
        groups = packing.exchange(packing.best_fit(counts, 40), 40)
        found = Counter()
        for g, n in groups.items():
            assert sum(g) <= 40
            for x in g:
                found[x] += n
        assert found == counts
        assert sum(groups.values()) <= -(-sum(k * n for k, n in counts.items()) // 40) + 1 + sum(groups.values()) // 10


def test_short_units_met_before_are_looked_up_at_once(monkeypatch):
    """Neither places that units share, nor a full cache, nor zero bytes at a unit's end change an id."""
    from callweave.llm import tokens

    rng = np.random.default_rng(5)
    vocabulary = ["a", "a\0", "a\0\0", "eightlet", "eightlet\0", "fifteenletters!", "sixteenletters!!", "sixteenletterse", "naïve", "日本", "don't", "42", "é"]
    texts = [" ".join(rng.choice(vocabulary + [f"w{i}" for i in range(400)], 300)) for _ in range(20)] + ["", "\0"]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    plain = tokens.Encoder()
    expected = [e.ids for e in plain.model.encode_batch_fast(texts, add_special_tokens=False)]

    def same(ids, ends):
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == expected

    for bits, cached in ((19, 900_000), (3, 900_000), (19, 50)):
        monkeypatch.setattr(tokens, "TABLE_BITS", bits)
        monkeypatch.setattr(tokens, "CACHED_UNITS", cached)
        encoder = tokens.Encoder()
        for _ in range(3):
            same(*encoder.encode(data, bounds))
    monkeypatch.setattr(tokens, "TABLE_BITS", 19)
    monkeypatch.setattr(tokens, "CACHED_UNITS", 900_000)
    encoder = tokens.Encoder()
    words = np.frombuffer(b"one two three four " * 50, np.uint8)
    ids, _ = encoder.encode(words, np.array([0, len(words)]))

    class Untouched(dict):
        def __getitem__(self, key):
            raise AssertionError(key)

    encoder.slots = Untouched(encoder.slots)
    assert encoder.encode(words, np.array([0, len(words)]))[0].tolist() == ids.tolist()
