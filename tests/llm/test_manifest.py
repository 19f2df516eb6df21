"""The Merkle manifest against a plain computation, with trees of one and of several superblocks."""

import hashlib
import zlib

import pytest

from callweave.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf int, key string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    values = (row[k] for k in ("doc_id", "source", "lang", "n_chars", "text"))
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tower(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def expected(rows):
    """Plain levels over everything."""
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    towers = {}
    for k in order:
        trees[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        towers[k] = tower([leaf(r) for r in trees[k]])
    top = tower([towers[k][-1][0] for k in order])
    out = []
    for t, k in enumerate(order):
        for i, r in enumerate(trees[k]):
            proof, node = [], leaf(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                node = leaf(dict(r) | {"n_chars": r["n_chars"] + 1})
            for levels, at in ((towers[k], i), (top, t)):
                for nodes in levels[:-1]:
                    pair = nodes[at // 2 * 2:at // 2 * 2 + 2]
                    other = [x for j, x in enumerate(pair) if j != at % 2]
                    proof += other
                    node = sha(*([node, *other] if at % 2 == 0 else [*other, node]))
                    at //= 2
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), towers[k][-1][0], root, sha(*proof), node, node == root))
    return sorted(out, key=repr)


def found(df, levels):
    return sorted(map(tuple, manifest.manifest(df, levels).collect()), key=repr)


def made(n, languages):
    return [(i * 3 % 1009, f"s{i % 3}" if i % 5 else None, languages[i * i % len(languages)], i if i % 4 else None,
             None if i % 11 == 0 else "" if i % 13 == 0 else "é漢 " * (i % 7) + str(i), i, "x") for i in range(n)]


@pytest.mark.parametrize(("n", "languages", "levels"), [
    (1, ["a"], 10), (1, [None], 1), (9, ["a"], 1), (40, ["a"], 2), (65, ["a", "a", "a", "b", None], 2), (300, ["é", "z", None, "a", "B", ""], 2),
    (200, [f"l{i}" for i in range(17)], 1), (130, ["a", "b"], 10)])
def test_equals_plain_levels(spark, n, languages, levels):
    df = spark.createDataFrame(made(n, languages), SCHEMA).repartition(3)
    assert found(df, levels) == expected([r.asDict() for r in df.collect()])


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(5, "s", "a", 1, "t", 0, "k")] * 3 + [(5, "s", "a", 1, "u", 0, "k"), (None, None, None, None, None, 0, "k"), (None, "s", "a", 2, "v", 0, "k"),
            (2**60 + 1, "s", "a", 3, "w" * 200000, 0, "k"), (-4, "s", "a", 3, "w", 0, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df, 1)
    assert len(got) == 8 and got == expected([r.asDict() for r in df.collect()])
    assert {r[0] for r in got} == {5, None, 2**60 + 1, -4}


def test_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_and_who_was_tampered_with(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    got = found(df, 3)
    assert got == expected(rows)
    changed = {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0}
    assert changed and {r[0] for r in got if not r[6]} == changed


def test_fold_needs_the_right_place():
    levels = manifest.reduced([hashlib.sha256(bytes([i])).digest() for i in range(5)], None)
    sides, siblings = manifest.way_up(levels, 4)
    assert list(sides) == [manifest.NONE, manifest.NONE, manifest.LEFT] and len(siblings) == 1
    assert manifest.fold(levels[0][4], sides, siblings) == levels[-1][0] != manifest.fold(levels[0][3], sides, siblings)
