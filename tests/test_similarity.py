"""Similarity joins against brute force, and their plans."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.operators import similarity as sim
from callweave.operators.customers import find_by_substring
from callweave.operators.matching import match_products, similar_cases


def cosines(left, right):
    count = lambda t: Counter(re.findall(r"[^\W_]+", t.lower()))
    texts = sorted(set(right))
    df = Counter(tok for t in texts for tok in count(t))
    idf = lambda tok: math.log((1 + len(texts)) / (1 + df[tok])) + 1

    def vector(t):
        w = {tok: n * idf(tok) for tok, n in count(t).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {tok: x / norm for tok, x in w.items()} if norm else {}

    lv, rv = {t: vector(t) for t in set(left)}, {t: vector(t) for t in texts}
    return {(a, b): round(sum(x * vb.get(tok, 0) for tok, x in va.items()), 9) for a, va in lv.items() for b, vb in rv.items()}


def made_texts(n, seed):
    """Texts of which a third are one copy and most hold one word."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            out.append("the same broken lid")
        else:
            out.append("the " + " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8))))
    return out + ["", "!!", None]


@pytest.mark.parametrize("frequent,products,vector_block", [(2048, 1 << 21, 2048), (3, 4, 7), (10, 1000, 16)])
def test_text_join_is_exact(spark, monkeypatch, frequent, products, vector_block):
    monkeypatch.setattr(sim, "FREQUENT", frequent)
    monkeypatch.setattr(sim, "PRODUCTS", products)
    monkeypatch.setattr(sim, "VECTOR_BLOCK", vector_block)
    left, right = made_texts(60, 1), made_texts(80, 2)
    expected = {p: s for p, s in cosines([t for t in left if t is not None], [t for t in right if t is not None]).items() if s > 0.3}
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "t string")
    out = sim.text_similarity_join(frame(left), frame(right), "t", "t", 0.3).collect()
    assert {(r[0], r[1]): r[2] for r in out} == pytest.approx(expected, abs=2e-9)
    assert len(out) == len(expected)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_case_ranking_with_copies(spark, k):
    left, right = made_texts(20, 3), made_texts(50, 4)
    issues = spark.createDataFrame([(i, t) for i, t in enumerate(left)], "call_id long, issue string")
    cases = spark.createDataFrame([(f"CASE-{i:03d}", t) for i, t in enumerate(right)], "case_number string, issue_description string")
    cases = cases.select("case_number", "issue_description", *[F.lit(None).cast("string").alias(c) for c in (
        "customer_name", "product_name", "case_type", "status", "priority", "resolution")], F.lit(None).cast("date").alias("opened_date"))
    scores = cosines([t for t in left if t], [t for t in right if t])
    expected = []
    for i, t in enumerate(left):
        ranked = sorted((-scores[(t, u)], f"CASE-{j:03d}") for j, u in enumerate(right) if t and u and scores[(t, u)] > 0.4)
        expected += [(i, n + 1, case) for n, (_, case) in enumerate(ranked[:k])]
    out = similar_cases(issues, cases, 0.4, k).select("call_id", "position", "case_number")
    assert sorted(tuple(r) for r in out.collect()) == expected


@pytest.mark.parametrize("block", [5, 1000])
@pytest.mark.parametrize("k", [None, 4])
def test_vector_join_is_exact(spark, block, k):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 8)) * 3
    m = np.vstack([centers[i % 4] + rng.normal(size=8) for i in range(60)] + [np.zeros(8), centers[0], centers[0], centers[0]])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    s = np.round(u @ u.T, 9)
    expected = []
    for i in range(len(m)):
        hits = sorted((-s[i, j], j) for j in range(len(m)) if s[i, j] > 0.6)
        expected += [(i, j) for _, j in (hits if k is None else hits[:k])]
    out = sim.vector_similarity_join(df, df, "id", "id", "v", "v", 0.6, k=k, block=block, pivots=6)
    assert sorted((r[0], r[1]) for r in out.collect()) == sorted(expected)


def test_thresholds_are_strict(spark):
    left = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    right = spark.createDataFrame([(1, [0.3, math.sqrt(1 - 0.09)]), (2, [0.3000001, math.sqrt(1 - 0.3000001 ** 2)])], "id long, v array<double>")
    assert [r["right_id"] for r in sim.vector_similarity_join(left, right, "id", "id", "v", "v", 0.3).collect()] == [2]


def test_product_match_keeps_order_lines(spark):
    mentions = spark.createDataFrame([("c1", 1, "blue kettle"), ("c2", 1, "blue kettle"), ("c3", 2, "kettle"), ("c4", None, "kettle"), ("c5", 1, "none")],
                                     "call_id string, customer_id long, mention string")
    bought = spark.createDataFrame([(1, "Blue Kettle", 7), (1, "Blue Kettle", 8), (1, "Lamp", 9), (2, "Lamp", 10)], "customer_id long, product_name string, order_id long")
    bought = bought.withColumns({c: F.lit("x") for c in ("category", "sku", "order_number", "order_status", "tracking_number")}).withColumns(
        {"price": F.lit(None).cast("decimal(10,2)"), "quantity": F.lit(1), "order_date": F.lit(None).cast("date")})
    out = match_products(mentions, bought, bought.select(F.col("product_name").alias("name")))
    assert sorted((r["call_id"], r["order_id"], r["price"]) for r in out.collect()) == [("c1", 7, 0.0), ("c1", 8, 0.0), ("c2", 7, 0.0), ("c2", 8, 0.0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_nested_loops(spark, sf_dir):
    import __spark_entry__ as entry
    for name in ("j5_identify_by_name", "j6_identify_customer", "j7_match_products", "j8_similar_cases", "s5_resolve_keys", "s6_build_cases",
                 "j10_drop_stale", "w8_merge_turns"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_no_single_partition_steps(spark, sf_dir):
    import __spark_entry__ as entry
    for name in ("s4_with_ids", "w8_merge_turns", "t4_enrichment_points", "w3_recent_orders", "j9_new_candidates", "t1_segment"):
        assert "SinglePartition" not in plan(entry.queries()[name](spark, sf_dir)), name


def test_scans_are_pruned(spark, sf_dir):
    import __spark_entry__ as entry
    text = plan(entry.queries()["w3_recent_orders"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
    assert "WindowGroupLimit" in text


def test_substring_lookup_is_exact(spark):
    rnd = random.Random(3)
    people = [(i, "".join(rnd.choice("abAB ") for _ in range(rnd.randint(0, 9))) or None, f"{rnd.randint(0, 9999)}", f"{rnd.choice('abAB')}@x") for i in range(40)]
    asked = [(f"m{i}", "".join(rnd.choice("abAB 0123@x") for _ in range(rnd.randint(0, 4)))) for i in range(120)]
    customers = spark.createDataFrame(people, "customer_id long, name string, phone string, email string")
    mentions = spark.createDataFrame(asked, "call_id string, mention string")
    expected = []
    for call, q in asked:
        if q.lower() in ("none", "null", "n/a", ""):
            continue
        hits = [i for i, n, p, e in people if (n and q.lower() in n.lower()) or q in p or q.lower() in e.lower()]
        expected += [(call, q, i, n + 1) for n, i in enumerate(hits[:5])]
    assert sorted(tuple(r) for r in find_by_substring(mentions, customers, 5).collect()) == sorted(expected)


@pytest.mark.parametrize("block", [8, 1000])
def test_best_of_many_copies(spark, block):
    """All vectors tie: the smallest ids win, whatever the block that holds them."""
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(90)], "id long, v array<double>").repartition(6)
    out = sim.vector_similarity_join(df, df, "id", "id", "v", "v", 0.5, k=3, block=block, pivots=4)
    assert sorted((r[0], r[1]) for r in out.collect()) == [(i, i % 2 + 2 * n) for i in range(90) for n in range(3)]


def test_blocks_are_not_shuffled_to_each_other(spark, sf_dir):
    """Tasks read the blocks that they compare; no pair is joined with texts afterwards."""
    import __spark_entry__ as entry
    for name in ("a1_issue_similarity", "a2_vector_similarity", "p9_score_bands"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "MapInArrow" in text and "Exchange" not in text and "Join Inner" not in text.split("== Physical Plan ==")[1].replace("CartesianProduct", ""), name


def test_tokens_are_counted_without_a_shuffle(spark):
    from collections import Counter

    from callweave.operators.similarity import term_counts

    rows = [("a", "b a B c c C"), ("b", ""), ("c", "..."), ("d", "x"), ("e", "\u00c4 \u00e4 z1 z1")]
    counts = term_counts(spark.createDataFrame(rows, "text_id string, text string"))
    want = {(i, w): n for i, t in rows for w, n in Counter(w for w in t.lower().replace(".", "").split()).items()}
    assert {(r["text_id"], r["token"]): r["tf"] for r in counts.collect()} == want
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_shared_substrings_leave_a_task_as_few_rows(spark, monkeypatch):
    """Substrings are ranked in each chunk of customers before they are shuffled, and the numbers of tasks grow with the customers."""
    monkeypatch.setattr("callweave.operators.customers.CUSTOMERS", 50)
    people = [(i, f"Customer#{i:04d}", f"{i:04d}", f"c{i}@x") for i in range(300)]
    customers = spark.createDataFrame(people, "customer_id long, name string, phone string, email string")
    mentions = spark.createDataFrame([("a", "customer#"), ("b", "omer#0"), ("c", "#0299")], "call_id string, mention string")
    found = find_by_substring(mentions, customers, 2)
    assert sorted((r["call_id"], r["customer_id"]) for r in found.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 299)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [chunk" in text and "LeftSemi" not in text
    assert text.count(", 7") >= 4


def test_product_pairs_do_not_travel(spark, sf_dir):
    """Mentions and lines meet at the customer's key and are scored there: nothing is shuffled by a pair of texts or by two keys."""
    import re

    import __spark_entry__ as entry
    text = plan(entry.queries()["j7_match_products"](spark, sf_dir))
    assert "hashpartitioning(customer_id" in text
    assert not re.search(r"hashpartitioning\((customer_id#\d+L?, [a-z]|mention#\d+, [a-z]|left_text|product_name#\d+, [a-z])", text)


def test_case_tables_go_when_they_are_read(spark):
    """Of all that a search of cases stores, the best pairs stay."""
    from callweave.session import written_paths
    texts = made_texts(40, 5)
    issues = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "call_id long, issue string")
    cases = spark.createDataFrame([(f"C{i:03d}", t) for i, t in enumerate(texts)], "case_number string, issue_description string")
    cases = cases.withColumns({c: F.lit("x") for c in ("customer_name", "product_name", "case_type", "status", "priority", "resolution")}).withColumn(
        "opened_date", F.lit(None).cast("date"))
    before = set(written_paths())
    found = similar_cases(issues, cases, 0.2, 3)
    left = [p for p in written_paths() if p not in before]
    assert len(left) == 1
    assert {r["call_id"] for r in found.collect()} == set(range(40))


def made_rows(rnd, n, width, rare):
    """Rows (id, ix, w, rt, rw, rest) of unit vectors with many and few tokens, and some without any."""
    rows = []
    for i in range(n):
        ix = sorted(rnd.sample(range(width), rnd.choice([0, 1, width // 2])))
        rt = rnd.sample(range(rare), rnd.choice([0, 1, 3, 12])) if ix else []
        w = [rnd.random() + 0.01 for _ in ix + rt]
        norm = math.sqrt(sum(x * x for x in w)) or 1.0
        w = [x / norm for x in w]
        rows.append((f"{i:04d}", ix, w[:len(ix)], [t << 33 for t in rt], w[len(ix):], math.sqrt(sum(x * x for x in w[len(ix):]))))
    return rows


def as_block(rows, width):
    import pyarrow as pa
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["id", *sim.FIELDS])
    return sim._Block(sim._packed(batch).to_struct_array(), width)


def products(left, right):
    vector = lambda r: {**dict(zip(r[1], r[2])), **{t + 1000: x for t, x in zip(r[3], r[4])}}
    lv, rv = [vector(r) for r in left], [vector(r) for r in right]
    return np.array([[round(sum(x * b.get(t, 0) for t, x in a.items()), 9) for b in rv] for a in lv])


@pytest.mark.parametrize("folded,gain,at_once", [(1024, 1000, 1 << 19), (3, 0, 5), (16, 1 << 40, 7)])
def test_bounds_of_blocks_lose_no_pair(monkeypatch, folded, gain, at_once):
    """Only rows and columns that the folded bound leaves are scored, with the scores of all tokens."""
    for name, value in (("FOLDED", folded), ("MATRIX_GAIN", gain), ("PRODUCTS", at_once)):
        monkeypatch.setattr(sim, name, value)
    rnd = random.Random(8)
    left, right = made_rows(rnd, 50, 12, 60), made_rows(rnd, 70, 12, 60)
    scores = products(left, right)
    l, r = as_block(left, 12), as_block(right, 12)
    rows = np.arange(0, 50, 3)
    i, j, s = sim._pairs(l, r, rows, np.full(50, -np.inf), 0.4, None)
    assert {(a, b): x for a, b, x in zip(i.tolist(), j.tolist(), s.tolist())} == pytest.approx(
        {(a, b): scores[a, b] for a in rows.tolist() for b in range(70) if scores[a, b] > 0.4}, abs=2e-9)
    best = sim._Best(l.ids, 3)
    for n in range(0, 70, 10):
        part = as_block(right[n:n + 10], 12)
        found = sim._pairs(l, part, rows, best.least, 0.1, 3)
        best.add(found[0], part.ids, *found[1:])
    want = [(left[a][0], right[b][0]) for a in rows.tolist() for b in sorted(range(70), key=lambda b: (-scores[a, b], b))[:3] if scores[a, b] > 0.1]
    assert sorted((x["left_id"], x["right_id"]) for t in best.rows() for x in t.to_pylist()) == sorted(want)


def test_blocks_fit_their_bytes(spark, monkeypatch):
    """Long texts make blocks of fewer rows: a block's bytes are bounded, as a task holds blocks whole."""
    tables = []
    monkeypatch.setattr(sim, "BLOCK_BYTES", 100_000)
    keep = sim.stored
    monkeypatch.setattr(sim, "stored", lambda df, free=False: tables.append(keep(df, free)) or tables[-1])
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(400)) for _ in range(300)]
    df = sim.distinct_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    sim.similar_texts(df, df, 0.9)
    sizes = [r["n"] for t in tables if "rows" in t.columns for r in t.select(F.size("rows").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) <= 120


def test_only_wanted_texts_are_compared(spark):
    """With ``among`` the pairs are those of a comparison with all texts: weights come from all."""
    left, right = made_texts(20, 6), made_texts(60, 7)
    frame = lambda ts: sim.distinct_texts(spark.createDataFrame([(t,) for t in ts], "t string"), "t")
    l, r, some = frame(left), frame(right), frame(right[::4])
    pairs = lambda df: {(x["left_id"], x["right_id"]): x["score"] for x in df.collect()}
    wanted = {x["text_id"] for x in some.collect()}
    everything = pairs(sim.similar_texts(l, r, 0.2))
    assert pairs(sim.similar_texts(l, r, 0.2, among=some)) == {p: s for p, s in everything.items() if p[1] in wanted}


def test_links_of_patterns_are_computed_once(spark):
    from callweave.operators.recommend import defect_patterns
    seen = spark.sparkContext.accumulator(0)
    texts = ["a", "b", "c", "d"]
    cases = spark.createDataFrame([(f"C{i}", i, i, "DEFECT", "OPEN", "LOW", t) for i, t in enumerate(texts)],
                                  "case_number string, customer_id long, product_id long, case_type string, status string, priority string, issue_description string")

    def counted(rows):
        for x in rows:
            seen.add(1)
            yield x
    pairs = spark.createDataFrame(spark.sparkContext.parallelize([("a", "b"), ("b", "a"), ("c", "c"), ("c", "b")], 2).mapPartitions(counted), "left_text string, right_text string")
    out = defect_patterns(cases, 2, pairs).collect()
    assert sorted((r["pattern"], r["customers"]) for r in out) == [("C0", 3), ("C3", 1)]
    assert seen.value == 4


def test_similar_cases_of_recommendations_are_joined_once(spark, sf_dir):
    import __spark_entry__ as entry
    text = plan(entry.queries()["e3_recommend"](spark, sf_dir)).split("== Physical Plan ==")[1]
    assert "labels.parquet" not in text  # cases are read before, for the stored tiers and similar cases
