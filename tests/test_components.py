"""Connected components and defect patterns against plain versions."""

import random

from pyspark.sql import functions as F

from callweave.operators.components import components
from callweave.operators.recommend import defect_patterns


def plain(links):
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved = moved or label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(label.items())


def test_chains_stars_and_random_links(spark):
    rnd = random.Random(8)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(rnd.randrange(40), rnd.randrange(40)) for _ in range(25)] + [(7, 7)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    assert sorted(map(tuple, components(df).collect())) == plain(links)
    assert components(df.limit(0)).collect() == []


def test_patterns_across_products(spark):
    rows = [("C-3", 1, 10, "OPEN", "LOW", "pump leaks"), ("C-1", 2, 11, "CLOSED", "HIGH", "pump leaks"), ("C-2", 2, 11, "OPEN", "LOW", "it leaks"),
            ("C-4", 3, 10, "OPEN", "MEDIUM", "bent"), ("C-5", 4, 10, "OPEN", "MEDIUM", None), ("C-6", 5, 12, "OPEN", "CRITICAL", "leaks a lot")]
    cases = spark.createDataFrame(rows, "case_number string, customer_id long, product_id long, status string, priority string, issue_description string").withColumn(
        "case_type", F.when(F.col("case_number") == "C-6", "RETURN").otherwise("DEFECT"))
    pairs = spark.createDataFrame([("pump leaks", "it leaks", 0.7), ("bent", "bent", 1.0), ("bent", "leaks a lot", 0.7), ("leaks a lot", "it leaks", 0.9)],
                                  "left_text string, right_text string, score double")
    out = sorted((r["pattern"], r["products"], r["customers"], r["open_cases"], r["closed_cases"], r["top_priority"], r["flagged"])
                 for r in defect_patterns(cases, 2, pairs).collect())
    assert out == [("C-1", 2, 2, 2, 1, "HIGH", True), ("C-4", 1, 1, 1, 0, "MEDIUM", False)]


def test_patterns_by_ids_of_texts(spark):
    cases = spark.createDataFrame([("C-1", 1, 10, "OPEN", "LOW", "a"), ("C-2", 2, 11, "OPEN", "HIGH", "b"), ("C-3", 3, 11, "OPEN", "LOW", "c")],
                                  "case_number string, customer_id long, product_id long, status string, priority string, issue_description string").withColumn("case_type", F.lit("DEFECT"))
    pairs = spark.createDataFrame([("a", "b")], "l string, r string").select(F.sha2("l", 256).alias("left_id"), F.sha2("r", 256).alias("right_id"))
    assert sorted((r["pattern"], r["customers"]) for r in defect_patterns(cases, 2, pairs).collect()) == [("C-1", 2), ("C-3", 1)]
