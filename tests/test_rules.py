"""Rules that the given tables do not show, on literal rows."""

import pytest
from pyspark.sql import functions as F

from callweave import schemas
from callweave.config import JobConfig
from callweave.functions import shapes, text as tx
from callweave.operators import candidates as ca, checks, customers as cu, events as ev, extraction as ex, keys, orders as od
from callweave.operators import recommend as rc, transcript as tr
from callweave.operators.matching import with_bands
from callweave.operators.model import map_model
from callweave.operators.paging import paged
from callweave.sources import sinks
from callweave.sources.manifest import segment_manifest


def values(df, column):
    return [r[column] for r in df.collect()]


def test_sentinels(spark):
    words = [None, "", "  ", "None", "NULL", "n/a", " none ", " \t", "Dana"]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    assert values(df.filter(tx.is_value("v")), "v") == [" none ", "Dana"]
    assert values(df.filter(tx.gate("v")), "v") == ["  ", " none ", " \t", "Dana"]
    assert values(df.select(tx.display("v").alias("v")), "v") == ["", "", "  ", "", "", "", " none ", " \t", "Dana"]


def test_strip_takes_all_white_space(spark):
    samples = ["  a b　\n", "\x1c x\x1f", "", " \t"]
    df = spark.createDataFrame([(w,) for w in samples], "v string")
    assert values(df.select(tx.strip("v").alias("v")), "v") == [w.strip() for w in samples]
    assert values(df.select(tx.long_enough("v", 3).alias("v")), "v") == [True, False, False, False]


def test_like_text(spark):
    rows = [(1, "50% off", None, None), (2, "a_b", "555", None), (3, "axb", None, "A\\Q@x.y"), (4, "", None, "")]
    df = spark.createDataFrame(rows, "customer_id long, name string, phone string, email string")
    ids = lambda q, mode="literal": values(cu.search_customers(df, q, mode=mode), "customer_id")
    assert ids("50%") == [1] and ids("A_B") == [2] and ids("a_b", "like") == [2, 3]
    assert ids("a\\q") == [3] and ids("a\\q", "like") == [3]
    assert ids("") == [1, 2, 3, 4] and ids("", "like") == [1, 2, 3, 4]


def test_null_order(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 10, DATE'2024-01-02'), (1, 11, NULL), (1, 12, DATE'2024-01-01')
                      AS t(customer_id, order_id, order_date)""")
    rows = od.recent_orders(df, 3).orderBy("position").collect()
    assert [r["order_id"] for r in rows] == [11, 10, 12]
    assert od.recent_orders(df, 1).count() == 1


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "call_id string, chunk_number long, transcript_text string").withColumns({
        "created_at": F.lit("2024-01-01").cast("timestamp_ntz"), "transcript_id": F.monotonically_increasing_id()})


def test_transcript_order(spark):
    rows = [("c", 2, "b"), ("c", 1, "a"), ("c", None, "z"), ("c", 10, ""), ("e", 1, None), ("e", 2, "")]
    out = {r["call_id"]: r["full_transcript"] for r in tr.full_transcript(chunk_rows(spark, rows)).collect()}
    assert out == {"c": "a b z", "e": ""}
    two = chunk_rows(spark, [("c", 1, "a")]).withColumn("stream_type", F.lit("primary")).unionByName(
        chunk_rows(spark, [("c", 2, "a")]).withColumn("stream_type", F.lit("secondary")))
    assert tr.full_transcript(two, "primary").first()["full_transcript"] == "a"


def test_segment_ids(spark):
    ids = ["10.0", "9.1", "9.0", "9.0", "3"]
    df = spark.createDataFrame([("c", i, s, str(i)) for i, s in enumerate(ids)], "call_id string, seq long, segment_id string, text string")
    rows = tr.dedup_segments(df).orderBy("chunk", "sub").collect()
    assert [(r["segment_id"], r["seq"]) for r in rows] == [("3", 4), ("9.0", 2), ("9.1", 1), ("10.0", 0)]


def test_speaker_segments(spark):
    rows = [("a", '{"segments": [{"speaker": "AGENT", "text": "x"}, {"speaker": "Caller", "text": "y"}, {"text": "z"}, {"speaker": "system", "text": "w"}]}'),
            ("b", "not json"), ("c", '{"segments": []}'), ("d", None)]
    df = spark.createDataFrame(rows, "transcript_text string, j string").withColumns({"call_id": F.lit("1"), "chunk_number": F.lit(1)})
    out = [(r["sub"], r["speaker"], r["text"]) for r in tr.explode_segments(df, "j").collect()]
    assert out[:4] == [(0, "agent", "x"), (1, "caller", "y"), (2, "caller", "z"), (3, "caller", "w")]
    assert out[4:] == [(0, "caller", "b"), (0, "caller", "c"), (0, "caller", "d")]


def test_rule_speakers(spark):
    text = "Hello. May I have your name? My name is Ann. I want a refund. Let me check that."
    df = spark.createDataFrame([("c", text), ("d", "Hm? "), ("e", "...")], "call_id string, transcript_text string")
    out = {r["call_id"]: [(s["speaker"], s["text"]) for s in r["segments"]] for r in ex.label_speakers(df).collect()}
    assert [s for s, _ in out["c"]] == ["caller", "agent", "caller", "agent"]
    assert "".join(t for _, t in out["c"]) == text
    assert out["d"] == [("caller", "Hm? ")] and out["e"] == [("caller", "...")]


def test_merge_turns_over_blocks(spark):
    speakers = "aabbbacccaaab"
    rows = [("c", i // 2, i % 2, s, str(i)) for i, s in enumerate(speakers)] + [("d", None, 0, "a", "x"), ("d", 1, 0, "a", "w")]
    df = spark.createDataFrame(rows, "call_id string, chunk long, sub long, speaker string, text string")
    expected, texts = [], []
    for i, s in enumerate(speakers):
        if i and speakers[i - 1] == s:
            texts[-1] += f" {i}"
        else:
            texts.append(str(i))
            expected.append((i // 2, i % 2, s))
    for block in (1, 2, 3, 1000):
        out = tr.merge_turns(df, block).orderBy("call_id", "first_chunk", "first_sub").collect()
        c = [r for r in out if r["call_id"] == "c"]
        assert [(r["first_chunk"], r["first_sub"], r["speaker"]) for r in c] == expected
        assert [r["text"] for r in c] == texts
        assert sum(r["segments"] for r in c) == len(speakers)
        assert [r["text"] for r in out if r["call_id"] == "d"] == ["w x"]


def test_throttle(spark):
    rows = [("c", 1, "x" * 99), ("c", 2, " "), ("c", 3, "y"), ("c", 4, "z" * 50), ("d", 1, "short"), ("e", 1, "k" * 150)]
    out = {(r["call_id"], r["chunk_number"]): (r["transcript_chars"], r["reason"])
           for r in tr.enrichment_points(chunk_rows(spark, rows), 100).collect()}
    # 99 characters, then a blank chunk with its joins, then one more: 99 + 3 joins + 1.
    assert out == {("c", 3): (103, "growth"), ("c", 4): (154, "end"), ("d", 1): (5, "end"), ("e", 1): (150, "growth")}


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_throttle_across_batches(spark, batch):
    import random
    rnd = random.Random(7)
    calls = {f"c{c}": [" " * rnd.randint(0, 3) + "w" * rnd.randint(0, 60) + " " * rnd.randint(0, 2) for _ in range(12)] for c in range(9)}
    rows = [(c, i, t) for c, texts in calls.items() for i, t in enumerate(texts)]
    expected = []
    for c, texts in calls.items():
        kept, done, points = [], 0, []
        numbered = [(i, t) for i, t in enumerate(texts) if t]
        for i, t in numbered:
            kept.append(t)
            n = len(" ".join(kept).strip())
            if n - done >= 100:
                done = n
                points.append((c, i, n, "growth"))
        if numbered and (not points or points[-1][1] != numbered[-1][0]):
            points.append((c, numbered[-1][0], n, "end"))
        expected += points
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = sorted(tuple(r) for r in tr.enrichment_points(chunk_rows(spark, rows), 100).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == sorted(expected)


@pytest.mark.parametrize("duration,seconds,count", [(135.8, 15, 9), (135.8, 10, 14), (30, 15, 2), (31, 15, 2), (31.5, 15, 3)])
def test_segment_count(spark, duration, seconds, count):
    df = spark.sql(f"""SELECT 'c' AS call_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, x) AS ts
                       FROM VALUES (0.0), (cast({duration} AS decimal(18, 6))) AS t(x)""")
    assert tr.segment(df, seconds).first()["segment_count"] == count


def test_recommendations(spark):
    j = '{"recommendations": [{"action": "a", "confidence": "HIGH", "icon": "Refund"}, {"action": "b", "icon": "magic"}, {"action": "c"}]}'
    df = spark.createDataFrame([(j,), ("oops",)], "j string")
    recs = shapes.norm_recs(shapes.parse_json("j", schemas.RECOMMENDATIONS_DDL)["recommendations"])
    out = [[(r["confidence"], r["icon"]) for r in row["r"]] for row in df.select(recs.alias("r")).collect()]
    assert out == [[("high", "refund"), ("medium", "replace"), ("medium", "replace")], []]


def test_score_bands(spark):
    df = spark.createDataFrame([(0.7,), (0.700001,), (0.5,), (0.6,), (0.45,), (0.125,)], "match_score double")
    assert [r["band"] for r in with_bands(df, "product").collect()] == ["medium", "high", "low", "medium", "low", "low"]
    assert [r["band"] for r in with_bands(df, "case").collect()] == ["high", "high", "medium", "medium", "low", "low"]
    assert [r["percent"] for r in with_bands(df, "case").collect()] == [70, 70, 50, 60, 45, 13]


def test_candidates_are_inserted_once(spark):
    rows = [(1, None, "c", "order_number", "A", "2024-01-02"), (2, None, "c", "order_number", "A", "2024-01-01"),
            (3, None, "c", "order_number", "a", "2024-01-03"), (4, None, "c", "order_number", "A ", "2024-01-03")]
    df = spark.createDataFrame(rows, "id long, case_id long, call_id string, field_name string, field_value string, created_at string")
    df = df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    first = ca.new_candidates(df, df.limit(0))
    assert sorted((r["field_value"], r["id"]) for r in first.collect()) == [("A", 2), ("A ", 4), ("a", 3)]
    assert ca.new_candidates(df, first).count() == 0


def test_identity_cascade(spark):
    customers = spark.createDataFrame([(2, "Ann Lee", "ann@x.org", "5551234567"), (1, "Ann Lee", "lee@x.org", "5551234567"),
                                       (3, "Bo", "bo@x.org", "5550000000")], "customer_id long, name string, email string, phone string")
    orders = spark.createDataFrame([(3, "ORD-9")], "customer_id long, order_number string")
    calls = spark.createDataFrame([
        ("phone wins", "Bo", "+1 (555) 123-4567", "bo@x.org", None), ("email", "Ann", "none", "ANN@x.org", "ORD-9"),
        ("order", "Ann", None, None, "ord-9"), ("name", "nn lee", None, "n/a", ""), ("nobody", "Zed", None, None, None),
    ], "call_id string, customer_name string, customer_phone string, customer_email string, order_number string")
    out = {r["call_id"]: (r["customer_id"], r["matched_by"]) for r in cu.identify_customer(calls, customers, orders).collect()}
    assert out == {"phone wins": (1, "phone"), "email": (2, "email"), "order": (3, "order_number"), "name": (1, "name")}


def test_latest_state_and_lifecycle(spark):
    rows = [("c", 1, "call_started", "s1"), ("c", 2, "customer_match", "m1"), ("c", 3, "playback_started", "p"),
            ("c", 4, "call_started", "s2"), ("c", 5, "audio_progress", "a1"), ("c", 6, "similar_cases", "x"),
            ("d", 1, "call_started", "s"), ("d", 2, "audio_progress", "a"), ("d", 3, "call_ended", "e"), ("d", 4, "playback_ended", "pe"),
            ("e", 1, "call_started", "s"), ("e", 2, "playback_ended", "pe"), ("f", 1, "call_started", "s"), ("f", 2, "app_reset", "r")]
    df = spark.createDataFrame(rows, "call_id string, seq long, type string, payload string")
    out = sorted((r["call_id"], r["slot"], r["payload"]) for r in ev.latest_state(df).collect())
    assert out == [("c", "call", "s2"), ("c", "cases", "x"), ("c", "playback", "a1"), ("d", "call", "s"), ("e", "call", "s")]
    assert {r["call_id"]: r["state"] for r in ev.call_state(df).collect()} == {
        "c": "PLAYING", "d": "STOPPED", "e": "COMPLETE", "f": "IDLE"}


def test_model_failures_stay_in_their_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(batch):
        calls.add(len(batch))
        if (batch["x"] == 3).any():
            raise ValueError("three")
        return batch.assign(y=batch["x"] * 2)[["y"]]

    df = spark.createDataFrame([(i % 5, i) for i in range(50)], "x long, n long")
    out = map_model(df, fn, ["x"], "y long", batch=2, retries=0, concurrency=1).collect()
    assert len(out) == 50
    assert all((r["y"], r["error"]) == ((None, "three") if r["x"] == 3 else (r["x"] * 2, None)) for r in out)
    assert calls.value < 12


def test_manifest(spark, tmp_path):
    for name in ("9999_ab12cd34_1_1700000000_primary.mp3", "bad name.mp3", "ignored.txt"):
        (tmp_path / name).write_bytes(b"x")  # empty segments are skipped, as they hold no audio
    rows = {r["file_name"].replace("%20", " "): r for r in segment_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {"9999_ab12cd34_1_1700000000_primary.mp3", "bad name.mp3"}
    good = rows["9999_ab12cd34_1_1700000000_primary.mp3"]
    assert (good["case_id"], good["call_id"], good["chunk_number"], good["stream_type"], good["error"]) == (9999, "ab12cd34", 1, "primary", None)
    assert rows["bad name.mp3"]["error"] and rows["bad name.mp3"]["call_id"] is None


def test_ids_are_dense_with_a_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("a"), F.col("id").alias("b"))
    out = keys.with_ids(df.repartition(5), ["a", "b"], start=101, partitions=6).orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(101, 1101))
    assert [(r["a"], r["b"]) for r in out] == sorted((r["a"], r["b"]) for r in out)


@pytest.mark.parametrize("size", [1, 7, 100, 1000])
def test_pages_depend_on_their_key_only(spark, size):
    df = spark.range(250).select(F.when(F.col("id") < 240, "hot").otherwise("cold").alias("k"), F.col("id").alias("v"))
    many = df.union(spark.range(1500).select(F.concat(F.lit("k"), "id"), "id"))
    pages = lambda rows: {(p["k"], p["page"]): [i["v"] for i in p["items"]] for p in paged(
        rows, "k", [F.col("v").desc()], ["v"], size, F.lpad(F.floor(F.col("v") / 130).cast("string"), 3, "0"), True).collect()}
    expected = {(k, n // size): list(range(high - n, max(low, high - n - size), -1)) for k, low, high in (("hot", -1, 239), ("cold", 239, 249))
                for n in range(0, high - low, size)}
    assert pages(df) == expected
    assert {k: v for k, v in pages(many).items() if k[0] in ("hot", "cold")} == expected


def test_phones_of_two_countries_differ(spark):
    rows = ["+1 (206) 555-0100", "206-555-0100", "00 1 206 555 0100", "+44 206 555 0100", "+12065550100", "", None, "x"]
    df = spark.createDataFrame([(v,) for v in rows], "p string")
    assert [r[0] for r in df.select(tx.digits("p", "1")).collect()] == ["2065550100"] * 3 + ["442065550100", "2065550100", None, None, None]
    assert df.select(tx.digits("p")).first()[0] == "12065550100"


def test_long_mentions_are_found(spark):
    name = "n" * 120 + "abc" * 60
    customers = spark.createDataFrame([(5, name, None, None), (6, "abc", "1", "e")], "customer_id long, name string, phone string, email string")
    mentions = spark.createDataFrame([("a", name[3:254]), ("b", name), ("c", name + "x"), ("d", "ABC")], "call_id string, mention string")
    found = cu.find_by_substring(mentions, customers).collect()
    assert sorted((r["call_id"], r["customer_id"]) for r in found) == [("a", 5), ("b", 5), ("d", 5)]


def test_call_ids_are_whole_hashes(spark):
    ids = spark.range(2).select(shapes.new_call_id("id").alias("i")).select("i", shapes.shown_call_id("i").alias("s")).collect()
    assert all(len(r["i"]) == 32 and r["i"].startswith(r["s"]) and len(r["s"]) == 8 for r in ids)


def test_constraints(spark):
    orders = spark.createDataFrame([(1, 5, "SHIPPED"), (1, 9, "LOST"), (None, 9, None)], "order_id long, customer_id long, status string")
    customers = spark.createDataFrame([(5,)], "customer_id long")
    rules = (checks.NotNull("orders", "order_id"), checks.Domain("orders", "status", ("SHIPPED",)),
             checks.Unique("orders", ("order_id",)), checks.Reference("orders", "customer_id", "customers", "customer_id"))
    out = {r["rule"]: r["violations"] for r in checks.check_constraints({"orders": orders, "customers": customers}, rules).collect()}
    assert out == {"not_null": 1, "domain": 1, "unique": 1, "references_customers": 2}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, "hi")], "call_id string, chunk_number long, transcript_text string")
    path = str(tmp_path / "t")
    sinks.append_transcripts(rows, path)
    sinks.append_transcripts(rows.withColumn("call_id", F.lit("d")), path)
    back = spark.read.schema(schemas.TABLES["call_transcripts"]).parquet(path)
    assert sorted((r["call_id"], r["audio_duration"]) for r in back.collect()) == [("c", 0.0), ("d", 0.0)]
    assert sinks.reset_runtime(back).count() == 0
    assert values(sinks.reset_runtime(back, rows), "call_id") == ["d"]


def test_config():
    changed = JobConfig().updated({"segment_seconds": "20", "similarity_threshold_case": "0.5", "unknown": 1})
    assert changed.segment_seconds == 20 and changed.similarity_threshold_case == 0.5 and changed.page_size == 1000


def test_extraction(spark):
    text = ("Hello, my name is Ann Lee. My email is ann.lee@mail.example.com and my phone is (555) 123-4567. I ordered a blue kettle, "
            "order ORD-2024-77. The problem is that the lid leaks. I would like a replacement. Please ship it to 5 Oak St, Reno. "
            "I am returning it because it leaks.")
    df = spark.createDataFrame([("c", text), ("d", "the RED kettle and the blue kettle"), ("e", "nothing")], "call_id string, full_transcript string")
    products = spark.createDataFrame([("Kettle",), ("Red Kettle",), ("Blue Kettle",)], "name string")
    out = {r["call_id"]: r.asDict() for r in ex.extract_fields(df, products).collect()}
    assert out["c"] == {"call_id": "c", "customer_name": "Ann Lee", "customer_phone": "(555) 123-4567", "customer_email": "ann.lee@mail.example.com",
                        "order_number": "ORD-2024-77", "product_name": "blue kettle", "issue_description": "the lid leaks",
                        "resolution_requested": "replacement", "shipping_address": "5 Oak St, Reno", "return_reason": "it leaks"}
    assert out["d"]["product_name"] == "Red Kettle" and out["e"]["product_name"] is None


def test_defect_flag(spark):
    rows = [("p", i % 6, "OPEN", "HIGH" if i else "CRITICAL", "DEFECT") for i in range(9)] + [("q", 1, "CLOSED", "LOW", "DEFECT"), ("p", 99, "OPEN", "LOW", "RETURN")]
    df = spark.createDataFrame(rows, "product_name string, customer_id long, status string, priority string, case_type string")
    out = {r["product_name"]: r for r in rc.defect_patterns(df).collect()}
    assert (out["p"]["customers"], out["p"]["top_priority"], out["p"]["flagged"]) == (6, "CRITICAL", True)
    assert (out["q"]["closed_cases"], out["q"]["flagged"]) == (1, False)
