"""Streams give what the batch forms give, whatever the order and number of files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from callweave import schemas
from callweave.config import JobConfig
from callweave.operators import events as ev, transcript as tr
from callweave.operators.matching import match_products
from callweave.plans.enrich import References, call_times, enrich
from callweave.session import run_dir, shared_dir
from callweave.sources import adapters as ad
from callweave.sources.chunks import read_chunks
from callweave.streaming import events as se, jobs, transcripts as st


def files(spark, df, path, parts, seed):
    """``df`` as a folder of files whose rows are shuffled; one file comes twice."""
    rows = df.withColumn("__p", F.pmod(F.xxhash64(*[c for c in df.columns if c != "transcript_text"], F.lit(seed)), F.lit(parts)))
    order = list(range(parts))
    random.Random(seed).shuffle(order)
    for p in [*order, order[0]]:
        rows.filter(F.col("__p") == p).drop("__p").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    return ad.call_transcripts(spark, sf_dir).filter(F.col("call_id").cast("int") < 8)


def test_running_transcript(spark, chunks, tmp_path):
    path = files(spark, chunks, str(tmp_path / "in"), 3, 1)
    stream = read_chunks(spark, path, files_per_trigger=1)
    out = jobs.collect_stream(spark, st.running_transcript(stream), st.TRANSCRIPT, "t", "update")
    last = {r["call_id"]: r["full_transcript"] for r in jobs.last_update(out, ["call_id"]).collect()}
    assert last == {r["call_id"]: r["full_transcript"] for r in tr.full_transcript(chunks).collect()}


def test_enrichment_points_in_order(spark, chunks, tmp_path):
    path = str(tmp_path / "in")
    last = chunks.groupBy("call_id").agg(F.max("chunk_number").alias("last"))
    marked = chunks.join(last, "call_id").withColumn("ended", F.col("chunk_number") == F.col("last")).drop("last")
    for low, high in ((0, 2), (3, 5), (6, 99)):
        marked.filter(F.col("chunk_number").between(low, high)).coalesce(1).write.mode("append").parquet(path)
    stream = read_chunks(spark, path, marked.schema, files_per_trigger=1)
    out = jobs.collect_stream(spark, st.enrichment_stream(stream, 1000), st.POINT, "p", "update")
    columns = ["call_id", "chunk_number", "transcript_chars", "reason"]
    assert sorted(tuple(r) for r in out.select(columns).collect()) == sorted(
        tuple(r) for r in tr.enrichment_points(chunks, 1000).select(columns).collect())


def test_latest_state_and_dedup(spark, sf_dir, tmp_path):
    rows = ad.call_events(spark, sf_dir).select("call_id", "seq", "ts", "type", "payload")
    path = files(spark, rows, str(tmp_path / "in"), 2, 2)
    stream = lambda: read_chunks(spark, path, rows.schema, files_per_trigger=1)
    out = jobs.collect_stream(spark, se.last_by_type_stream(stream()), "call_id string, type string, page long, last struct<seq: bigint, payload: string>", "s", "update")
    state = ev.state_of(jobs.last_update(out, ["call_id", "type", "page"]))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, ev.latest_state(rows).collect()))
    unique = se.dedup_stream(stream().select("seq", "ts"), ["seq"], "ts", "3650 days")
    seen = jobs.collect_stream(spark, unique, "seq long", "d").select("seq")
    assert sorted(r["seq"] for r in seen.collect()) == sorted(r["seq"] for r in rows.collect())


def test_late_rows_and_repeated_batches(spark, tmp_path):
    router = se.LateRouter(str(tmp_path), "ts", 60)
    batch = lambda *secs: spark.createDataFrame([(s,) for s in secs], "s long").select("s", F.timestamp_seconds("s").alias("ts"))
    router(batch(100, 200), 0)
    router(batch(139, 140, 300), 1)
    router(batch(139, 140, 300), 1)
    read = lambda n: sorted(r["s"] for r in spark.read.parquet(str(tmp_path / n)).collect())
    assert read("on_time") == [100, 140, 200, 300] and read("late") == [139]


@pytest.fixture(scope="module")
def worked_example(spark):
    """A seller of garden pumps: three customers report that pump P20 leaks at the gasket, eight other cases are about other things."""
    customers = spark.createDataFrame(
        [(70 + i, f"{a} {b}", f"{a.lower()}@garden.example", f"20655501{i:02d}", t, None) for i, (a, b, t) in enumerate([
            ("Ines", "Moreau", "SILVER"), ("Tomas", "Beck", "SILVER"), ("Ruth", "Okafor", "GOLD"), ("Piotr", "Lis", "PLATINUM"), ("Mei", "Tan", "GOLD")])],
        schemas.TABLES["customers"])
    pumps = {20: "Submersible Pond Pump", 21: "Hand Lever Well Pump", 22: "Rain Barrel Tap", 23: "Hose Coupling Brass"}
    products = spark.createDataFrame([(k, n, "water", f"W{k}") for k, n in pumps.items()], "product_id long, name string, category string, sku string")
    products = products.withColumn("price", F.lit(31).cast("decimal(10,2)"))
    bought = {400: (72, "2023-06-04", [20, 23]), 401: (72, "2023-08-19", [22]), 402: (70, "2023-05-01", [20]), 403: (71, "2023-05-02", [20, 21]),
              404: (74, "2023-07-30", [22, 22, 23])}
    orders = spark.createDataFrame([(o, c, f"GP{o}", d) for o, (c, d, _) in bought.items()], "order_id long, customer_id long, order_number string, d string").select(
        "order_id", "customer_id", "order_number", F.to_date("d").alias("order_date"), F.lit("DELIVERED").alias("status"),
        F.lit(93).cast("decimal(12,2)").alias("total"), F.lit(None).cast("string").alias("tracking_number"))
    items = spark.createDataFrame([(o, k) for o, (_, _, ks) in bought.items() for k in ks], "order_id long, product_id long").withColumns(
        {"quantity": F.lit(2).cast("long"), "price": F.lit(62).cast("decimal(12,2)")})
    texts = ["water leaks from the gasket of the pump housing", "the housing gasket leaks water after an hour", "gasket not tight, pump housing leaks water",
             "handle squeaks", "wrong colour delivered", "tap drips a little", "invoice shows the old address", "coupling thread too wide",
             "can it run on solar power", "lever bent in transport", "no manual in the parcel"]
    rows = [(900 + i, f"G-{900 + i}", 70 + i % 5, "x", 20 if i < 3 else 21 + i % 3, pumps[20 if i < 3 else 21 + i % 3], "DEFECT" if i < 3 else "RETURN" if i % 2 else "INQUIRY",
             "CLOSED" if i in (0, 1, 4) else "OPEN", "MEDIUM", t, "Refund to the card." if i in (0, 1, 4) else None) for i, t in enumerate(texts)]
    cases = spark.createDataFrame(rows, schemas.TABLES["cases"].rsplit(",", 1)[0]).withColumn("opened_date", F.to_date(F.lit("2023-09-09")))
    return References(customers, products, orders, items, cases)


TURNS = ["Good morning. My name is Ruth Okafor.", "Could you tell me the order?", "I am calling about my pond pump, order GP400.",
         "The problem is that water leaks from the gasket of the housing. I would like a refund."]


def call(spark, n=1):
    rows = [(f"call{c}", i, t) for c in range(n) for i, t in enumerate(TURNS)]
    return spark.createDataFrame(rows, "call_id string, chunk_number long, transcript_text string").withColumns({
        "transcript_id": F.col("chunk_number"), "created_at": F.lit("2025-03-01").cast("timestamp_ntz")})


def content(events):
    out = []
    for r in events.collect():
        payload = json.loads(r["payload"])
        for c in payload.get("candidates") or []:
            c.pop("id", None)
        out.append((r["type"], r["call_id"], json.dumps(payload, sort_keys=True)))
    return sorted(out)


def test_worked_example(spark, worked_example):
    chunks = call(spark)
    transcripts = tr.full_transcript(chunks).join(call_times(chunks), "call_id")
    config = JobConfig(similarity_threshold_case=0.1)
    nothing = spark.createDataFrame([], schemas.TABLES["call_candidate_values"])
    out = enrich(transcripts, worked_example, nothing, config, by_name_only=True)
    rows = out.events.collect()
    events = {r["type"]: json.loads(r["payload"]) for r in rows}
    assert set(events) == {"extraction_update", "customer_match", "product_match", "similar_cases", "recommendations"}
    assert [r["type"] for r in sorted(rows, key=lambda r: r["seq"])] == ["extraction_update", "customer_match", "product_match", "similar_cases", "recommendations"]
    assert all(str(r["ts"]) == "2025-03-01 00:00:00" for r in rows)
    assert events["customer_match"]["customer"]["customer_id"] == 72
    assert [(o["order_id"], len(o["items"])) for o in events["customer_match"]["orders"]] == [(401, 1), (400, 2)]
    assert [p["product_name"] for p in events["product_match"]["products"]] == ["Submersible Pond Pump"]
    assert {c["case_number"] for c in events["similar_cases"]["cases"][:3]} == {"G-900", "G-901", "G-902"}
    options = events["recommendations"]["recommendations"]
    assert 3 <= len(options) <= 5 and options[0]["icon"] == "refund" and options[0]["rank"] == 1
    again = enrich(transcripts, worked_example, out.candidates, config, by_name_only=True)
    assert again.candidates.count() == 0 and content(again.events) == content(out.events)


def test_products_of_a_call_do_not_depend_on_other_calls(spark):
    catalogue = spark.createDataFrame([(n,) for n in ("red lamp", "blue lamp", "red chair", "green table", "oak shelf")], "name string")
    lines = spark.createDataFrame([(1, "blue lamp"), (1, "red chair"), (2, "red lamp"), (3, "oak shelf")], "customer_id long, product_name string").select(
        "*", *[F.lit(1).alias(c) for c in ("price", "quantity", "order_id")],
        *[F.lit("x").alias(c) for c in ("category", "sku", "order_number", "order_status", "tracking_number")], F.lit("2023-01-01").cast("date").alias("order_date"))
    asked = spark.createDataFrame([("a", 1, "red lamp"), ("b", 2, "red lamp"), ("c", 3, "red lamp"), ("d", 1, "none")], "call_id string, customer_id long, mention string")
    rows = lambda calls: sorted((r["call_id"], r["product_name"], r["match_score"]) for r in match_products(calls, lines, catalogue).collect())
    together = rows(asked)
    assert [r[:2] for r in together] == [("a", "blue lamp"), ("a", "red chair"), ("b", "red lamp")]
    assert together == sum((rows(asked.filter(F.col("call_id") == c)) for c in "abcd"), [])
    assert rows(asked.filter("call_id = 'b'"))[0][2] == 1.0


def test_state_holds_all_pages_of_the_newest_run(spark, worked_example):
    chunks = call(spark)
    nothing = spark.createDataFrame([], schemas.TABLES["call_candidate_values"])

    def run(turns):
        own = chunks.filter(F.col("chunk_number") < turns)
        transcripts = tr.full_transcript(own).join(call_times(own), "call_id")
        return enrich(transcripts, worked_example, nothing, JobConfig(page_size=2, similarity_threshold_case=0.1), by_name_only=True).events

    old, new = run(3), run(4)
    events = old.unionByName(new)
    state = ev.latest_state(events).collect()
    slots = {"extraction_update": "extraction", "customer_match": "customer", "product_match": "products", "similar_cases": "cases", "recommendations": "recommendations"}
    expected = sorted((slots[r["type"]], json.loads(r["payload"]).get("page", 0), r["payload"]) for r in new.collect())
    assert sorted((r["slot"], r["page"], r["payload"]) for r in state) == expected
    assert max(p for s, p, _ in expected if s == "extraction") > 0
    path = run_dir(spark, "two-runs")
    for part in (new, old):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = read_chunks(spark, path, events.schema, files_per_trigger=1)
    out = jobs.collect_stream(spark, se.last_by_type_stream(stream), "call_id string, type string, page long, last struct<seq: bigint, payload: string>", "s", "update")
    again = ev.state_of(jobs.last_update(out, ["call_id", "type", "page"])).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, state))


def test_enrichment_stream_equals_batch(spark, worked_example, tmp_path):
    chunks = call(spark, 2).withColumn("ended", F.col("chunk_number") == 3)
    source = str(tmp_path / "in")
    for low, high in ((0, 1), (2, 3)):
        chunks.filter(F.col("chunk_number").between(low, high)).coalesce(1).write.mode("append").parquet(source)
    config = JobConfig(similarity_threshold_case=0.1)
    stream = read_chunks(spark, source, chunks.schema, files_per_trigger=1)
    path = str(tmp_path / "out")
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    jobs.enrich_stream(stream, worked_example, path, config)
    assert not [f for f in set(os.listdir(shared)) - before if f.startswith("table-")]  # a batch's own tables are gone
    events = spark.read.parquet(os.path.join(path, "events"))
    newest = events.groupBy("call_id", "type").agg(F.max("seq").alias("seq"))
    last = events.join(newest, ["call_id", "type", "seq"], "left_semi").drop("batch_id")
    nothing = spark.createDataFrame([], schemas.TABLES["call_candidate_values"])
    batch = enrich(tr.full_transcript(chunks).join(call_times(chunks), "call_id"), worked_example, nothing, config)
    assert content(last) == content(batch.events)
    stored = spark.read.parquet(os.path.join(path, "candidates"))
    assert stored.count() == stored.select("call_id", "field_name", "field_value").distinct().count()


def test_all_points_of_a_batch_and_broken_batches(spark, worked_example, tmp_path):
    """Points in one batch give what they give one after the other; a batch that broke off between its tables is not there."""
    rows = [(f"call{c}", n, " ".join(TURNS[:n])) for c in range(2) for n in (3, 4)]
    points = spark.createDataFrame(rows, "call_id string, chunk_number long, full_transcript string").select(
        "call_id", "chunk_number", F.length("full_transcript").cast("long").alias("transcript_chars"), F.lit("growth").alias("reason"), "full_transcript",
        F.lit(0).cast("long").alias("started_at"), (F.col("chunk_number") * 10**6).alias("updated_at"))
    config = JobConfig(similarity_threshold_case=0.1)
    one, two = (jobs.EnrichmentSink(worked_example, str(tmp_path / n), config) for n in ("one", "two"))
    one(points, 0)
    two(points.filter("chunk_number = 3"), 0)

    class Broken(jobs.EnrichmentSink):
        def _folder(self, table, batch_id=None):
            if table == "events" and batch_id is not None:
                raise OSError("the executor went")
            return super()._folder(table, batch_id)

    with pytest.raises(OSError, match="went"):
        Broken(worked_example, str(tmp_path / "two"), config)(points.filter("chunk_number = 4"), 1)
    assert two.candidates(spark).filter("batch_id = 1").count() == 0
    two(points.filter("chunk_number = 4"), 1)
    drop = lambda df: sorted(map(tuple, df.drop("batch_id", "day").collect()), key=repr)
    assert drop(one.events(spark)) == drop(two.events(spark)) and one.events(spark).count() > 10
    assert drop(one.candidates(spark)) == drop(two.candidates(spark))
