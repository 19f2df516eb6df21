"""Queries over tables: scans, sinks, checks, projections and order joins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from callweave import schemas
from callweave.functions import shapes, text as tx
from callweave.operators import checks, keys, orders as od
from callweave.operators.candidates import to_candidates
from callweave.operators.extraction import extract_fields
from callweave.plans.derived import strip
from callweave.plans.registry import query
from callweave.session import run_dir
from callweave.sources import adapters as ad, chunks, sinks
from callweave.sources.tables import load, raw
from callweave.streaming.jobs import collect_stream

CREATED = "2024-01-01 00:00:00"


def texts(s: SparkSession, d: str) -> DataFrame:
    calls = ad.introductions(s, d).select(F.concat(F.lit("call-"), F.col("conv_id").cast("string")).alias("call_id"), "text")
    docs = raw(s, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("call_id"), "text")
    return calls.unionByName(docs)


def extracted(s: SparkSession, d: str) -> DataFrame:
    return extract_fields(texts(s, d), text="text")


def candidates(s: SparkSession, d: str) -> DataFrame:
    return to_candidates(extracted(s, d))


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text: types that every engine prints the same way."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = tx.iso_date(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("int", "smallint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


@query("s1_customers", "SELECT * FROM t_customers")
def s1_customers(s, d):
    return ad.customers(s, d)


@query("s1_products", "SELECT product_id, name, category, CAST(price AS DOUBLE) AS price, sku FROM t_products")
def s1_products(s, d):
    return plain(ad.products(s, d))


@query("s1_orders", """SELECT order_id, customer_id, order_number, CAST(order_date AS VARCHAR) AS order_date, status,
       CAST(total AS DOUBLE) AS total, tracking_number FROM t_orders""")
def s1_orders(s, d):
    return plain(ad.orders(s, d))


@query("s1_order_items", "SELECT order_id, product_id, quantity, CAST(price AS DOUBLE) AS price FROM t_items")
def s1_order_items(s, d):
    return plain(ad.order_items(s, d))


@query("s1_cases", """SELECT case_id, case_number, customer_id, customer_name, product_id, product_name, case_type, status, priority, issue_description,
       resolution, CAST(opened_date AS VARCHAR) AS opened_date FROM t_cases""")
def s1_cases(s, d):
    return plain(ad.cases(s, d))


@query("s1_call_transcripts", f"""SELECT transcript_id, case_id, call_id, chunk_number, stream_type, transcript_text,
       round(audio_duration, 6) AS audio_duration, {STAMP.format('created_at')} AS created_at FROM t_turns""")
def s1_call_transcripts(s, d):
    return plain(ad.call_transcripts(s, d)).withColumn("audio_duration", F.round("audio_duration", 6))


@query("s1_candidate_values", "SELECT call_id, field_name, field_value FROM t_candidates")
def s1_candidate_values(s, d):
    return candidates(s, d)


@query("s2_segment_names", """
    SELECT conv_id, turn, CASE WHEN ok THEN 9999 END AS case_id, CASE WHEN ok THEN substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) END AS call_id,
           CASE WHEN ok THEN turn END AS chunk_number, CASE WHEN ok THEN 1700000000 + turn END AS epoch,
           CASE WHEN ok THEN CASE role WHEN 'user' THEN 'primary' ELSE 'secondary' END END AS stream_type,
           CASE WHEN NOT ok THEN 'unexpected file name' END AS error
    FROM (SELECT *, role <> 'system' AS ok FROM conversations)""")
def s2_segment_names(s, d):
    name = F.concat_ws("_", F.lit("9999"), shapes.shown_call_id(shapes.new_call_id("conv_id")), F.col("turn").cast("string"),
                       (F.lit(1700000000) + F.col("turn")).cast("string"),
                       F.when(F.col("role") == "user", "primary").otherwise("secondary"))
    listing = raw(s, d, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", "archive.mp3").otherwise(F.concat(name, F.lit(".mp3"))).alias("file_name"))
    return listing.select("conv_id", "turn", *shapes.segment_name("file_name"))


@query("s3_append_transcripts", """SELECT transcript_id, call_id, chunk_number, stream_type, transcript_text,
       round(audio_duration, 6) AS audio_duration FROM t_turns""")
def s3_append_transcripts(s, d):
    path = os.path.join(run_dir(s, "append"), "call_transcripts.parquet")
    turns = ad.turns(s, d)
    for role in ("system", "user", "agent"):
        sinks.append_transcripts(turns.filter(F.col("role") == role), path)
    return load(s, os.path.dirname(path), "call_transcripts").select(
        "transcript_id", "call_id", "chunk_number", "stream_type", "transcript_text",
        F.round("audio_duration", 6).alias("audio_duration"))


@query("s4_with_ids", """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, o_orderkey AS order_id,
       '2024-01-01 00:00:00.000000' AS created_at FROM orders""")
def s4_with_ids(s, d):
    rows = raw(s, d, "orders").select("o_orderdate", F.col("o_orderkey").alias("order_id"))
    numbered = keys.with_ids(rows, ["o_orderdate", "order_id"], now=F.lit(CREATED))
    return plain(numbered.drop("o_orderdate"))


@query("s5_resolve_keys", """
    SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
           CAST(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2))
                     ELSE CAST(p.p_retailprice AS DECIMAL(12,2)) END AS DOUBLE) AS price
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part p ON p_partkey = l_partkey""")
def s5_resolve_keys(s, d):
    return plain(keys.resolve_keys(ad.staged_items(s, d), ad.orders(s, d), ad.products(s, d)))


@query("s6_build_cases", """SELECT case_id, case_number, customer_id, customer_name, product_id, product_name, case_type,
       status, priority, md5(issue_description) AS issue_md5, resolution, CAST(opened_date AS VARCHAR) AS opened_date FROM t_cases""")
def s6_build_cases(s, d):
    built = ad.cases(s, d)
    return plain(built.withColumn("issue_md5", F.md5("issue_description")).drop("issue_description"))


@query("s7_reset_runtime", """SELECT call_id, chunk_number, transcript_text FROM t_turns t
    WHERE call_id NOT IN (SELECT call_id FROM t_turns WHERE role = 'system')""")
def s7_reset_runtime(s, d):
    turns = ad.turns(s, d)
    left = sinks.reset_runtime(turns, turns.filter(F.col("role") == "system").select("call_id"))
    return left.select("call_id", "chunk_number", "transcript_text")


@query("s7_reset_all", "SELECT call_id, chunk_number, transcript_text FROM t_turns WHERE false UNION ALL SELECT 'rows before', count(*), '' FROM t_turns")
def s7_reset_all(s, d):
    """The full reset leaves nothing; one row tells how many rows there were."""
    turns = ad.turns(s, d)
    before = turns.agg(F.count("*").alias("n")).select(F.lit("rows before").alias("call_id"), F.col("n").alias("chunk_number"), F.lit("").alias("transcript_text"))
    return sinks.reset_runtime(turns).select("call_id", "chunk_number", "transcript_text").unionByName(before)


@query("s8_events", """SELECT 'customer_match' AS type, CAST(conv_id AS VARCHAR) AS call_id, conv_id AS seq,
       concat('{"customer_id":', customer_id, ',"name":"', name, '","loyalty_tier":"', loyalty_tier, '"}') AS payload FROM t_intro""")
def s8_events(s, d):
    found = ad.introductions(s, d)
    return sinks.to_events(found, "customer_match", ["customer_id", "name", "loyalty_tier"], "conv_id", "conv_id").drop("ts")


@query("u2_all_events", """
    SELECT type, count(*) AS n FROM (
        SELECT 'customer_match' AS type FROM t_intro
        UNION ALL SELECT 'transcript_update' FROM t_turns
        UNION ALL SELECT type FROM t_events) GROUP BY type""")
def u2_all_events(s, d):
    found = sinks.to_events(ad.introductions(s, d), "customer_match", ["customer_id", "name"], "conv_id")
    turns = sinks.to_events(ad.turns(s, d), "transcript_update", ["chunk_number", "transcript_text"], seq="chunk_number")
    other = ad.call_events(s, d).select("type", "call_id", "seq", "ts", "payload")
    return sinks.all_events(found, turns, other).groupBy("type").agg(F.count("*").alias("n"))


@query("s9_read_chunks", "SELECT conv_id, turn, role, text FROM conversations")
def s9_read_chunks(s, d):
    return collect_stream(s, chunks.raw_stream(s, d, "conversations"), schemas.RAW["conversations"], "chunks").drop("batch_id")


RULE_SQL = """
    SELECT 'customers' AS table_name, 'name' AS column_name, 'not_null' AS rule, count(*) FILTER (WHERE name IS NULL) AS violations FROM t_customers
    UNION ALL SELECT 'orders', 'status', 'domain', count(*) FILTER (WHERE status NOT IN ('PENDING', 'PROCESSING', 'SHIPPED', 'DELIVERED')) FROM t_orders
    UNION ALL SELECT 'cases', 'issue_description', 'max_length_2000', count(*) FILTER (WHERE length(issue_description) > 2000) FROM t_cases
    UNION ALL SELECT 'orders', 'order_id', 'unique', count(*) FROM (SELECT order_id FROM t_orders GROUP BY order_id HAVING count(*) > 1)
    UNION ALL SELECT 'order_items', 'order_id+product_id', 'unique', count(*) FROM (
        SELECT order_id, product_id FROM t_items GROUP BY order_id, product_id HAVING count(*) > 1)
    UNION ALL SELECT 'order_items', 'product_id', 'references_products', count(*) FROM t_items
        WHERE product_id NOT IN (SELECT product_id FROM t_products)
    UNION ALL SELECT 'cases', 'case_id', 'references_labels', count(*) FROM t_cases WHERE case_id NOT IN (SELECT doc_id FROM labels)"""


@query("q1_check_constraints", RULE_SQL)
def q1_check_constraints(s, d):
    tables = {
        "customers": ad.customers(s, d), "orders": ad.orders(s, d), "order_items": ad.order_items(s, d),
        "cases": ad.cases(s, d), "products": ad.products(s, d), "labels": raw(s, d, "labels"),
    }
    rules = (
        checks.NotNull("customers", "name"),
        checks.Domain("orders", "status", schemas.DOMAINS[("orders", "status")]),
        checks.MaxLength("cases", "issue_description", 2000),
        checks.Unique("orders", ("order_id",)), checks.Unique("order_items", ("order_id", "product_id")),
        checks.Reference("order_items", "product_id", "products", "product_id"),
        checks.Reference("cases", "case_id", "labels", "doc_id"),
    )
    return checks.check_constraints(tables, rules)


SHIPPED_SQL = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'not_null' AS rule, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {v}" for t, v, c in (
        ("customers", "t_customers", "customer_id"), ("customers", "t_customers", "name"), ("products", "t_products", "product_id"),
        ("products", "t_products", "name"), ("orders", "t_orders", "order_id"), ("orders", "t_orders", "customer_id"),
        ("orders", "t_orders", "order_number"), ("order_items", "t_items", "order_id"), ("order_items", "t_items", "product_id"),
        ("cases", "t_cases", "case_id"), ("cases", "t_cases", "case_number"))]
    + [f"SELECT '{t}', '{c}', 'max_length_{n}', count(*) FILTER (WHERE length({c}) > {n}) FROM t_{t}" for t, c, n in (
        ("customers", "name", 200), ("customers", "email", 200), ("customers", "phone", 20), ("products", "name", 200), ("products", "sku", 50),
        ("orders", "order_number", 50), ("cases", "issue_description", 2000), ("cases", "resolution", 2000))]
    + [f"SELECT '{t}', '{c}', 'domain', count(*) FILTER (WHERE {c} NOT IN ({v})) FROM t_{t}" for t, c, v in (
        ("customers", "loyalty_tier", "'PLATINUM', 'GOLD', 'SILVER'"), ("orders", "status", "'PENDING', 'PROCESSING', 'SHIPPED', 'DELIVERED'"),
        ("cases", "case_type", "'DEFECT', 'RETURN', 'INQUIRY'"), ("cases", "status", "'OPEN', 'CLOSED'"),
        ("cases", "priority", "'CRITICAL', 'HIGH', 'MEDIUM', 'LOW'"))]
    + [f"SELECT '{t}', '{c}', 'unique', count(*) FROM (SELECT {c} FROM t_{t} GROUP BY {c} HAVING count(*) > 1)" for t, c in (
        ("customers", "customer_id"), ("products", "product_id"), ("orders", "order_id"), ("cases", "case_id"))]
    + [f"SELECT '{t}', '{c}', 'references_{p}', count(*) FROM t_{v} WHERE {c} NOT IN (SELECT {c} FROM t_{p})" for t, v, c, p in (
        ("orders", "orders", "customer_id", "customers"), ("order_items", "items", "order_id", "orders"), ("order_items", "items", "product_id", "products"))])


@query("q1_shipped_rules", SHIPPED_SQL)
def q1_shipped_rules(s, d):
    return checks.check_constraints({
        "customers": ad.customers(s, d), "orders": ad.orders(s, d), "order_items": ad.order_items(s, d), "cases": ad.cases(s, d),
        "products": ad.products(s, d)})


@query("q2_row_counts", """
    SELECT * FROM (SELECT 'customers' AS table_name, count(*) AS row_count FROM customer
    UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders
    UNION ALL SELECT 'order_items', count(*) FROM lineitem UNION ALL SELECT 'cases', count(*) FROM documents) ORDER BY 1""")
def q2_row_counts(s, d):
    return checks.row_counts({
        "customers": raw(s, d, "customer"), "products": raw(s, d, "part"), "orders": raw(s, d, "orders"),
        "order_items": raw(s, d, "lineitem"), "cases": raw(s, d, "documents"),
    })


@query("p1_search_customers", """
    SELECT customer_id, name, email, phone, loyalty_tier FROM t_customers
    WHERE lower(name) LIKE '%omer#00000001%' OR phone LIKE '%omer#00000001%' OR lower(email) LIKE '%omer#00000001%'
    ORDER BY customer_id LIMIT 5""")
def p1_search_customers(s, d):
    from callweave.operators.customers import search_customers
    return search_customers(ad.customers(s, d), "OMER#00000001").drop("address")


@query("p1_search_customers_like", """
    SELECT customer_id, name, email, phone, loyalty_tier FROM t_customers
    WHERE lower(name) LIKE '%0_1%2%' OR phone LIKE '%0_1%2%' OR lower(email) LIKE '%0_1%2%' ORDER BY customer_id LIMIT 5""")
def p1_search_customers_like(s, d):
    from callweave.operators.customers import search_customers
    return search_customers(ad.customers(s, d), "0_1%2", mode="like").drop("address")


VALUES_SQL = """CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'None' WHEN 4 THEN 'NULL'
    WHEN 5 THEN 'n/a' WHEN 6 THEN ' none ' ELSE source END"""


def _values(s, d):
    return raw(s, d, "documents").select("doc_id", F.expr(VALUES_SQL).alias("value"))


@query("p2_is_value", f"""SELECT doc_id, value FROM (SELECT doc_id, {VALUES_SQL} AS value FROM documents)
    WHERE value IS NOT NULL AND {strip('value')} <> '' AND lower(value) NOT IN ('none', 'null', 'n/a', '')""")
def p2_is_value(s, d):
    return _values(s, d).filter(tx.is_value("value"))


@query("p3_gate_display", f"""
    SELECT doc_id, coalesce(lower(value) NOT IN ('none', 'null', 'n/a', ''), FALSE) AS passes,
           CASE WHEN value IS NULL OR lower(value) IN ('none', 'null', 'n/a') THEN '' ELSE value END AS shown
    FROM (SELECT doc_id, {VALUES_SQL} AS value FROM documents)""")
def p3_gate_display(s, d):
    return _values(s, d).select("doc_id", tx.gate("value").alias("passes"), tx.display("value").alias("shown"))


@query("p4_for_keys", """SELECT order_id, customer_id, order_number FROM t_orders
    WHERE customer_id IN (SELECT customer_id FROM t_intro)""")
def p4_for_keys(s, d):
    asked = ad.introductions(s, d).select("customer_id")
    return keys.for_keys(ad.orders(s, d), asked, "customer_id").select("order_id", "customer_id", "order_number")


@query("p5_long_enough", f"""SELECT call_id, chunk_number, length({strip('transcript_text')}) >= 20 AS enriches,
    length({strip('transcript_text')}) >= 5 AS labels FROM t_turns""")
def p5_long_enough(s, d):
    return ad.turns(s, d).select("call_id", "chunk_number", tx.long_enough("transcript_text", 20).alias("enriches"),
                                 tx.long_enough("transcript_text", 5).alias("labels"))


@query("p6_normalise", "SELECT order_id, CAST(order_date AS VARCHAR) AS order_date, CAST(coalesce(total, 0) AS DOUBLE) AS total FROM t_orders")
def p6_normalise(s, d):
    return od.normalise_orders(ad.orders(s, d)).select("order_id", "order_date", "total")


@query("p7_speaker", """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'agent' ELSE 'caller' END AS speaker FROM conversations""")
def p7_speaker(s, d):
    return ad.turns(s, d).select(F.col("call_id").cast("bigint").alias("conv_id"), F.col("chunk_number").alias("turn"),
                                 tx.speaker("role").alias("speaker"))


@query("p8_norm_recs", """
    SELECT doc_id, source AS action, lower(coalesce(CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Low' END, 'medium')) AS confidence,
           CASE doc_id % 4 WHEN 0 THEN 'refund' WHEN 1 THEN 'replace' WHEN 2 THEN 'credit' ELSE 'replace' END AS icon FROM documents""")
def p8_norm_recs(s, d):
    raw_json = F.to_json(F.struct(F.array(F.struct(
        F.col("source").alias("action"), F.lit("d").alias("description"), F.lit("r").alias("reasoning"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Low' END").alias("confidence"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'Refund' WHEN 1 THEN 'magic' WHEN 2 THEN 'CREDIT' END").alias("icon"),
    )).alias("recommendations")))
    docs = raw(s, d, "documents").select("doc_id", raw_json.alias("j"))
    recs = shapes.norm_recs(shapes.parse_json("j", schemas.RECOMMENDATIONS_DDL)["recommendations"])
    return docs.select("doc_id", F.inline(recs)).select("doc_id", "action", "confidence", "icon")


@query("p10_call_summary", """
    SELECT call_id, label, value FROM (
        SELECT call_id, unnest(['Customer', 'Phone', 'Email', 'Product', 'Issue', 'Order #', 'Resolution', 'Return Reason']) AS label,
               unnest([customer_name, customer_phone, customer_email, product_name, issue_description, order_number,
                       resolution_requested, return_reason]) AS value FROM t_extracted)
    WHERE value IS NOT NULL AND value <> '' AND lower(value) NOT IN ('none', 'null', 'n/a')""")
def p10_call_summary(s, d):
    summaries = extracted(s, d).select("call_id", shapes.call_summary().alias("summary"))
    return summaries.filter(F.col("summary").isNotNull()).select("call_id", F.inline("summary"))


_shown = lambda f: f"CASE WHEN {f} IS NULL OR lower({f}) IN ('none', 'null', 'n/a') THEN '' ELSE {f} END"


@query("p11_call_form", "SELECT call_id, " + ", ".join(f"{_shown(f)} AS {f}" for f in schemas.FIELDS)
       + f", CASE WHEN {_shown('return_reason')} = '' THEN 'Product Issue' ELSE return_reason END AS call_reason, 'Medium' AS priority FROM t_extracted")
def p11_call_form(s, d):
    return extracted(s, d).select("call_id", *shapes.call_form())


@query("p12_labels", """
    SELECT order_id, i.product_id, array_to_string(list_transform(string_split(name, ' '), lambda x: x[1]), '') AS initials,
           replace(replace(name, ' ', '_'), '_', ' ') AS label, concat(quantity, 'x ', name) AS item,
           CAST(CAST(i.price AS DECIMAL(20,2)) AS VARCHAR) AS shown_price
    FROM t_items i JOIN t_products p ON p.product_id = i.product_id""")
def p12_labels(s, d):
    lines = od.items_with_products(ad.order_items(s, d), ad.products(s, d))
    return lines.select("order_id", "product_id", shapes.initials("product_name").alias("initials"),
                        shapes.field_label(F.replace("product_name", F.lit(" "), F.lit("_"))).alias("label"),
                        shapes.item_label("quantity", "product_name").alias("item"), shapes.money("price").alias("shown_price"))


@query("p13_head", "SELECT doc_id, length(left(text, 2000)) AS n, md5(left(text, 2000)) AS h FROM documents")
def p13_head(s, d):
    first = tx.head("text", 2000)
    return raw(s, d, "documents").select("doc_id", F.length(first).cast("bigint").alias("n"), F.md5(first).alias("h"))


@query("p14_new_call_id", """SELECT conv_id, turn, md5(CAST(conv_id AS VARCHAR)) AS call_id,
    substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS shown_id FROM conversations""")
def p14_new_call_id(s, d):
    ids = raw(s, d, "conversations").select("conv_id", "turn", shapes.new_call_id("conv_id").alias("call_id"))
    return ids.withColumn("shown_id", shapes.shown_call_id("call_id"))


@query("j1_items_with_products", """SELECT order_id, i.product_id, name AS product_name, quantity, CAST(i.price AS DOUBLE) AS price
    FROM t_items i JOIN t_products p ON p.product_id = i.product_id""")
def j1_items_with_products(s, d):
    return plain(od.items_with_products(ad.order_items(s, d), ad.products(s, d)))


@query("j2_purchases", "SELECT * FROM t_purchases")
def j2_purchases(s, d):
    return plain(od.purchases(ad.order_items(s, d), ad.products(s, d), ad.orders(s, d)))


@query("j3_order_history", """
    SELECT o.customer_id, o.order_id, o.order_number, CAST(o.order_date AS VARCHAR) AS order_date, o.status,
           CAST(o.total AS DOUBLE) AS total, o.tracking_number, i.name AS product_name, i.quantity, CAST(i.price AS DOUBLE) AS price
    FROM t_orders o LEFT JOIN (SELECT t.order_id, p.name, t.quantity, t.price FROM t_items t JOIN t_products p
                               ON p.product_id = t.product_id) i ON i.order_id = o.order_id""")
def j3_order_history(s, d):
    history = od.order_history(ad.orders(s, d), ad.order_items(s, d), ad.products(s, d))
    return history.select("customer_id", "order_id", "order_number", "order_date", "status", "total", "tracking_number",
                          F.explode_outer("items").alias("i")).select(
        "customer_id", "order_id", "order_number", "order_date", "status", "total", "tracking_number", "i.*")


def customer_orders(s: SparkSession, d: str) -> DataFrame:
    """The customers a search finds, with their orders and lines, newest order first."""
    from callweave.operators.customers import search_customers
    found = search_customers(ad.customers(s, d), "customer#00000001")
    history = od.order_history(ad.orders(s, d), ad.order_items(s, d), ad.products(s, d), customers=found)
    return found.select("customer_id", "name", "loyalty_tier").join(history, "customer_id").orderBy(
        "customer_id", *od.newest_first())


@query("j3_customer_search_orders", """
    SELECT c.customer_id, c.name, c.loyalty_tier, o.order_id, CAST(o.order_date AS VARCHAR) AS order_date,
           CAST(o.total AS DOUBLE) AS total, count(p.product_id) AS lines, coalesce(sum(CASE WHEN p.product_id IS NOT NULL THEN i.quantity END), 0)::BIGINT AS pieces
    FROM (SELECT * FROM t_customers WHERE lower(name) LIKE '%customer#00000001%' ORDER BY customer_id LIMIT 5) c
    JOIN t_orders o ON o.customer_id = c.customer_id LEFT JOIN t_items i ON i.order_id = o.order_id
    LEFT JOIN t_products p ON p.product_id = i.product_id GROUP BY ALL""")
def j3_customer_search_orders(s, d):
    add = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, i: a + i["quantity"])
    return customer_orders(s, d).select("customer_id", "name", "loyalty_tier", "order_id", "order_date", "total",
                                        F.size("items").cast("bigint").alias("lines"), add.alias("pieces"))


@query("w3_recent_orders", """
    SELECT customer_id, order_id, CAST(order_date AS VARCHAR) AS order_date, position FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY order_date DESC NULLS FIRST, order_id) AS position FROM t_orders)
    WHERE position <= 4""")
def w3_recent_orders(s, d):
    return plain(od.recent_orders(ad.orders(s, d)).select("customer_id", "order_id", "order_date", "position"))


@query("f3_parse_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f3_parse_json(s, d):
    return raw(s, d, "events").select("event_id", shapes.parse_json("props", "struct<k: bigint>")["k"].alias("k"))


@query("f3_parse_extraction", """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE source END AS customer_name,
       CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS product_name FROM documents""")
def f3_parse_extraction(s, d):
    fields = F.struct(F.col("source").alias("customer_name"), F.col("lang").alias("product_name"))
    j = (F.when(F.col("doc_id") % 3 == 0, F.to_json(fields))
         .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(fields.alias("response")))).otherwise("{broken"))
    parsed = raw(s, d, "documents").select("doc_id", shapes.parse_extraction(j).alias("x"))
    return parsed.select("doc_id", "x.customer_name", "x.product_name")
