"""Derived tables in SQL, as the oracles use them; the Spark side builds its own in ``sources.adapters``."""

from __future__ import annotations

from callweave import schemas
from callweave.operators.extraction import PATTERNS, PHONE_LEAD
from callweave.plans.registry import cte
from callweave.sources.adapters import CASE_TYPES, PRIORITIES, RESOLUTIONS, TIERS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def extract(column: str, field: str) -> str:
    hit = f"regexp_extract({column}, {text(PATTERNS[field])}, 1)"
    if field == "customer_phone":
        hit = f"replace({hit}, {text(PHONE_LEAD)}, '')"
    return f"nullif({hit}, '')"


def strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

cte("t_customers", f"""
    SELECT c_custkey AS customer_id, c_name AS name, concat('c', c_custkey, '@example.com') AS email,
           lpad(CAST(c_custkey AS VARCHAR), 10, '5') AS phone, {array(TIERS)}[c_custkey % 3 + 1] AS loyalty_tier,
           CAST(NULL AS VARCHAR) AS address
    FROM customer""")
cte("t_products", """
    SELECT p_partkey AS product_id, p_name AS name, p_type AS category, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
           concat(p_brand, '-', p_partkey) AS sku
    FROM part""")
cte("t_orders", """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, concat('ORD-', o_orderkey) AS order_number,
           CAST(o_orderdate AS DATE) AS order_date,
           CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'SHIPPED' WHEN 'P' THEN 'PENDING' END AS status,
           CAST(o_totalprice AS DECIMAL(12,2)) AS total,
           CASE WHEN o_orderstatus <> 'P' THEN concat('TRK-', o_orderkey) END AS tracking_number
    FROM orders""")
cte("t_items", """
    SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
           CAST(l_extendedprice AS DECIMAL(12,2)) AS price
    FROM lineitem""")
cte("t_cases", f"""
    SELECT d.doc_id AS case_id, concat('CASE-', d.doc_id) AS case_number, c.customer_id, c.name AS customer_name,
           p.product_id, concat(p.name, ' (', p.sku, ')') AS product_name,
           {array(CASE_TYPES)}[d.doc_id % 3 + 1] AS case_type,
           CASE WHEN l.quality = 1 THEN 'CLOSED' ELSE 'OPEN' END AS status,
           {array(PRIORITIES)}[d.doc_id % 4 + 1] AS priority, d.text AS issue_description,
           CASE WHEN l.quality = 1 THEN {array(RESOLUTIONS)}[d.doc_id % 8 + 1] END AS resolution,
           DATE '2024-01-01' + CAST(d.doc_id % 90 AS INTEGER) AS opened_date
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    JOIN orders o ON o.o_orderkey = d.doc_id JOIN t_customers c ON c.customer_id = o.o_custkey
    JOIN t_products p ON p.product_id = d.doc_id""")
cte("t_turns", """
    SELECT conv_id * 1048576 + turn AS transcript_id, CAST(NULL AS BIGINT) AS case_id, CAST(conv_id AS VARCHAR) AS call_id,
           turn AS chunk_number, 'simulated' AS stream_type, text AS transcript_text, length(text) / 15.0 AS audio_duration,
           TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 SECOND AS created_at,
           CASE WHEN role = 'assistant' THEN 'agent' ELSE role END AS role
    FROM conversations""")
cte("t_intro", """
    SELECT f.conv_id, o.o_custkey AS customer_id, c.name, c.email, c.phone, c.loyalty_tier, p.name AS product, f.issue,
           concat('Hello, my name is ', c.name, '. My email is ', c.email, ' and my phone is ', c.phone, '.',
                  CASE WHEN p.name IS NOT NULL
                       THEN concat(' I am calling about my ', p.name, ', order ORD-', f.conv_id, '.') ELSE '' END,
                  ' The problem is that ', f.issue, ' I would like a refund.') AS text
    FROM (SELECT conv_id, arg_min(text, turn) AS issue FROM conversations WHERE role = 'user' GROUP BY conv_id) f
    JOIN orders o ON o.o_orderkey = f.conv_id JOIN t_customers c ON c.customer_id = o.o_custkey
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS product_id FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = f.conv_id
    LEFT JOIN t_products p ON p.product_id = l.product_id""")
cte("t_chunks", """
    SELECT CAST(conv_id AS VARCHAR) AS call_id, 0 AS chunk_number, text AS transcript_text, 'user' AS role FROM t_intro
    UNION ALL
    SELECT call_id, chunk_number + 1, transcript_text, role FROM t_turns""")
cte("t_texts", """
    SELECT concat('call-', conv_id) AS call_id, text FROM t_intro
    UNION ALL SELECT concat('doc-', doc_id), text FROM documents""")
cte("t_extracted", "SELECT call_id, " + ", ".join(f"{extract('text', f)} AS {f}" for f in schemas.FIELDS) + " FROM t_texts")
cte("t_candidates", f"""
    SELECT call_id, field_name, field_value FROM (
        UNPIVOT t_extracted ON {', '.join(schemas.FIELDS)} INTO NAME field_name VALUE field_value)
    WHERE {strip('field_value')} <> '' AND lower(field_value) NOT IN ('none', 'null', 'n/a', '')""")
cte("t_events", """
    SELECT concat(user_id, '-', strftime(ts, '%Y%m%d')) AS call_id, user_id AS session_id, event_id AS seq, ts,
           CASE event_type WHEN 'signup' THEN 'call_started' WHEN 'view' THEN 'transcript_update'
                WHEN 'click' THEN 'extraction_update' WHEN 'purchase' THEN 'customer_match'
                WHEN 'error' THEN 'call_ended' END AS type,
           props AS payload, value
    FROM events""")


def similarity(left: str, right: str, threshold: float) -> str:
    """Pairs of distinct texts with TF-IDF cosine above the threshold, by scoring every pair that shares a token.
    ``left`` and ``right`` are queries with one column ``text``. Texts and tokens are numbered first, so that the join and
    the sums work on numbers; texts are looked up at the end."""
    return f"""
    WITH sl AS MATERIALIZED (SELECT text, CAST(row_number() OVER () AS INTEGER) AS id FROM (SELECT DISTINCT text FROM ({left}) q WHERE text IS NOT NULL)),
    sr AS MATERIALIZED (SELECT text, CAST(row_number() OVER () AS INTEGER) AS id FROM (SELECT DISTINCT text FROM ({right}) q WHERE text IS NOT NULL)),
    cl AS MATERIALIZED (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS token FROM sl) GROUP BY id, token),
    cr AS MATERIALIZED (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS token FROM sr) GROUP BY id, token),
    td AS MATERIALIZED (SELECT token, sum(r) AS df, CAST(row_number() OVER () AS INTEGER) AS t FROM (
        SELECT token, 1 AS r FROM cr UNION ALL SELECT token, 0 FROM cl) GROUP BY token),
    wl AS MATERIALIZED (SELECT id, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (
        SELECT c.id, d.t, c.tf * (ln((1 + (SELECT count(*) FROM sr)) / (1.0 + d.df)) + 1) AS w FROM cl c JOIN td d ON d.token = c.token)),
    wr AS MATERIALIZED (SELECT id, t, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (
        SELECT c.id, d.t, c.tf * (ln((1 + (SELECT count(*) FROM sr)) / (1.0 + d.df)) + 1) AS w FROM cr c JOIN td d ON d.token = c.token)),
    sp AS MATERIALIZED (SELECT l.id AS l, r.id AS r, round(sum(l.w * r.w), 9) AS score FROM wl l JOIN wr r ON l.t = r.t
        GROUP BY l.id, r.id HAVING round(sum(l.w * r.w), 9) > {threshold})
    SELECT sl.text AS left_text, sr.text AS right_text, score FROM sp JOIN sl ON sl.id = sp.l JOIN sr ON sr.id = sp.r"""


cte("t_mentions", """
    SELECT o.o_orderkey AS call_id, o.o_custkey AS customer_id,
           concat(split_part(min(p.p_name), ' ', 1), ' ', split_part(max(p.p_name), ' ', 2)) AS mention
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
    GROUP BY o.o_orderkey, o.o_custkey""")
cte("t_purchases", """
    SELECT o.customer_id, p.product_id, p.name AS product_name, p.category, CAST(p.price AS DOUBLE) AS price, p.sku,
           i.quantity, o.order_id, o.order_number, o.status AS order_status, CAST(o.order_date AS VARCHAR) AS order_date,
           o.tracking_number
    FROM t_items i JOIN t_products p ON p.product_id = i.product_id JOIN t_orders o ON o.order_id = i.order_id""")
cte("t_name_scores", similarity("SELECT mention AS text FROM t_mentions", "SELECT p_name AS text FROM part", 0.3))
cte("t_issue_scores", similarity("SELECT text FROM documents", "SELECT issue_description AS text FROM t_cases", 0.4))
cte("t_similar", """
    SELECT d.doc_id AS call_id, s.position, s.case_number, s.customer_name, s.product_name, s.case_type, s.status,
           s.priority, s.resolution, s.opened_date, s.score AS match_score
    FROM documents d JOIN (
        SELECT p.left_text, p.score, c.*,
               row_number() OVER (PARTITION BY p.left_text ORDER BY p.score DESC, c.case_number) AS position
        FROM t_issue_scores p JOIN t_cases c ON c.issue_description = p.right_text) s ON s.left_text = d.text
    WHERE s.position <= 10""")
cte("t_vec_scores", """
    SELECT a.vec_id AS left_id, b.vec_id AS right_id,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings a CROSS JOIN embeddings b""")
