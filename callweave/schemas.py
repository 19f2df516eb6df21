"""Explicit schemas: the seven tables, nested shapes and the driver's raw tables."""

from __future__ import annotations

# Table columns, fields and domains of the data model.
TABLES: dict[str, str] = {
    "customers": "customer_id bigint, name string, email string, phone string, loyalty_tier string, address string",
    "products": "product_id bigint, name string, category string, price decimal(10,2), sku string",
    "orders": "order_id bigint, customer_id bigint, order_number string, order_date date, status string, "
              "total decimal(12,2), tracking_number string",
    "order_items": "order_id bigint, product_id bigint, quantity bigint, price decimal(12,2)",
    "cases": "case_id bigint, case_number string, customer_id bigint, customer_name string, product_id bigint, "
             "product_name string, case_type string, status string, priority string, issue_description string, "
             "resolution string, opened_date date",
    "call_transcripts": "transcript_id bigint, case_id bigint, call_id string, chunk_number bigint, "
                        "stream_type string, transcript_text string, audio_duration double, "
                        "created_at timestamp_ntz",
    "call_candidate_values": "id bigint, case_id bigint, call_id string, field_name string, field_value string, "
                             "created_at timestamp_ntz",
}

RAW: dict[str, str] = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

FIELDS: tuple[str, ...] = (
    "customer_name", "customer_phone", "customer_email", "order_number", "product_name", "issue_description",
    "resolution_requested", "shipping_address", "return_reason",
)

EXTRACTION = ", ".join(f"{f}: string" for f in FIELDS)
EXTRACTION_DDL = f"struct<{EXTRACTION}, response: struct<{EXTRACTION}>>"
SEGMENTS_DDL = "struct<segments: array<struct<speaker: string, text: string>>>"
TRANSCRIPTION_DDL = "struct<text: string, audio_duration: double>"
RECOMMENDATION = "action: string, description: string, reasoning: string, confidence: string, icon: string"
RECOMMENDATIONS_DDL = f"struct<recommendations: array<struct<{RECOMMENDATION}>>>"
RECOMMENDATION_LIST = "array<struct<action string, description string, reasoning string, confidence string, icon string>>"

EVENT_TYPES: tuple[str, ...] = (
    "call_started", "transcript_update", "extraction_update", "customer_match", "product_match", "similar_cases",
    "recommendations", "playback_started", "audio_progress", "playback_ended", "call_ended", "app_reset",
)

DOMAINS: dict[tuple[str, str], tuple[str, ...]] = {
    ("customers", "loyalty_tier"): ("PLATINUM", "GOLD", "SILVER"),
    ("orders", "status"): ("PENDING", "PROCESSING", "SHIPPED", "DELIVERED"),
    ("cases", "case_type"): ("DEFECT", "RETURN", "INQUIRY"),
    ("cases", "status"): ("OPEN", "CLOSED"),
    ("cases", "priority"): ("CRITICAL", "HIGH", "MEDIUM", "LOW"),
}
