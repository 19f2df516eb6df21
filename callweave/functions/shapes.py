"""Nested shapes, labels and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from callweave import schemas
from callweave.functions.text import col, display, missing, speaker

# Icon categories, score bands and the labelled summary fields in their order.
ICONS: tuple[str, ...] = ("refund", "replace", "upgrade", "discount", "escalate", "repair", "credit", "exchange")
BANDS: dict[str, tuple[float, float]] = {"product": (0.7, 0.5), "case": (0.6, 0.45)}
SUMMARY_FIELDS: tuple[tuple[str, str], ...] = (
    ("Customer", "customer_name"), ("Phone", "customer_phone"), ("Email", "customer_email"),
    ("Product", "product_name"), ("Issue", "issue_description"), ("Order #", "order_number"),
    ("Resolution", "resolution_requested"), ("Return Reason", "return_reason"),
)
DEFAULT_REASON = "Product Issue"
FORM_PRIORITY = "Medium"

SEGMENT_NAME = r"^([^_]+)_([^_]+)_(\d+)_(\d+)_([A-Za-z]+)\.mp3$"


def parse_json(c: Column | str, ddl: str, unwrap: str | None = None) -> Column:
    """JSON text as a struct; bad JSON gives NULL fields. ``unwrap`` names an optional wrapping object."""
    parsed = F.from_json(col(c), ddl)
    return F.coalesce(parsed[unwrap], parsed) if unwrap else parsed


def parse_extraction(c: Column | str) -> Column:
    """The nine extracted fields from model JSON, wrapped in ``response`` or not."""
    parsed = F.from_json(col(c), schemas.EXTRACTION_DDL)
    return F.struct(*[
        F.when(parsed["response"].isNotNull(), parsed["response"][f]).otherwise(parsed[f]).alias(f)
        for f in schemas.FIELDS
    ])


def segments(text: Column | str, json_col: Column | str) -> Column:
    """Speaker segments of a chunk; an empty or failed labelling leaves one caller segment with the whole text."""
    found = F.from_json(col(json_col), schemas.SEGMENTS_DDL)["segments"]
    labelled = F.transform(found, lambda s: F.struct(speaker(s["speaker"]).alias("speaker"), s["text"].alias("text")))
    whole = F.array(F.struct(F.lit("caller").alias("speaker"), col(text).alias("text")))
    return F.when(F.size(labelled) > 0, labelled).otherwise(whole)


def norm_recs(c: Column | str) -> Column:
    """Recommendations with a lower-case confidence (default medium) and a known icon (default replace)."""
    def fix(r: Column) -> Column:
        icon = F.lower(r["icon"])
        return F.struct(
            r["action"].alias("action"), r["description"].alias("description"), r["reasoning"].alias("reasoning"),
            F.lower(F.coalesce(r["confidence"], F.lit("medium"))).alias("confidence"),
            F.when(icon.isin(*ICONS), icon).otherwise("replace").alias("icon"),
        )
    return F.transform(F.coalesce(col(c), F.array().cast(schemas.RECOMMENDATION_LIST)), fix)


def score_band(c: Column | str, kind: str) -> Column:
    """high / medium / low by the strict limits of a product or a case match."""
    high, medium = BANDS[kind]
    return F.when(col(c) > high, "high").when(col(c) > medium, "medium").otherwise("low")


def score_pct(c: Column | str) -> Column:
    """Percent, halves rounded up."""
    return F.floor(col(c) * 100 + 0.5)


def call_summary(fields: Column | str | None = None) -> Column:
    """Labelled non-empty fields in fixed order; NULL where all are empty."""
    get = (lambda f: F.col(f)) if fields is None else (lambda f: col(fields)[f])
    entries = F.filter(
        F.array(*[F.struct(F.lit(label).alias("label"), display(get(f)).alias("value")) for label, f in SUMMARY_FIELDS]),
        lambda e: e["value"] != "",
    )
    return F.when(F.size(entries) > 0, entries)


def call_form(fields: Column | str | None = None) -> list[Column]:
    """The call form: nine shown fields plus reason and priority."""
    get = (lambda f: F.col(f)) if fields is None else (lambda f: col(fields)[f])
    reason = display(get("return_reason"))
    return [
        *[display(get(f)).alias(f) for f in schemas.FIELDS],
        F.when(reason == "", DEFAULT_REASON).otherwise(reason).alias("call_reason"),
        F.lit(FORM_PRIORITY).alias("priority"),
    ]


def field_label(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("_"), F.lit(" "))


def initials(c: Column | str) -> Column:
    """First letters of the blank-separated parts of a name; ``?`` without a name."""
    letters = F.array_join(F.transform(F.split(col(c), " "), lambda p: F.substring(p, 1, 1)), "")
    return F.when(missing(c), "?").otherwise(letters)


def item_label(quantity: Column | str, name: Column | str) -> Column:
    return F.concat(col(quantity).cast("string"), F.lit("x "), col(name))


def money(c: Column | str) -> Column:
    """Two decimals, no thousands separators."""
    return F.col(c).cast("decimal(20,2)").cast("string") if isinstance(c, str) else c.cast("decimal(20,2)").cast("string")


def segment_order(c: Column | str) -> tuple[Column, Column]:
    """``"chunk.sub"`` as two numbers, so that 10.0 sorts after 9.1; a missing sub is 0."""
    parts = F.split(col(c), r"\.")
    return F.try_element_at(parts, F.lit(1)).cast("bigint"), F.coalesce(
        F.try_element_at(parts, F.lit(2)).cast("bigint"), F.lit(0).cast("bigint"))


def new_call_id(key: Column | str) -> Column:
    """A call id from the source key, the same on every run: the whole hash, so calls are not merged."""
    return F.md5(col(key).cast("string"))


def shown_call_id(call_id: Column | str) -> Column:
    """The eight signs that are shown of a call id. They are no key."""
    return F.substring(col(call_id), 1, 8)


def segment_name(c: Column | str) -> list[Column]:
    """Columns of a segment file name ``case_call_chunk_epoch_label.mp3``; all NULL and an error for other names."""
    c = col(c)
    ok = F.regexp_like(c, F.lit(SEGMENT_NAME))
    part = lambda i: F.when(ok, F.regexp_extract(c, SEGMENT_NAME, i))
    return [
        part(1).cast("bigint").alias("case_id"), part(2).alias("call_id"), part(3).cast("bigint").alias("chunk_number"),
        part(4).cast("bigint").alias("epoch"), part(5).alias("stream_type"),
        F.when(~ok, "unexpected file name").alias("error"),
    ]


