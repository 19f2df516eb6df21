"""The conversation tables derived from the raw star-schema tables.

Each function is a lazy projection or an equi-join on keys, so its work grows with its tables and unused
columns are pruned at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from callweave.sources.tables import raw

# The derived domains, in the order of the key's remainder.
TIERS = ("PLATINUM", "GOLD", "SILVER")
CASE_TYPES = ("DEFECT", "RETURN", "INQUIRY")
PRIORITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STATUS = {"F": "DELIVERED", "O": "SHIPPED", "P": "PENDING"}
RESOLUTIONS = (
    "Full refund issued to the original payment method.",
    "Replacement sent by express shipping.",
    "Upgraded to the newer model at no charge.",
    "Discount of twenty percent applied to the next order.",
    "Escalated to the engineering team.",
    "Repair arranged at the service center.",
    "Store credit added to the account.",
    "Exchange for another size completed.",
)
MESSAGE_TYPES = {
    "signup": "call_started", "view": "transcript_update", "click": "extraction_update",
    "purchase": "customer_match", "error": "call_ended",
}


def _pick(values: tuple[str, ...], key: str):
    chosen = F.array(*[F.lit(v) for v in values])
    return F.element_at(chosen, (F.col(key) % len(values) + 1).cast("int"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "5").alias("phone"),
        _pick(TIERS, "c_custkey").alias("loyalty_tier"),
        F.lit(None).cast("string").alias("address"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("sku"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    name = F.when(status == "F", STATUS["F"]).when(status == "O", STATUS["O"]).when(status == "P", STATUS["P"])
    key = F.col("o_orderkey").cast("string")
    return raw(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("ORD-"), key).alias("order_number"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        name.alias("status"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.when(status != "P", F.concat(F.lit("TRK-"), key)).alias("tracking_number"),
    )


def order_items(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
    )


def staged_items(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as they arrive: business keys instead of ids, no price on returned lines."""
    lines = raw(spark, d, "lineitem").join(
        products(spark, d).select("product_id", "sku"), F.col("l_partkey") == F.col("product_id"))
    return lines.select(
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("order_number"),
        "sku",
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast("decimal(12,2)")).alias("price"),
    )


def staged_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases as they arrive: customer by name, product by sku. A document takes the customer of the order and
    the product of the part that carry its number."""
    labels = raw(spark, d, "labels").select("doc_id", "quality")
    order = raw(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c_custkey"))
    names = raw(spark, d, "customer").select("c_custkey", F.col("c_name").alias("customer_name"))
    part = products(spark, d).select(F.col("product_id").alias("doc_id"), "sku")
    closed = F.coalesce(F.col("quality") == 1, F.lit(False))
    docs = raw(spark, d, "documents").select("doc_id", "text")
    joined = docs.join(labels, "doc_id", "left").join(order, "doc_id").join(names, "c_custkey").join(part, "doc_id")
    return joined.select(
        F.col("doc_id").alias("case_id"),
        F.concat(F.lit("CASE-"), F.col("doc_id").cast("string")).alias("case_number"),
        "customer_name", "sku",
        _pick(CASE_TYPES, "doc_id").alias("case_type"),
        F.when(closed, "CLOSED").otherwise("OPEN").alias("status"),
        _pick(PRIORITIES, "doc_id").alias("priority"),
        F.col("text").alias("issue_description"),
        F.when(closed, _pick(RESOLUTIONS, "doc_id")).alias("resolution"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("opened_date"),
    )


def cases(spark: SparkSession, d: str) -> DataFrame:
    """Case rows with ids and copied names, built by the library's own key resolution."""
    from callweave.operators.keys import build_cases

    return build_cases(staged_cases(spark, d), customers(spark, d), products(spark, d))


def _second(turn):
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(secs=turn.cast("decimal(18,6)"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as transcript chunks, with the source's role."""
    turn = F.col("turn")
    return raw(spark, d, "conversations").select(
        (F.col("conv_id") * 1048576 + turn).alias("transcript_id"),
        F.lit(None).cast("bigint").alias("case_id"),
        F.col("conv_id").cast("string").alias("call_id"),
        turn.alias("chunk_number"),
        F.lit("simulated").alias("stream_type"),
        F.col("text").alias("transcript_text"),
        (F.length("text") / 15.0).alias("audio_duration"),
        _second(turn).alias("created_at"),
        F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")).alias("role"),
    )


def call_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).drop("role")


def introductions(spark: SparkSession, d: str) -> DataFrame:
    """What the caller of each conversation says first: who they are, what they bought and what is wrong.

    A conversation takes the order that carries its number, that order's customer and its first part.
    """
    conv = raw(spark, d, "conversations")
    first = conv.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("issue"))
    order = raw(spark, d, "orders").select(F.col("o_orderkey").alias("conv_id"), F.col("o_custkey").alias("customer_id"))
    line = raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("conv_id")).agg(
        F.min("l_partkey").alias("product_id"))
    bought = line.join(products(spark, d).select("product_id", F.col("name").alias("product")), "product_id")
    who = customers(spark, d).select("customer_id", "name", "email", "phone", "loyalty_tier")
    joined = first.join(order, "conv_id").join(who, "customer_id").join(bought, "conv_id", "left")
    about = F.when(F.col("product").isNotNull(), F.concat(
        F.lit(" I am calling about my "), F.col("product"), F.lit(", order ORD-"), F.col("conv_id").cast("string"),
        F.lit("."))).otherwise("")
    return joined.select(
        "conv_id", "customer_id", "name", "email", "phone", "loyalty_tier", "product", "issue",
        F.concat(
            F.lit("Hello, my name is "), F.col("name"), F.lit(". My email is "), F.col("email"),
            F.lit(" and my phone is "), F.col("phone"), F.lit("."), about,
            F.lit(" The problem is that "), F.col("issue"), F.lit(" I would like a refund."),
        ).alias("text"),
    )


def call_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole calls: the caller's introduction as chunk 0, then the turns."""
    intro = introductions(spark, d).select(
        (F.col("conv_id") * 1048576).alias("transcript_id"),
        F.lit(None).cast("bigint").alias("case_id"),
        F.col("conv_id").cast("string").alias("call_id"),
        F.lit(0).cast("bigint").alias("chunk_number"),
        F.lit("simulated").alias("stream_type"),
        F.col("text").alias("transcript_text"),
        (F.length("text") / 15.0).alias("audio_duration"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"),
        F.lit("user").alias("role"),
    )
    later = turns(spark, d).withColumns({
        "transcript_id": F.col("transcript_id") + 1,
        "chunk_number": F.col("chunk_number") + 1,
        "created_at": _second(F.col("chunk_number") + 1),
    })
    return intro.unionByName(later)


def call_events(spark: SparkSession, d: str) -> DataFrame:
    """Update events of calls: one call per user and day, one session per user."""
    kind = F.col("event_type")
    renamed = F.coalesce(*[F.when(kind == k, v) for k, v in MESSAGE_TYPES.items()])
    return raw(spark, d, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("call_id"),
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        "ts",
        renamed.alias("type"),
        F.col("props").alias("payload"),
        "value",
    )
