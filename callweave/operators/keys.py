"""Surrogate keys, business keys and key lookups."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from callweave.session import checkpointed

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the partition below


def with_ids(df: DataFrame, order_cols: list[str], id_col: str = "id", start: int = 1,
             now: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Dense ids in the order of ``order_cols`` and, with ``now``, a ``created_at`` default.

    Rows are range-partitioned by all order columns, so one hot value of the first column is split over
    partitions, and stored, so ids and partitions stay the same when a task is run again. The driver sees one
    count per partition.
    """
    ranged = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    stored = checkpointed(ranged.sortWithinPartitions(*order_cols))
    marked = stored.withColumn("__row", F.monotonically_increasing_id())
    part = F.shiftright("__row", _ROW_BITS)
    counts = sorted(marked.groupBy(part.alias("__part")).count().collect())
    before = accumulate((r["count"] for r in counts), initial=start)
    offsets = df.sparkSession.createDataFrame(
        [(r["__part"], n) for r, n in zip(counts, before)], "__part bigint, __offset bigint")
    numbered = marked.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(
        id_col, F.col("__offset") + F.col("__row") - F.shiftleft("__part", _ROW_BITS))
    if now is not None and "created_at" in df.columns:
        numbered = numbered.withColumn("created_at", F.coalesce("created_at", now.cast("timestamp_ntz")))
    elif now is not None:
        numbered = numbered.withColumn("created_at", now.cast("timestamp_ntz"))
    return numbered.select(id_col, *[c for c in numbered.columns if c != id_col and not c.startswith("__")])


def resolve_keys(staged: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines by order number and sku → ids; a line without a price takes the product's."""
    o = orders.select("order_number", "order_id")
    p = products.select("sku", "product_id", F.col("price").alias("list_price"))
    return staged.join(p, "sku").join(o, "order_number").select(
        "order_id", "product_id", "quantity",
        F.coalesce(F.col("price").cast("decimal(12,2)"), F.col("list_price").cast("decimal(12,2)")).alias("price"),
    )


def build_cases(staged: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """Case rows with ids found by customer name and sku, and both names copied into the row."""
    c = customers.select(F.col("name").alias("customer_name"), "customer_id")
    p = products.select("sku", "product_id", F.concat(F.col("name"), F.lit(" ("), F.col("sku"), F.lit(")")).alias("product_name"))
    return staged.join(c, "customer_name").join(p, "sku").select(
        "case_id", "case_number", "customer_id", "customer_name", "product_id", "product_name", "case_type", "status",
        "priority", "issue_description", "resolution", "opened_date",
    )


def for_keys(df: DataFrame, keys: DataFrame | list, key: str) -> DataFrame:
    """All rows of a few keys (a list: a filter pushed to the scan) or of a table of keys (a semi-join)."""
    if isinstance(keys, list):
        return df.filter(F.col(key).isin(keys))
    return df.join(keys.select(key), key, "left_semi")
