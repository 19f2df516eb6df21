"""Data checks: constraint report and row counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class NotNull:
    table: str
    column: str


@dataclass(frozen=True)
class MaxLength:
    table: str
    column: str
    length: int


@dataclass(frozen=True)
class Domain:
    table: str
    column: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    table: str
    column: str
    parent: str
    parent_column: str


RowRule = NotNull | MaxLength | Domain
Rule = RowRule | Unique | Reference

# The constraints of the data model.
RULES: tuple[Rule, ...] = (
    NotNull("customers", "customer_id"), NotNull("customers", "name"),
    NotNull("products", "product_id"), NotNull("products", "name"),
    NotNull("orders", "order_id"), NotNull("orders", "customer_id"), NotNull("orders", "order_number"),
    NotNull("order_items", "order_id"), NotNull("order_items", "product_id"),
    NotNull("cases", "case_id"), NotNull("cases", "case_number"),
    MaxLength("customers", "name", 200), MaxLength("customers", "email", 200), MaxLength("customers", "phone", 20),
    MaxLength("products", "name", 200), MaxLength("products", "sku", 50), MaxLength("orders", "order_number", 50),
    MaxLength("cases", "issue_description", 2000), MaxLength("cases", "resolution", 2000),
    Domain("customers", "loyalty_tier", ("PLATINUM", "GOLD", "SILVER")),
    Domain("orders", "status", ("PENDING", "PROCESSING", "SHIPPED", "DELIVERED")),
    Domain("cases", "case_type", ("DEFECT", "RETURN", "INQUIRY")),
    Domain("cases", "status", ("OPEN", "CLOSED")),
    Domain("cases", "priority", ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    Unique("customers", ("customer_id",)), Unique("products", ("product_id",)), Unique("orders", ("order_id",)),
    Unique("cases", ("case_id",)),
    Reference("orders", "customer_id", "customers", "customer_id"),
    Reference("order_items", "order_id", "orders", "order_id"),
    Reference("order_items", "product_id", "products", "product_id"),
)


def _violation(rule: RowRule) -> tuple[str, Column]:
    c = F.col(rule.column)
    if isinstance(rule, NotNull):
        return "not_null", c.isNull()
    if isinstance(rule, MaxLength):
        return f"max_length_{rule.length}", F.coalesce(F.length(c) > rule.length, F.lit(False))
    return "domain", F.coalesce(~c.isin(*rule.values), F.lit(False))


def _row(table: str, column: str, rule: str, count: Column) -> Column:
    return F.struct(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.lit(rule).alias("rule"),
                    count.cast("bigint").alias("violations"))


def check_constraints(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule with its number of violating rows (for keys: of repeated key values).

    Row rules of a table share one scan. Key and reference rules first reduce rows to counts per key, so a hot
    key is one row when it meets the shuffle.
    """
    parts: list[DataFrame] = []
    for name, df in tables.items():
        row_rules = [r for r in rules if r.table == name and isinstance(r, (NotNull, MaxLength, Domain))]
        if row_rules:
            checks = [_violation(r) for r in row_rules]
            counts = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, cond) in enumerate(checks)])
            rows = F.array(*[_row(name, r.column, checks[i][0], F.col(f"c{i}")) for i, r in enumerate(row_rules)])
            parts.append(counts.select(F.inline(rows)))
    for rule in rules:
        if rule.table not in tables:
            continue
        df = tables[rule.table]
        if isinstance(rule, Unique):
            repeated = df.groupBy(*rule.columns).count().filter(F.col("count") > 1)
            one = repeated.agg(F.count("*").alias("n"))
            parts.append(one.select(F.inline(F.array(_row(rule.table, "+".join(rule.columns), "unique", F.col("n"))))))
        elif isinstance(rule, Reference) and rule.parent in tables:
            keys = df.filter(F.col(rule.column).isNotNull()).groupBy(F.col(rule.column).alias("k")).count()
            parent = tables[rule.parent].select(F.col(rule.parent_column).alias("k"))
            one = keys.join(parent, "k", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
            parts.append(one.select(F.inline(F.array(_row(rule.table, rule.column, f"references_{rule.parent}", F.col("n"))))))
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Table name and number of rows, by name."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts).orderBy("table_name")
