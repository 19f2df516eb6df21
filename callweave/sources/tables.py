"""Typed scans of parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callweave import schemas


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One of the seven tables, with its fixed schema instead of an inferred one."""
    return spark.read.schema(schemas.TABLES[table]).parquet(f"{directory}/{table}.parquet")


def raw(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """A raw star-schema table, with its fixed schema."""
    return spark.read.schema(schemas.RAW[table]).parquet(f"{directory}/{table}.parquet")
