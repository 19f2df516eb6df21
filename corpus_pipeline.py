"""A training corpus from raw documents, in stages that are each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All but the last return the
columns of ``documents`` (extra columns stay as they are). A row without ``doc_id`` cannot be told from others and goes in the
first stage. A null text has no language and goes there too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import decontaminate, jaccard, language, packing, pii
from callweave.llm.tables import keep, release, stored, table
from callweave.session import drop_paths, written_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


_left: list[str] = []  # tables that the stage before has left


def stage(fn: Stage) -> Stage:
    """A stage whose tables go when the next one begins. By then its rows are written and read again."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _left)
        _left.clear()
        before = set(written_paths())
        out = fn(spark, docs, sf_dir)
        _left.extend(p for p in written_paths() if p not in before)
        release(spark)
        return out
    return run_stage


@stage
def told_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language can be told: those with letters whose two nearest codewords are not about equally near."""
    return language.told(docs, language.learn(docs.where(~language.held_out())))


@stage
def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the text with the smallest id of each class of copies and near copies."""
    return keep(docs, jaccard.similar_classes(docs).where("doc_id = component_id").select("doc_id"))


@stage
def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that hold a test item's question and answer."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@stage
def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in the place of personal data. No row goes."""
    return pii.pseudonymise(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining texts and their places in sequences of 1,024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", told_languages),
    ("ngram_jaccard_join", one_of_each_class),
    ("benchmark_decontamination", without_test_items),
    ("pii", with_pseudonyms),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # SQL cannot express the stages; tests/llm compares the rows with a brute-force version
