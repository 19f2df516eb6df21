"""Connected components by joins, for links between rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from callweave.session import drop_paths, run_dir


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of links ``(a, b)``: the smallest node that it reaches, itself included.

    Each round takes the smallest label among the neighbours and then the label of that label, so long chains take few rounds.
    Minima are formed before the shuffle, so a node with very many links is no more than its own row for each task; a label
    that many nodes have is fetched once a node by a join that adaptive execution may split. Tables of a round are dropped.
    """
    spark = links.sparkSession
    held: list[str] = []

    def table(df: DataFrame) -> DataFrame:
        held.append(run_dir(spark, "table"))
        df.write.parquet(held[-1])
        return spark.read.schema(df.schema).parquet(held[-1])

    both = table(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = table(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    moved = True
    while moved:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = table(labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        ahead = step.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        labels = table(step.join(ahead, step["label"] == ahead["at"]).select(
            "node", F.least("label", "jump").alias("label"), (F.least("label", "jump") < F.col("old")).alias("moved")))
        moved = not labels.where("moved").isEmpty()
        drop_paths(spark, held[1:-1])
        del held[1:-1]
    drop_paths(spark, held[:1])
    return labels.select("node", "label")
