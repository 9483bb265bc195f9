"""Connected components of links held in a table, by contracting the graph round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carthouse.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b): the smallest node reachable.

    In every round each node moves to its smallest neighbour if that is
    smaller, and the links follow: those within one place are gone, equal ones
    are one. A star is one link after a round, so only the first round reads
    all links. Labels are then looked up round by round, last to first. The
    joins have plain tables on both sides, which lets skewed hubs be split.
    """
    edges = stage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
                  "cc-edges")
    moves = []
    while not edges.isEmpty():
        down = edges.groupBy("b").agg(F.min("a").alias("to")).withColumnRenamed("b", "node")
        roots = edges.select(F.col("a").alias("node"), F.col("a").alias("to"))
        moves.append(stage(down.unionByName(roots).groupBy("node").agg(F.min("to").alias("to")), "cc-moves"))
        for end in ("a", "b"):
            known = moves[-1].select(F.col("node").alias(end), F.col("to").alias("place"))
            edges = edges.join(known, end).drop(end).withColumnRenamed("place", end)
        edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(),
                      "cc-edges")
    if not moves:
        return stage(links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0), "cc-none")
    labels = moves[-1].withColumnRenamed("to", "label")
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), "label")
        labels = stage(move.join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "cc-labels")
    return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more links between nodes, labelled or not."""
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("label").alias("known"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")
    over = components(links.where("a <> b")).select(F.col("node").alias("label"), F.col("label").alias("over"))
    both = labels.join(over, "label", "full").select(F.coalesce("node", "label").alias("node"),
                                                     F.coalesce("over", "label").alias("label"))
    return stage(both.groupBy("node").agg(F.min("label").alias("label")), "cc-merged")
