"""Connected components of an edge table, by repeated minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwatch.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (a, b): comp is the smallest node that it reaches.

    Each round takes the least label of a node and its neighbours, then the label of that label. The rounds are few,
    as labels also jump; each is written to the shared folder, which cuts the lineage. Sums and minima are combined
    before they are shuffled, so that a node with very many neighbours is no hot key.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp"))
    labels = written(labels, "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("offer")), "b").groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        least = labels.join(told, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("offer", "comp")).alias("comp"))
        least = written(least, "labels")
        jump = least.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = written(least.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        if after.filter(F.col("was") != F.col("comp")).isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
