"""Connected components of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from criteria_engine.llm.tables import stored


def _links(table: DataFrame, a, b) -> DataFrame:
    table = table.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return table.where("a < b").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, label (the smallest node it is linked to, over any number of links) from a, b.

    In a round every node moves to its smallest neighbour's smallest neighbour, and links
    between the places reached are what the next round works on, so they dwindle. Rounds
    are stored tables: nothing is gathered on the driver but whether a link is left, and
    no lineage grows. A node with very many links has its minimum combined before the
    shuffle and is split in the joins, as both sides are plain tables.
    """
    links, labels = stored(_links(links, F.col("a"), F.col("b")), folder), None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        near = stored(near.select("node", F.least("node", "near").alias("near")), folder)
        above = near.select(F.col("node").alias("near"), F.col("near").alias("place"))
        moved = stored(near.join(above, "near").select("node", "place"), folder)
        if labels is None:
            labels = moved.withColumnRenamed("place", "label")
        else:
            later = moved.select(F.col("node").alias("label"), "place")
            labels = labels.join(later, "label", "left")
            labels = stored(labels.select("node", F.coalesce("place", "label").alias("label")), folder)
        first = moved.select(F.col("node").alias("a"), F.col("place").alias("place_a"))
        second = moved.select(F.col("node").alias("b"), F.col("place").alias("place_b"))
        links = links.join(first, "a").join(second, "b")
        links = stored(_links(links, F.col("place_a"), F.col("place_b")), folder)
        if links.isEmpty():
            return labels
