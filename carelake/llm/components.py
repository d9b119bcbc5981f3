"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links ``a``, ``b``; the label is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest one, then the smaller ones too. Its steps are
    written to the shared folder; rounds end when the table stands still. Nothing but a count and a checksum reaches the
    driver. A hub is many rows of one join key, and both sides of a join are read from files, so that adaptive execution
    can split it; its minimum is taken map-side.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links, seen = materialize(links, "components"), None

    def smallest(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "components")

    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        # a node without a smaller neighbour is its own minimum, and its links stay as they are
        least = smallest(links)
        large = links.join(least, links["v"] == least["node"], "left").select("u", F.coalesce("m", "v").alias("v"))
        large = materialize(large.distinct(), "components")
        least = smallest(large)
        small = large.join(least, large["u"] == least["node"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(small.unionAll(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct(), "components")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots)
