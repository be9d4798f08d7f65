"""Class labels from links: smallest member by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def merge_classes(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is the smallest node of its component.

    Each round is two shuffles: every node passes the smallest node it knows to all
    neighbours above it, then every node links itself and its smaller neighbours to
    the smallest. The rounds end when the links no longer change, so the result is
    complete whatever the depth. Large neighbourhoods are aggregated before they are
    shuffled (min) and joined by key with skew handling; nothing is gathered.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "classes")
    while True:
        # larger neighbours of each node go to the smallest node it knows
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct(), "classes")
        # smaller neighbours and the node itself go to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        small = materialize(small, "classes")
        # done when every node has one link, and no target is itself a source
        n = small.count()
        nodes = small.select("u").distinct().count()
        chained = 0 if n != nodes else small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = small
        if n == nodes and not chained:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots), "labels")
