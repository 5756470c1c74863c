"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgauge.llm.shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node of its component, for every node that is not itself the smallest.

    Alternates two steps until all links lead to a root: each node links its larger
    neighbours to its smallest one, then its smaller neighbours likewise, so that
    components become stars around their smallest node in a number of rounds that
    grows with the logarithm of the graph.  All steps are joins and minima; a node
    with a large share of all edges is combined before the shuffle and its join can be
    split.  NULL ends and loops are left out, repeated edges count once.  No edges:
    no rows.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    links = written(ends.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "links")
    rows = links.count()
    while not _are_stars(links, rows):
        both = links.union(links.select("u", "v")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        least = written(least, "least", 2 * rows)
        larger = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u"))
        larger = written(larger.distinct(), "larger", rows)
        least = written(larger.groupBy("v").agg(F.min("u").alias("m")), "least", rows)
        turned = larger.join(least, "v").filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        links = written(turned.union(least.select("v", "m")).distinct(), "links", 2 * rows)
        rows = links.count()
    return links.select(F.col("v").alias("node"), F.col("u").alias("root"))


def _are_stars(links: DataFrame, rows: int) -> bool:
    """Whether every node has one link to a smaller node, and that one has none."""
    if not rows:
        return True
    nodes = links.groupBy("v").agg(F.count("*").alias("n"))
    ends = links.select(F.col("u").alias("v")).distinct().withColumn("end", F.lit(True))
    return nodes.join(ends, "v", "left").filter("n > 1 OR end").isEmpty()
