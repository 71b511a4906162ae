"""Connected components over link tables, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: longs); component is the least node.

    Each round writes one table of at most as many links as before; the number of rounds grows
    with the logarithm of the longest path.  Minima are combined before they are shuffled, so a
    node with very many links is no hot key of the aggregation, and the joins are plain equi-joins.
    """
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u <> w").distinct(), "links")
    mark = None
    while True:
        # large star: every neighbour above a node links to the least node around it
        both = links.unionByName(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter("w > u").select(F.col("w").alias("u"), F.col("m").alias("w")).filter("u <> w").distinct()
        # small star: a node and its lower neighbours link to the least of them
        lower = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(lower, "u").filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w"))
        links = written(small.unionByName(lower.select("u", F.col("m").alias("w"))).distinct(), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "w").cast("decimal(20,0)")).alias("s")).first()
        if mark == (now["n"], now["s"]):
            break
        mark = (now["n"], now["s"])
    roots = links.select(F.col("w").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("w").alias("component")).unionByName(roots)
