"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from llm.common import shuffles_for, staged

MAX_ROUNDS = 60


def _written(edges: DataFrame, label: str) -> tuple[DataFrame, tuple]:
    """The links written, with their number and sums of their hashes, taken while they are written."""
    seen = Observation()
    sums = [F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.hash("v", "u").cast("long")).alias("g")]
    out = staged(edges.observe(seen, *sums), label)
    got = seen.get
    return out, (got["n"], got["h"], got["g"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of `links`; the component is its smallest node.

    Every round joins each link with the smallest neighbour of one end. The smallest neighbours are
    written first, so both sides of the join are plain shuffles and Spark can split the links of a
    node that has very many. Rounds shuffle to as many partitions as the links fill. Links may repeat;
    those with a null end and loops are left out; nodes of loops alone are not listed.
    """
    edges, before = _written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")), "links"
    )
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        with shuffles_for(edges.sparkSession, 2 * before[0]):
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
            large = both.join(least, both["u"] == least["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = staged(large.distinct(), "large")
            least = staged(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
            small = large.join(least, large["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            edges, after = _written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    with shuffles_for(edges.sparkSession, before[0]):
        named = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        return staged(named.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
