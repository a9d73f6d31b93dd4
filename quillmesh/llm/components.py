"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _toward_minimum(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): link every v of a u to the smallest of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of any orderable type to (node, root): root is the smallest node reachable.

    Self-links and nulls are ignored; nodes without links are absent. Each round is two
    aggregations and joins on narrow rows, and ends in a reliable checkpoint; the number of rounds
    grows with the logarithm of the longest path.
    """
    now = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _toward_minimum(large)
        now = settle(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u > v")
            .distinct()
        )
        new = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
