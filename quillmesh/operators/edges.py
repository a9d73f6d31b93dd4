"""Edges and unique keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.deal import deal, tasks
from ..plans.model import EDGE_TYPES, NODE_TYPES


def first_edge_wins(candidates: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One edge for each ordered pair: the first by (phase, seq). No loops; with ``nodes``, both
    ends must exist. One sort of each task's pairs; of names that begin alike a sort compares whole
    rows, so a hash of both goes first."""
    rest = [c for c in candidates.columns if c not in ("source", "target", "phase", "seq")]
    kept = candidates.where("source <> target")
    if nodes is not None:
        ids = nodes.select("id").distinct()
        kept = kept.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
            ids.withColumnRenamed("id", "target"), "target", "left_semi"
        )
    first = [F.xxhash64("source", "target").alias("_hash")] if dict(kept.dtypes)["source"] == "string" else []
    won = deal(kept, "source", "target").groupBy(*first, "source", "target").agg(F.min(F.struct("phase", "seq", *rest)).alias("e"))
    return won.select("source", "target", *[f"e.{c}" for c in rest])


def last_link_wins(links: DataFrame) -> DataFrame:
    """What a load makes of repeated ordered pairs: the last by ord."""
    rest = [c for c in links.columns if c not in ("source", "target", "ord")]
    won = links.groupBy("source", "target").agg(F.max(F.struct("ord", *rest)).alias("e"))
    return won.select("source", "target", *[f"e.{c}" for c in rest], "e.ord")


def unique_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys that exactly one distinct value has; ambiguous keys go."""
    held = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_last"))
    return held.where(F.col(value) == F.col("_last")).drop("_last")


def resolve_unique(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with the one value that its key has in ``right``; null where none or several."""
    return left.join(unique_key(right, key, value), key, "left")


def local_then_global(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls (caller, file, name) to names (id, file, name): the one of that name in the same file,
    else the one of that name anywhere, else dropped."""
    local = names.groupBy("file", "name").agg(F.min("id").alias("near"), F.count("*").alias("n")).where("n = 1").drop("n")
    world = names.groupBy("name").agg(F.min("id").alias("far"), F.count("*").alias("n")).where("n = 1").drop("n")
    return (
        calls.join(local, ["file", "name"], "left")
        .join(world, "name", "left")
        .select("caller", F.coalesce("near", "far").alias("target"))
        .where("target is not null")
    )


def induced(nodes: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``ids`` and the links with both ends among them."""
    keep = ids.select("id").distinct()
    return (
        nodes.join(keep, "id", "left_semi"),
        links.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(
            keep.withColumnRenamed("id", "target"), "target", "left_semi"
        ),
    )


def dangling(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links with an end that is no node: source, target, type, end. A link is shuffled once for each
    end, with both ids once."""
    # The links follow the ids: dealt themselves, they would be dealt again below the join.
    ids = deal(nodes.select("id"), "id", n=tasks(nodes, links)).distinct()
    end = lambda at, other, out: F.struct(F.col(at).alias("id"), F.col(other).alias("other"), F.lit(out).alias("out"))
    ends = links.select("type", F.inline(F.array(end("source", "target", True), end("target", "source", False))))
    lost = ends.join(ids, "id", "left_anti")
    either = lambda a, b: F.when(F.col("out"), a).otherwise(b)
    return lost.select(
        either(F.col("id"), F.col("other")).alias("source"), either(F.col("other"), F.col("id")).alias("target"), "type",
        either(F.lit("source"), F.lit("target")).alias("end"),
    )


def stats(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """what, type, n: counts of all node and edge types and of all nodes, in one pass over each."""

    def counts(df, what, kinds):
        row = df.agg(*[F.count_if(F.col("type") == k).alias(k) for k in kinds], F.count("*").alias("total"))
        pairs = F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("n")) for k in (*kinds, "total")])
        return row.select(F.lit(what).alias("what"), F.inline(pairs))

    return counts(nodes, "node", NODE_TYPES).unionByName(counts(links, "edge", EDGE_TYPES))


def histogram(nodes: DataFrame) -> DataFrame:
    """type, n by falling count, then type; nodes without a type do not count."""
    return nodes.where("type is not null").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with links_out and links_in, counted in one aggregation over both ends."""
    ends = links.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o")))).alias("e"))
    counted = ends.groupBy("e.id").agg(F.sum("e.o").alias("links_out"), F.sum(1 - F.col("e.o")).alias("links_in"))
    return nodes.join(counted, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("links_out", "links_in")})
