"""Capped neighbourhoods and shortest paths."""

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.deal import deal
from ..plans.model import edge_cost


class PathError(Exception):
    """Base of path failures."""


class NoPathError(PathError):
    pass


class PathTooLongError(PathError):
    pass


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names. Where it is unset, a
    session on this machine alone gets one of its own; on a cluster no other folder is shared."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmesh-"))
    return df.checkpoint(eager=True)


def neighbourhood(links: DataFrame, seeds: list[str], hops: int, cap: int = 500) -> tuple[list[tuple[str, int]], bool]:
    """[(id, hop)] and whether the cap cut it, over links in either direction: seeds first, then by
    (hop, id). What the driver holds is bounded by ``cap`` and the seeds; the links are scanned once
    a hop against a frontier of at most that size."""
    if hops not in (1, 2):
        raise ValueError(f"a neighbourhood has one hop or two, not {hops}")
    spark = links.sparkSession
    found = {s: 0 for s in sorted(set(seeds))}
    frontier = list(found)
    both = links.select(
        F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")
    ).select("e.a", "e.b")
    for hop in range(1, hops + 1):
        if not frontier:
            break
        at = F.broadcast(spark.createDataFrame([(x,) for x in frontier], "a string"))
        seen = F.broadcast(spark.createDataFrame([(x,) for x in found], "b string"))
        near = both.join(at, "a", "left_semi").select("b").distinct().join(seen, "b", "left_anti")
        room = max(0, cap - len(found))
        new = [r.b for r in near.orderBy("b").limit(room + 1).collect()]
        found |= {b: hop for b in new[:room]}
        if len(new) > room:
            return list(found.items()), True
        frontier = new
    if len(found) > cap:
        return list(found.items())[:cap], True
    return list(found.items()), False


def shortest_paths(links: DataFrame, start, ends: list | None = None, max_rounds: int = 1000, shown=lambda name: F.col(name), **cost) -> DataFrame:
    """id, cost, hops, nodes: the cheapest directed path from ``start`` to each node (or each of
    ``ends``); equal costs go to fewer hops, then the smaller node list, whose ids are as ``shown``.

    Rounds of relaxation over the nodes improved last; with ``ends``, what costs more than all of
    them cannot improve one and is let go before the links are read again. The links are dealt and
    sorted by source once and lie on the executors' disks so; a round shuffles no link."""
    spark = links.sparkSession
    edges = deal(links.select("source", "target", edge_cost(**cost).alias("w")), "source").sortWithinPartitions("source").persist(StorageLevel.DISK_ONLY)
    try:
        return _relax(spark, edges, start, ends, max_rounds, shown)
    finally:
        edges.unpersist()


def _relax(spark, edges, start, ends, max_rounds, shown):
    kind = dict(edges.dtypes)["source"]
    best = spark.createDataFrame([(start, 0.0, 0)], f"id {kind}, cost double, hops int").select("*", F.array(shown("id")).alias("nodes"))
    frontier = best
    for _ in range(max_rounds):
        step = (
            frontier.join(edges, frontier.id == edges.source)
            .where(~F.array_contains("nodes", shown("target")))
            .select(F.col("target").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat("nodes", F.array(shown("target"))).alias("nodes"))
            .groupBy("id")
            .agg(F.min(F.struct("cost", "hops", "nodes")).alias("new"))
        )
        old = best.select("id", F.struct("cost", "hops", "nodes").alias("old"))
        joined = step.join(old, "id", "left").where("old is null or new < old").select("id", "new.*")
        frontier = settle(joined)
        if frontier.isEmpty():
            break
        best = settle(best.join(frontier.select("id"), "id", "left_anti").unionByName(frontier))
        if ends is not None:
            reached = best.where(F.col("id").isin(ends)).agg(F.max("cost"), F.countDistinct("id")).first()
            if reached[1] == len(set(ends)):
                frontier = frontier.where(F.col("cost") <= reached[0])
                if frontier.isEmpty():
                    break
    else:
        raise PathError("paths did not settle")
    return best if ends is None else best.where(F.col("id").isin(ends))


def find_path(nodes: DataFrame, links: DataFrame, start: str, end: str, max_hops: int = 32, **cost) -> tuple[list[str], list[dict], float]:
    """(nodes, steps, total). ``max_hops`` is checked on the cheapest path: it bars, it does not
    steer."""
    have = {r.id for r in nodes.where(F.col("id").isin(start, end)).select("id").collect()}
    lost = [i for i in (start, end) if i not in have]
    if lost:
        raise PathError("the graph has no " + " and no ".join(lost))
    if start == end:
        return [start], [], 0.0
    row = shortest_paths(links, start, [end], **cost).first()
    if row is None:
        raise NoPathError(f"{end} cannot be reached from {start}")
    if row.hops > max_hops:
        raise PathTooLongError(f"the cheapest path takes {row.hops} steps and {max_hops} are allowed")
    pairs = list(zip(row.nodes, row.nodes[1:]))
    wanted = links.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, source string, target string")
    steps = links.withColumn("cost", edge_cost(**cost)).join(F.broadcast(wanted), ["source", "target"]).orderBy("k")
    rows = [
        {"source": r.source, "target": r.target, "type": r.type, "provenance": r.provenance or "inferred", "confidence": r.confidence, "cost": r.cost}
        for r in steps.collect()
    ]
    return row.nodes, rows, float(sum(r["cost"] for r in rows))


def path_sentence(start: str, end: str, nodes: list[str], steps: list[dict]) -> str:
    """One line on a found path, each step with what is known of its edge."""
    if len(nodes) == 1:
        return f"Both phrases mean the same entity: {nodes[0]}"  # "same entity" is fixed
    told = [nodes[0]]
    for step in steps:
        known = [step["type"], step["provenance"]] + ([f"{step['confidence']:.0%}"] if step["confidence"] is not None else [])
        told.append(f"-({', '.join(known)})-> {step['target']}")
    return f"{start!r} leads to {end!r} in {len(steps)} steps: {' '.join(told)}"
