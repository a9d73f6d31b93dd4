"""How many tasks a shuffle gets."""

from pyspark.sql import DataFrame

PIECE = 16 << 20  # bytes of files for each task; what is read for two uses counts twice


def tasks(*frames: DataFrame, piece: int | None = None) -> int:
    """Tasks that keep the share of each the same however large the files are that ``frames`` read, or 0
    where the session's own number will do. What was checkpointed in n parts gets n at least."""
    size = parts = 0
    for frame in frames:
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            kind = leaf.getClass().getSimpleName()
            if kind == "LogicalRelation":
                size += int(str(leaf.stats().sizeInBytes()))
            elif kind == "LogicalRDD":
                parts = max(parts, leaf.rdd().getNumPartitions())
    wanted = max(-(-size // (piece or PIECE)), 0)
    least = frames[0].sparkSession.sparkContext.defaultParallelism
    if wanted < 2 and parts <= least:
        return 0
    return max(wanted, parts, least)


def deal(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as its input asks. Groups of mostly one row gain nothing
    from being combined before a shuffle, and there the share of a task is a whole split of a file."""
    n = tasks(df) if n is None else n
    return df.repartition(n, *keys) if n else df
