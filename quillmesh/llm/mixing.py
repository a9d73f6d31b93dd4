"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Keys are uniform, so equal ranges of the key are equal shares of
a source: a source of n rows is cut into n / ``rows_per_range`` key ranges, which spreads a hot
source over as many tasks as its size asks for. Sums per range, their running sums, and a running
sum inside each range give every row's place in its source; the budget is cut there.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle

RANGES = 4294967296  # values of the eight leading hex digits of a key


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: list, sums: dict[str, str], prefix: str) -> DataFrame:
    """``df`` with distributed running sums (the row itself left out) under ``order``, which must
    be total. Range partitions are summed alone; only their totals are scanned in one place."""
    ranged = settle(df.repartitionByRange(*order).withColumn(f"{prefix}_part", F.spark_partition_id()))
    before = Window.orderBy(f"{prefix}_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(f"{prefix}_part").agg(*[F.sum(c).alias(f"{prefix}_{n}_t") for n, c in sums.items()])
    offsets = totals.select(
        f"{prefix}_part", *[F.coalesce(F.sum(f"{prefix}_{n}_t").over(before), F.lit(0)).alias(f"{prefix}_{n}_o") for n in sums]
    )
    inside = Window.partitionBy(f"{prefix}_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(offsets, f"{prefix}_part").select(
        "*", *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{prefix}_{n}_o")).alias(n) for n, c in sums.items()]
    )
    return rows.drop(f"{prefix}_part", *[f"{prefix}_{n}_o" for n in sums])


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: _src (null sources are null), _size, _rows. Adds _target.

    Sources take ``weights`` in turn by code point, null last. ``share`` of all sizes is dealt out
    by weight; no target is above ``most`` times its source's size, and what that leaves over is
    dealt again by weight among the others, until none is above. In closed form: sources by
    size / weight, each full as long as the even share of those left is above it.
    """
    numbered = running_sums(
        sizes.withColumn("_one", F.lit(1)), [F.col("_src").isNull(), F.col("_src").asc_nulls_last()], {"_rank": "_one"}, "_r"
    )
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("_size") * F.lit(float(most))
    )
    placed = running_sums(
        weighed, [(F.col("_cap") / F.col("_w")).asc(), F.col("_rank").asc()], {"_cap_before": "_cap", "_w_before": "_w"}, "_p"
    )
    placed = settle(placed)
    total, all_w = placed.agg(F.sum("_size"), F.sum("_w")).first()
    budget = share * (total or 0)
    full = (F.lit(budget) - F.col("_cap_before")) > F.col("_cap") / F.col("_w") * (F.lit(all_w or 0.0) - F.col("_w_before"))
    placed = placed.withColumn("_full", full)
    caps, full_w = placed.where("_full").agg(F.sum("_cap"), F.sum("_w")).first()
    left = (all_w or 0.0) - (full_w or 0.0)
    even = (budget - (caps or 0.0)) / left if left else 0.0
    return placed.select(
        "_src", "_size", "_rows", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.lit(even)).alias("_target")
    )


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", rows_per_range: int = 20000, words=None) -> DataFrame:
    """_doc (a struct of the row of ``docs``: doc_id, source, text, more), _words, _size (of the
    source), _target, _taken.

    _taken is the number of words the mix takes of the row, repeats counted: whole epochs of the
    source, then the rest of the target in key order, cut inside the row that crosses it, so each
    source gives its rounded target exactly. Null and empty texts have no words and give none; a
    null source is a source of its own, last in order; rows that share an id or are equal each
    count. The key depends on seed and doc_id alone, so reruns agree. An empty table gives an
    empty result. ``words`` is a column to use in place of the number of words of text.
    """
    keyed = docs.select(
        F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col("source").alias("_src"),
        F.col("doc_id").alias("_id"),
        (word_count(F.col("text")) if words is None else words).alias("_words"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_key"),
    )
    narrow = settle(keyed.select("_src", "_words", "_key"))
    sizes = narrow.groupBy("_src").agg(F.sum("_words").alias("_size"), F.count("*").alias("_rows"))
    targets = source_targets(sizes, weights, share, most).select(
        F.col("_src").alias("_of"),
        "_size",
        "_target",
        F.greatest(F.ceil(F.col("_rows") / rows_per_range), F.lit(1)).cast("long").alias("_ranges"),
    )
    targets = settle(targets)
    digits = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    place = F.floor(digits * F.col("_ranges") / RANGES).cast("long")

    def placed(rows):
        return rows.join(targets, rows["_src"].eqNullSafe(targets["_of"])).drop("_of").withColumn("_range", place)

    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed(narrow)
        .groupBy("_src", "_range")
        .agg(F.sum("_words").alias("_sum"))
        .select(F.col("_src").alias("_of"), F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = (
        Window.partitionBy("_src", "_range").orderBy("_key", "_id", "_words").rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = placed(keyed)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    rows = rows.join(offsets, rows["_src"].eqNullSafe(offsets["_of"]) & (rows["_range"] == offsets["_at"]))
    goal = F.round("_target").cast("long")
    epochs = F.when(F.col("_size") > 0, F.floor(goal / F.col("_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("_size") - (F.col("_inner") + F.col("_offset"))
    taken = epochs * F.col("_words") + F.greatest(F.lit(0), F.least(F.col("_words"), rest))
    return rows.select("_doc", "_words", "_size", "_target", taken.cast("long").alias("_taken"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    narrow = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("_n")))
    return mix(narrow, words=F.col("_n"), **options).select(
        "_doc.doc_id",
        F.col("_words").alias("size"),
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, each row as often as the mix takes it, to the nearest whole row;
    rows without words cost nothing and stay once."""
    copies = F.when(F.col("_words") > 0, F.round(F.col("_taken") / F.col("_words"))).otherwise(1).cast("int")
    return (
        mix(docs, **options)
        .select("_doc", F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"))
        .select("_doc.*")
    )


ORACLE = """
WITH base AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r
  FROM base GROUP BY source),
wt AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[r % 3 + 1] AS w, 2.0::DOUBLE * s AS cap FROM src),
cum AS (
  SELECT *,
         coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
         coalesce(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
         1.5::DOUBLE * sum(s) OVER () AS b, sum(w) OVER () AS aw
  FROM wt),
fl AS (SELECT *, (b - cb) > cap / w * (aw - wb) AS isfull FROM cum),
tg AS (
  SELECT source, s,
         CASE WHEN isfull THEN cap
              ELSE w * ((b - coalesce(sum(CASE WHEN isfull THEN cap END) OVER (), 0))
                        / (aw - coalesce(sum(CASE WHEN isfull THEN w END) OVER (), 0))) END AS target
  FROM fl),
pos AS (
  SELECT base.*, tg.s, tg.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY base.source ORDER BY k, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p,
         CAST(round(tg.target) AS BIGINT) AS goal
  FROM base JOIN tg ON base.source IS NOT DISTINCT FROM tg.source),
ep AS (SELECT *, CASE WHEN s > 0 THEN goal // s ELSE 0 END AS e FROM pos)
SELECT doc_id, size, s AS source_size, target,
       CAST(e * size + greatest(0, least(size, goal - e * s - p)) AS BIGINT) AS taken
FROM ep
"""
