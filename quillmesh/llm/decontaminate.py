"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is five words read through a fixed mask of six places, so a substituted word under the
mask's hole does no harm. With the two masks every 13 aligned words of which 11 agree share a
seed. Shorter items get more masks, read through the whole item: one at least for each pattern of
substitutions that the two miss, and the item itself where it has under five words. Test and training seeds are joined by hash; a hit fixes an alignment of item and document,
and the alignment is verified on the words themselves.
"""

from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, settle

MASKS = ((0, 1, 3, 4, 5), (0, 2, 3, 4, 5))
SPAN = 6
#: Rows of the benchmark's seed table up to which it is broadcast (at most 24 bytes each).
BROADCAST_SEEDS = 2_000_000


def tokens(text):
    """Lower-case runs of letters and digits; null texts have none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def extra_masks(width: int, similarity: float) -> list[tuple[int, ...]]:
    """Masks over ``width`` words, so that with MASKS no pattern of as many substitutions as
    ``similarity`` allows is missed. Each has five words, or all that the patterns leave."""
    miss = width - ceil(similarity * width - 1e-9)
    seen = [{a + o for o in mask} for mask in MASKS for a in range(width - SPAN + 1)]
    lost = [set(p) for p in combinations(range(width), miss) if not any(s.isdisjoint(p) for s in seen)]
    out = []
    while lost:
        gap = set()
        for p in lost:
            if width - len(gap | p) >= min(width - miss, 5):
                gap |= p
        out.append(tuple(sorted(set(range(width)) - gap)))
        lost = [p for p in lost if not p <= gap]
    return out


def seeds(rows: DataFrame, keys: list[str], words: str, masks) -> DataFrame:
    """keys, at (0-based place), seed: the hashes of all masks at every place where their words
    stand. ``masks``: (number, words that it spans, places)."""
    hashed = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_h"))
    least, most = min(span for _, span, _ in masks), max(span for _, span, _ in masks)
    n = F.size("_h") - (least - 1)
    # Shifted views side by side: one row a place, hashed in generated code; null beyond the end.
    views = F.arrays_zip(*[F.slice("_h", i + 1, F.greatest(n, F.lit(0))).alias(f"h{i}") for i in range(most)])
    placed = hashed.select(*keys, F.posexplode(views).alias("at", "v"))
    hashes = []
    for m, span, mask in masks:
        h = F.xxhash64(F.lit(m), *[F.col(f"v.h{i}") for i in mask])
        hashes.append(h if span == least else F.when(F.col(f"v.h{span - 1}").isNotNull(), h))
    found = placed.select(*keys, "at", F.explode(F.array(*hashes)).alias("seed"))
    return found if least == most else found.where("seed is not null")


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, similarity: float = 0.8, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """k1, k2 (row keys of docs), doc_id, item_id, overlap, window, similarity: each document with
    each benchmark item that it overlaps, by its best window.

    An overlap is a window of min(``window``, words of the item) consecutive words of the item,
    aligned without gaps to words of the document, of which a share of at least ``similarity``
    agrees. None is missed: to an item of under ``window`` words all of it must be aligned, and items
    of under five words match verbatim at 0.8. Null and empty texts match nothing. Rows that
    share an id are told apart by id and text. Other columns are ignored.
    """
    items = settle(
        benchmark.where("text is not null").select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    )
    width = F.least(F.lit(window), F.size("words"))
    widths = sorted(r[0] for r in items.select(width).distinct().collect())  # at most ``window``
    numbered, by_width = [(m, SPAN, mask) for m, mask in enumerate(MASKS)], {}
    for w in widths:
        by_width[w] = [(len(numbered) + i, w, mask) for i, mask in enumerate(extra_masks(w, similarity))]
        numbered += by_width[w]
    index = seeds(items, ["item_id"], "words", numbered[: len(MASKS)])
    for w in widths:
        if by_width[w]:
            index = index.unionByName(seeds(items.where(width == w), ["item_id"], "words", by_width[w]))
    index = settle(index.withColumnRenamed("at", "q").distinct())
    if index.count() <= broadcast_seeds:
        index = F.broadcast(index)
    base = docs.where("text is not null").select("doc_id", "text")
    placed = seeds(base.select(*row_key("doc_id", "text"), tokens(F.col("text")).alias("words")), ["k1", "k2"], "words", numbered)
    hits = placed.join(index, "seed").select("k1", "k2", "item_id", (F.col("at") - F.col("q")).alias("shift")).distinct()
    of_doc = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "shift")).alias("hits"))
    of_doc = settle(of_doc)
    found = (
        base.select(*row_key("doc_id", "text"), "doc_id", "text")
        .join(of_doc, ["k1", "k2"])
        .select("k1", "k2", "doc_id", tokens(F.col("text")).alias("words"), "hits")
    )
    sized = items.select("item_id", F.size("words").alias("m"), "words")
    # Only the aligned stretch of the document leaves its row.
    longest = sized.agg(F.max("m")).first()[0] or 0
    start = lambda s: F.greatest(s, F.lit(0))
    stretches = found.select(
        "k1",
        "k2",
        "doc_id",
        F.explode(
            F.transform(
                "hits",
                lambda h: F.struct(
                    h["item_id"].alias("item_id"),
                    start(-h["shift"]).alias("from_item"),
                    F.slice("words", start(h["shift"]) + 1, F.greatest(F.lit(longest) - start(-h["shift"]), F.lit(0))).alias("have"),
                ),
            )
        ).alias("s"),
    ).select("k1", "k2", "doc_id", "s.*")
    width = F.least(F.lit(window), F.col("m"))
    agree = (
        stretches.join(sized, "item_id")
        .withColumn("want", F.slice("words", F.col("from_item") + 1, F.greatest(F.col("m") - F.col("from_item"), F.lit(0))))
        .withColumn("n", F.least(F.size("have"), F.size("want")))
        .where(F.col("n") >= width)
        .withColumn("same", F.zip_with(F.slice("have", F.lit(1), F.col("n")), F.slice("want", F.lit(1), F.col("n")), lambda a, b: (a == b).cast("int")))
    )
    best = F.array_max(
        F.transform(F.sequence(F.lit(1), F.col("n") - width + 1), lambda i: F.aggregate(F.slice("same", i, width), F.lit(0), lambda a, x: a + x))
    )
    scored = agree.select("k1", "k2", "doc_id", "item_id", best.alias("overlap"), width.alias("window"))
    return (
        scored.where(F.col("overlap") >= F.lit(similarity) * F.col("window") - 1e-9)
        .groupBy("k1", "k2", "doc_id", "item_id", "window")
        .agg(F.max("overlap").alias("overlap"))
        .withColumn("similarity", F.col("overlap") / F.col("window"))
    )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, overlap, window, similarity of contaminated documents; others have no row."""
    return (
        contamination(docs, benchmark, **options)
        .groupBy("doc_id", "item_id", "window")
        .agg(F.max("overlap").cast("long").alias("overlap"), F.max("similarity").alias("similarity"))
        .select("doc_id", "item_id", "overlap", F.col("window").cast("long").alias("window"), "similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows and columns of ``docs`` that overlap no benchmark item."""
    found = contamination(docs, benchmark, **options).select("k1", "k2").distinct()
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1, k2)
    return keyed.join(found, ["k1", "k2"], "left_anti").select("row.*")


ORACLE = """
WITH it AS (
  SELECT DISTINCT item_id, w, len(w) AS m
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) >= 6),
dc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w
       FROM documents WHERE text IS NOT NULL),
ip AS (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS q FROM it),
dp AS (SELECT rid, w, unnest(range(1, len(w) - 4)) AS p FROM dc WHERE len(w) >= 6),
isd AS (SELECT item_id, q, 'a' AS mask, concat_ws(' ', w[q], w[q+1], w[q+3], w[q+4], w[q+5]) AS s FROM ip
        UNION ALL SELECT item_id, q, 'b', concat_ws(' ', w[q], w[q+2], w[q+3], w[q+4], w[q+5]) FROM ip),
dsd AS (SELECT rid, p, 'a' AS mask, concat_ws(' ', w[p], w[p+1], w[p+3], w[p+4], w[p+5]) AS s FROM dp
        UNION ALL SELECT rid, p, 'b', concat_ws(' ', w[p], w[p+2], w[p+3], w[p+4], w[p+5]) FROM dp),
hit AS (SELECT DISTINCT rid, item_id, p - q AS shift FROM dsd JOIN isd USING (mask, s)),
pos AS (
  SELECT hit.rid, hit.item_id, hit.shift, dc.doc_id, least(13, it.m) AS width, it.m, len(dc.w) AS n, dc.w AS dw, it.w AS iw,
         unnest(range(greatest(1, 1 - hit.shift), least(it.m, len(dc.w) - hit.shift) + 1)) AS j
  FROM hit JOIN dc USING (rid) JOIN it USING (item_id)),
same AS (SELECT rid, doc_id, item_id, shift, width, j, CAST(dw[j + shift] = iw[j] AS INT) AS ok FROM pos),
win AS (
  SELECT rid, doc_id, item_id, width,
         sum(ok) OVER (PARTITION BY rid, item_id, shift ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s13,
         sum(ok) OVER (PARTITION BY rid, item_id, shift) AS sall,
         count(*) OVER (PARTITION BY rid, item_id, shift ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS c13,
         count(*) OVER (PARTITION BY rid, item_id, shift) AS call
  FROM same),
scored AS (
  SELECT doc_id, item_id, width, s13 AS overlap FROM win WHERE width = 13 AND c13 = 13
  UNION ALL SELECT doc_id, item_id, width, sall FROM win WHERE width < 13 AND call = width)
SELECT doc_id, item_id, CAST(max(overlap) AS BIGINT) AS overlap, CAST(width AS BIGINT) AS "window", max(overlap) / width::DOUBLE AS similarity
FROM scored WHERE overlap >= 0.8 * width - 1e-9 GROUP BY doc_id, item_id, width
"""
