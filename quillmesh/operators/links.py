"""Links found in text, and tables generated from text."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import unique_key

NAME_RUN = r"[A-Za-z0-9._+-]+"


def name_references(texts: DataFrame, names: DataFrame, itself: bool = False) -> DataFrame:
    """texts (id, text) that hold, as a whole run of name characters, a name (id, name) that belongs
    to exactly one id: source, target. Tokenise once and join by equality: the cost is the tokens,
    not texts times names. Names with other characters are matched by a bounded regex join."""
    known = unique_key(names, "name", "id").select("name", F.col("id").alias("target"))
    plain = F.col("name").rlike(f"^{NAME_RUN}$")
    runs = texts.select(F.col("id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME_RUN), F.lit(0)))).alias("name"))
    found = runs.join(known.where(plain), "name").select("source", "target")
    odd = known.where(~plain & (F.trim("name") != ""))
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9._+-])\Q"), F.col("name"), F.lit(r"\E(?![A-Za-z0-9._+-])"))
    # Few names hold other characters; only texts that hold their first plain run are tried.
    first = odd.withColumn("run", F.regexp_extract("name", NAME_RUN, 0)).where("run <> ''")
    tried = runs.withColumnRenamed("name", "run").join(first, "run").join(texts.select(F.col("id").alias("source"), "text"), "source")
    found = found.unionByName(tried.where(F.rlike("text", pattern)).select("source", "target"))
    return (found if itself else found.where("source <> target")).distinct()


def token_overlap(left: DataFrame, right: DataFrame, least: int = 3, pattern: str = "[a-z0-9]{4,}") -> DataFrame:
    """left (id, text) to the only right (id, text) that shares ``least`` distinct tokens or more."""

    def tokens(df, name):
        return df.select(F.col("id").alias(name), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("token"))

    shared = tokens(left, "source").join(tokens(right, "target"), "token").groupBy("source", "target").count().where(F.col("count") >= least)
    return unique_key(shared, "source", "target")


def grounded(evidence: DataFrame, chunks: DataFrame, clip: int = 240) -> DataFrame:
    """evidence (id, text) whose first ``clip`` characters stand in chunks (id, text), as they are or
    with white space collapsed: evidence_id, chunk_id.

    A word inside the clipped text stands whole in every chunk that holds it, so the longest such
    word makes an equality join; the containment is then verified. Texts of under three words have
    no such word and are tried on every chunk."""
    normal = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    words = F.split(normal(F.col("clip")), " ")
    asked = evidence.select(F.col("id").alias("evidence_id"), F.substring(F.trim("text"), 1, clip).alias("clip")).where("clip <> ''")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    asked = asked.withColumn("word", longest["w"])
    have = chunks.select(F.col("id").alias("chunk_id"), "text")
    held = have.select("chunk_id", F.explode(F.array_distinct(F.split(normal(F.col("text")), " "))).alias("word"))
    pairs = held.join(asked.where("word is not null"), "word").join(have, "chunk_id")
    inside = F.contains("text", F.col("clip")) | F.contains(normal(F.col("text")), normal(F.col("clip")))
    found = pairs.where(inside).select("evidence_id", "chunk_id")
    short = have.join(asked.where("word is null").drop("word"), inside).select("evidence_id", "chunk_id")
    return found.unionByName(short).distinct()


def outline(rows: DataFrame, group: str, order: str, level: str, depth: int = 9) -> DataFrame:
    """Adds parent: the nearest earlier row of the group with a lower level (null: the root). One
    sort: the last row of each level so far, the latest of those below the row's own."""
    before = Window.partitionBy(group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col(level) > k, F.last(F.when(F.col(level) == k, F.col(order)), ignorenulls=True).over(before)) for k in range(1, depth)]
    return rows.withColumn("parent", F.array_max(F.array(*last)))


def with_suffix(rows: DataFrame, base: str, order: str, name: str = "unique_id") -> DataFrame:
    """Base ids made unique in order: the second gets -2, the third -3."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn(name, F.concat(F.col(base), F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")))


def directory_chain(paths: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(ids of all ancestor directories, contains edges parent to child) of POSIX paths; the root is '.'."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    # Pairs of a prefix and the prefix one part longer.
    edge = paths.where(F.size(parts) > 0).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda k: F.struct(
                    F.when(k == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), k - 1), "/")).alias("parent"),
                    F.array_join(F.slice(parts, F.lit(1), k), "/").alias("child"),
                ),
            )
        ).alias("e")
    )
    edges = edge.select("e.parent", "e.child").distinct()
    return edges.select(F.col("parent").alias("id")).distinct(), edges


def merge_segments(segments: DataFrame, group: str, least_chars: int = 400, least_seconds: float = 30.0) -> DataFrame:
    """segments (group, start_sec, end_sec, text) in order to chunks: a segment joins the open chunk,
    which closes once a second or later one makes it ``least_chars`` long or ``least_seconds``
    wide. group, ordinal, start_sec, end_sec, text."""
    text = F.trim("text")
    rows = segments.where(text != "").groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("start_sec", "end_sec", text.alias("text")))).alias("s")
    )
    chunk = "struct<start_sec:double,end_sec:double,text:string>"
    empty = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))

    def step(state, s):
        opened = F.struct(s["start_sec"].cast("double").alias("start_sec"), s["end_sec"].cast("double").alias("end_sec"), s["text"].alias("text"))
        grown = F.struct(
            state["open"]["start_sec"].alias("start_sec"), s["end_sec"].cast("double").alias("end_sec"), F.concat_ws(" ", state["open"]["text"], s["text"]).alias("text")
        )
        full = (F.length(grown["text"]) >= least_chars) | (grown["end_sec"] - grown["start_sec"] >= least_seconds)
        nothing = F.lit(None).cast(chunk)
        return F.struct(
            F.when(state["open"].isNotNull() & full, F.concat(state["done"], F.array(grown))).otherwise(state["done"]).alias("done"),
            F.when(state["open"].isNull(), opened).when(full, nothing).otherwise(grown).alias("open"),
        )

    def close(state):
        return F.when(state["open"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    return rows.select(group, F.posexplode(F.aggregate("s", empty, step, close)).alias("ordinal", "c")).select(group, "ordinal", "c.*")


def same_stem(media: DataFrame, files: DataFrame) -> DataFrame:
    """media (id) to the only one of ``files`` (id) whose name without suffix is the same in lower case:
    source, target. Files named by a suffix alone have no stem."""

    def stem(df, name):
        base = F.lower(F.regexp_extract("id", "[^/]+$", 0))
        return df.select(F.col("id").alias(name), F.regexp_extract(base, r"^(.+?)(\.[^.]*)?$", 1).alias("stem")).where("stem <> ''")

    return stem(media, "source").join(unique_key(stem(files, "target"), "stem", "target"), "stem").where("source <> target").select("source", "target")
