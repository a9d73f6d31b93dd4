"""Merging graphs, validation, citations, cache probes, export."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.deal import deal
from ..plans.model import CODE_TYPES, CONCEPT_KINDS, EDGE_TYPES, HEADING_SOURCES, NODE_TYPES, PROVENANCE
from .edges import dangling
from .expand import settle


class MergeConflictError(Exception):
    pass


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union with the number of each input as ``input``."""
    numbered = [f.withColumn("input", F.lit(k)) for k, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


WORD = 63  # inputs that one number holds as bits


def seen_inputs(inputs: int) -> tuple[list, Column]:
    """Aggregates of ``input`` as bits, and the inputs they hold in order. Numbers, unlike a set, leave an
    aggregation that sorts to sort once."""
    words = [(f"_w{at}", at, min(at + WORD, inputs)) for at in range(0, inputs, WORD)]
    bit = lambda k: F.when(F.col("input") == k, F.lit(1 << (k % WORD)).cast("long"))
    masks = [F.bit_or(F.coalesce(*[bit(k) for k in range(a, b)])).alias(w) for w, a, b in words]
    held = [F.when(F.col(w).bitwiseAND(F.lit(1 << (k % WORD)).cast("long")) != 0, F.lit(k)) for w, a, b in words for k in range(a, b)]
    return masks, F.array_compact(F.array(*held)).alias("inputs")


def bodies(payload: list[str]) -> list:
    """The least and the greatest payload; where they are one, all rows agree."""
    body = F.struct(*payload)
    return [F.min(body).alias("_a"), F.max(body).alias("_b")]


DIFFERS = "not (_a <=> _b)"


def conflicts(rows: DataFrame, keys: list[str], payload: list[str], inputs: int) -> DataFrame:
    """Keys whose payload differs between rows of ``inputs`` inputs, with the inputs that hold them."""
    masks, held = seen_inputs(inputs)
    return deal(rows, *keys).groupBy(*keys).agg(*bodies(payload), *masks).where(DIFFERS).select(*keys, held)


def merge_rows(rows: DataFrame, keys: list[str], payload: list[str], inputs: int) -> tuple[DataFrame, DataFrame]:
    """One row for each key, the first by (input, ord), and the conflicts: both of one aggregation, which
    is settled."""
    rest = [c for c in rows.columns if c not in (*keys, "input", "ord")]
    order = F.struct(*[c for c in ("input", "ord") if c in rows.columns])
    first = [F.min_by(F.struct(*rest), order).alias("_r")] if rest else []
    masks, held = seen_inputs(inputs)
    seen = deal(rows, *keys).groupBy(*keys).agg(*first, *bodies(payload), *masks)
    bad = F.when(F.expr(DIFFERS), held).alias("_inputs")
    done = settle(seen.select(*keys, *[f"_r.{c}" for c in rest], bad))
    return done.drop("_inputs"), done.where("_inputs is not null").select(*keys, F.col("_inputs").alias("inputs"))


def merge_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of (nodes, links); equal rows are one, differing ones raise and name their inputs."""
    if len(graphs) < 2:
        raise ValueError("merge needs two inputs or more")
    nodes, links = stack([n for n, _ in graphs]), stack([x for _, x in graphs])
    blank = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("evidence", "reason") if c in links.columns]
    links = links.select(*[c for c in links.columns if c not in ("evidence", "reason")], *blank)
    node_body = [c for c in nodes.columns if c not in ("id", "ord", "input")]
    link_keys = ["source", "target", "type", "provenance"]
    link_body = [c for c in links.columns if c not in (*link_keys, "ord", "input")] or ["type"]
    merged = []
    for rows, keys, body in ((nodes, ["id"], node_body), (links, link_keys, link_body)):
        kept, clashes = merge_rows(rows, keys, body, len(graphs))
        bad = clashes.orderBy(*keys).limit(5).collect()
        if bad:
            raise MergeConflictError("; ".join(str(r.asDict()) for r in bad))
        merged.append(kept)
    return tuple(merged)


def shared_or_drop(values: list[dict]) -> dict:
    """Metadata that every input has with the same value."""
    first, *rest = values
    return {k: v for k, v in first.items() if all(k in r and r[k] == v for r in rest)}


def violations(nodes: DataFrame, links: DataFrame, shown=lambda name: F.col(name)) -> DataFrame:
    """rule, what: everything the format forbids, ids as ``shown`` says. One scan of each table for all
    row rules, and an anti join for both ends."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    code, kind = F.col("type").isin(*CODE_TYPES), F.col("type")
    no_line = F.coalesce(F.col("start_line"), F.lit(0)) < 1
    node_rules = {
        "node_type": ~F.coalesce(kind.isin(*NODE_TYPES), F.lit(False)),
        "node_id": blank("id"),
        "code_metadata": code & (blank("name") | blank("language") | blank("file") | no_line),
        "heading_metadata": (kind == "heading") & (blank("name") | blank("file") | ~F.coalesce(F.col("source").isin(*HEADING_SOURCES), F.lit(False))),
        "heading_place": (kind == "heading") & no_line & (F.coalesce(F.col("page"), F.lit(0)) < 1),
        "media_text": (kind == "media_text") & (blank("file") | F.col("text").isNull() | ~F.col("source").eqNullSafe("ocr")),
        "transcript": (kind == "transcript_chunk")
        & (blank("file") | F.col("text").isNull() | ~F.col("source").eqNullSafe("whisper") | F.coalesce(F.col("end_sec") < F.col("start_sec"), F.lit(True))),
        "concept": (kind == "concept") & (blank("name") | (F.col("kind").isNotNull() & ~F.col("kind").isin(*CONCEPT_KINDS))),
    }
    needs = F.col("type").isin("implements", "depends_on")
    inferred = F.col("provenance").eqNullSafe("inferred")
    link_rules = {
        "edge_type": ~F.coalesce(kind.isin(*EDGE_TYPES), F.lit(False)),
        "provenance": ~F.coalesce(F.col("provenance").isin(*PROVENANCE), F.lit(False)),
        "related_to": (kind == "related_to") & ~inferred,
        "claim_confidence": needs & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "claim_evidence": needs & blank("evidence"),
        "claim_provenance": needs & ~inferred,
    }

    def broken(df, rules, what):
        tests = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
        return df.select(F.explode(tests).alias("rule"), what.alias("what"))

    pair = F.concat_ws(" -> ", shown("source"), shown("target"))
    lost = dangling(nodes, links).select(F.concat(F.lit("dangling_"), "end").alias("rule"), pair.alias("what"))
    twice = deal(nodes.select("id"), "id").groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("rule"), shown("id").alias("what"))
    return reduce(DataFrame.unionByName, [broken(nodes, node_rules, shown("id")), broken(links, link_rules, pair), lost, twice])


# Fixed patterns: how an answer cites a node or an edge.
NODE_CITATION = r"\[node:([^\]]+)\]"
EDGE_CITATION = r"\[edge:([^\]\-]+)->([^\]:]+):([^\]]+)\]"
CITED = "answer_id", "kind", "ordinal", "node_id", "source", "target", "type"


def citations(answers: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """answers (id, text): what each cites that the subgraph holds, once each: answer_id, kind (node or
    edge), ordinal (of the kind in the text, from 0), node_id, source, target, type. Everything else in
    brackets is no citation."""
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]

    def said(pattern, group):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda v: F.trim(v))

    cited = answers.select(F.col("id").alias("answer_id"), F.posexplode(F.array_distinct(said(NODE_CITATION, 1))).alias("ordinal", "node_id"))
    held = cited.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    ends = F.arrays_zip(*[said(EDGE_CITATION, k + 1).alias(c) for k, c in enumerate(CITED[4:])])
    crossed = answers.select(F.col("id").alias("answer_id"), F.posexplode(F.array_distinct(ends)).alias("ordinal", "e")).select("answer_id", "ordinal", "e.*")
    crossed = crossed.join(links.select(*CITED[4:]), list(CITED[4:]), "left_semi")
    return held.select("answer_id", F.lit("node").alias("kind"), "ordinal", "node_id", *none(*CITED[4:])).unionByName(
        crossed.select("answer_id", F.lit("edge").alias("kind"), "ordinal", *none("node_id"), *CITED[4:])
    )


def fallback_citations(hits: DataFrame, nodes: DataFrame, links: DataFrame, max_nodes: int = 5, max_edges: int = 3) -> DataFrame:
    """What an answer without valid citations cites: the best ``max_nodes`` hits (id, rank) of the
    subgraph and the first ``max_edges`` edges, by ends and type, that touch a hit. kind, ordinal,
    node_id, source, target, type."""
    keep = hits.select("id", "rank").groupBy("id").agg(F.min("rank").alias("rank"))
    first = keep.join(nodes.select("id"), "id", "left_semi").orderBy("rank", "id").limit(max_nodes)
    ids = keep.select("id")
    touching = links.select(*CITED[4:]).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(
        links.select(*CITED[4:]).join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    edges = touching.distinct().orderBy(*CITED[4:]).limit(max_edges)
    number = lambda *order: (F.row_number().over(Window.orderBy(*order)) - 1).alias("ordinal")  # noqa: E731  (a few rows)
    return first.select(F.lit("node").alias("kind"), number("rank", "id"), F.col("id").alias("node_id"), *[F.lit(None).cast("string").alias(c) for c in CITED[4:]]).unionByName(
        edges.select(F.lit("edge").alias("kind"), number(*CITED[4:]), F.lit(None).cast("string").alias("node_id"), *CITED[4:])
    )


def cache_probe(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (kind, key, content_hash, settings_hash) against stored rows with a payload: outcome is
    hit, recovered (there, but without its payload) or miss."""
    keys = ["kind", "key", "content_hash", "settings_hash"]
    have = store.groupBy(*keys).agg(F.max("payload").alias("payload"), F.lit(True).alias("there"))
    found = wanted.join(have, keys, "left")
    outcome = F.when(F.col("there").isNull(), "miss").when(F.col("payload").isNull(), "recovered").otherwise("hit")
    return found.select(*wanted.columns, "payload", outcome.alias("outcome"))


def cache_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row for each (kind, key) by ``ord``."""
    rest = [c for c in store.columns if c not in ("kind", "key")]
    both = store.unionByName(new)
    return both.groupBy("kind", "key").agg(F.max_by(F.struct(*rest), "ord").alias("r")).select("kind", "key", "r.*")


# Fixed lines of a DOT file.
DOT_HEAD, DOT_TAIL = ["digraph G {", '  rankdir="LR";'], ["}"]


def dot_lines(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """section (1 nodes, 2 links), ord (of the document; null where it has none), line."""
    escape = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    place = lambda df: (F.col("ord") if "ord" in df.columns else F.lit(None)).cast("long").alias("ord")
    label = F.concat(escape(F.col("id")), F.lit("\\n("), escape(F.col("type")), F.lit(")"))
    n = nodes.select(F.lit(1).alias("section"), place(nodes), F.concat(F.lit('  "'), escape(F.col("id")), F.lit('" [label="'), label, F.lit('"];')).alias("line"))
    e = links.select(
        F.lit(2).alias("section"), place(links),
        F.concat(F.lit('  "'), escape(F.col("source")), F.lit('" -> "'), escape(F.col("target")), F.lit('" [label="'), escape(F.col("type")), F.lit('"];')).alias("line"),
    )
    return n.unionByName(e)


def scan_cost(files: DataFrame, is_code, max_size: int) -> DataFrame:
    """files (id, size_bytes): n_files, total_bytes, non_code_share (0 when nothing), oversize."""
    total = F.coalesce(F.sum("size_bytes"), F.lit(0))
    other = F.coalesce(F.sum(F.when(~is_code, F.col("size_bytes"))), F.lit(0))
    return files.agg(
        F.count("*").alias("n_files"), total.alias("total_bytes"), F.coalesce(other / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("non_code_share"),
        F.count_if(F.col("size_bytes") > max_size).alias("oversize"),
    )


class LargeRepoError(Exception):
    def __init__(self, gates: list[str]):
        super().__init__("; ".join(gates))
        self.tripped_gates = gates


def enforce_gates(cost: dict, limits: dict, code_only: bool = False, allow: bool = False) -> None:
    """Bytes and files are hard limits; scan operations and (code only) the share of other bytes are
    advisory, which ``allow`` waives. Limits are passed only when exceeded."""
    hard = [k for k in ("total_bytes", "n_files") if k in limits and cost[k] > limits[k]]
    soft = [k for k in ("scan_ops", *(("non_code_share",) if code_only else ())) if k in limits and cost.get(k, 0) > limits[k]]
    tripped = hard + ([] if allow else soft)
    if tripped:
        raise LargeRepoError(tripped)
