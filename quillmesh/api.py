"""index, query, explain, path, merge: the engine's calls, each over a SparkSession."""

from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import edges as E
from .operators import enrich as N
from .operators import expand as G
from .operators import extract
from .operators import links as L
from .operators import media
from .operators import merge as M
from .plans.model import slug
from .sources import files as S
from .sources import graph_json as J


class NoEvidenceError(Exception):
    pass


class EndpointUnresolvedError(G.PathError):
    def __init__(self, failed):
        super().__init__(f"no match for {', '.join(failed)}")
        self.failed = failed


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def stats_to_dict(stats: DataFrame) -> dict:
    """``operators.edges.stats``, a few rows, as {"node": {type: n}, "edge": {type: n}}."""
    rows = stats.collect()
    return {what: {r.type: r.n for r in rows if r.what == what} for what in ("node", "edge")}


# --- index ----------------------------------------------------------------------------------

ENTITY = "file string, language string, kind string, name string, start_line int, end_line int"


def index(spark, root: str, ignored: list[str] = (), include_docs: bool = True, max_file_size: int = 10_485_760,
          limits: dict | None = None, code_only: bool = False, scan_bytes: int = 262_144,
          languages: list[str] | None = None, allow_large: bool = False, pdf=None, ocr=None, speech=None, chat=None,
          confidence: float = 0.5, notes: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a folder: inventory, references by name, code structure, documents and, by readers
    of the caller's (``operators.media``, ``operators.enrich``), PDF outlines, texts of images, speech, and
    concepts that a model finds. What these could not do is added to ``notes``."""
    notes = [] if notes is None else notes
    spoken = S.language("id")
    if languages is not None:
        spoken = F.when(spoken.isin(*languages), spoken)
    inventory = G.settle(S.inventory(spark, root, ignored, max_file_size).withColumn("language", spoken))
    plain = inventory.where("type = 'file' and not symlink and skipped is null")
    scan = plain.where("language is not null") if code_only else plain
    if limits:
        cost = M.scan_cost(inventory.where("type = 'file'"), F.col("language").isNotNull(), max_file_size).first().asDict()
        names = inventory.where("type = 'file'").select(F.regexp_extract("id", "[^/]+$", 0).alias("name"), "id")
        cost["scan_ops"] = scan.count() * E.unique_key(names, "name", "id").count()
        M.enforce_gates(cost, limits, code_only, allow_large)
    files = G.settle(S.contents(spark, root, scan).join(scan.select("id", "language"), "id"))
    nodes = inventory.select("id", "type", "size_bytes", "symlink", "skipped", "language")
    parent = F.when(F.instr("id", "/") == 0, F.lit(".")).otherwise(F.regexp_replace("id", "/[^/]*$", ""))
    candidates = [inventory.where("id <> '.'").select(parent.alias("source"), F.col("id").alias("target"), F.lit(0).alias("phase"), F.lit("").alias("seq"), F.lit("contains").alias("type"))]

    names = inventory.where("type = 'file'").select("id", F.regexp_extract("id", "[^/]+$", 0).alias("name"))
    head = F.substring("content", 1, scan_bytes)
    # A capped read that is not UTF-8 (a cut inside a character too) is skipped whole.
    texts = files.select("id", F.try_validate_utf8(head.cast("string")).alias("text")).where("text is not null")
    found = L.name_references(texts, names)
    candidates.append(found.select("source", "target", F.lit(1).alias("phase"), F.lit("").alias("seq"), F.lit("references").alias("type")))

    facts = files.where("language is not null").mapInPandas(_code_facts, "file string, fact string, language string, kind string, name string, start_line int, end_line int, owner string, candidates array<string>, names array<string>, seq int")
    facts = G.settle(facts)
    entities = facts.where("fact = 'entity'").select("file", "language", "kind", "name", "start_line", "end_line")
    entities = _methods(entities.distinct())
    entities = G.settle(entities.withColumn("id", F.concat_ws("::", "file", "kind", "name", F.col("start_line").cast("string"))))
    seq = F.format_string("%08d", F.col("start_line"))
    candidates.append(entities.select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit(2).alias("phase"), seq.alias("seq"), F.lit("defines").alias("type")))
    candidates.append(entities.where("class_id is not null").select(F.col("class_id").alias("source"), F.col("id").alias("target"), F.lit(2).alias("phase"), seq.alias("seq"), F.lit("defines").alias("type")))
    candidates.append(_imports(facts, inventory, entities))
    calls = facts.where("fact = 'call'").select(F.coalesce("owner", "file").alias("caller"), "file", "name")
    callables = entities.where("kind in ('function', 'method')").select("id", "file", "name")
    made = E.local_then_global(calls, callables)
    candidates.append(made.select(F.col("caller").alias("source"), "target", F.lit(4).alias("phase"), F.lit("").alias("seq"), F.lit("calls").alias("type")))
    nodes = nodes.unionByName(
        entities.select("id", F.col("kind").alias("type"), "name", "language", "file", "start_line", "end_line", "qualified_name"), allowMissingColumns=True
    )
    if include_docs:
        doc_nodes, doc_edges = _documents(files, inventory)
        nodes = nodes.unionByName(doc_nodes, allowMissingColumns=True)
        candidates += doc_edges
    nodes = G.settle(nodes)
    pdf = pdf if include_docs else None
    if pdf is not None or ocr is not None or speech is not None:
        made, more, skipped = media.add_media(S.contents(spark, root, plain), nodes, pdf, ocr, speech)
        nodes = G.settle(nodes.unionByName(made, allowMissingColumns=True))
        candidates += more
        notes += [f"{r.id}: {r.error}" for r in skipped.orderBy("id").toLocalIterator()]
    every = candidates[0]
    for c in candidates[1:]:
        every = every.unionByName(c, allowMissingColumns=True)
    won = E.first_edge_wins(every, nodes)
    guessed = F.when(F.col("type") == "related_to", "inferred").otherwise("extracted")
    links = won.select("*", guessed.alias("provenance"), F.lit(None).cast("double").alias("confidence"))
    if chat is not None:
        nodes, links, counts = N.enrich(nodes, G.settle(links), S.contents(spark, root, plain), chat, confidence)
        notes.append(", ".join(f"{k} {n}" for k, n in counts.items()))
    return nodes, links


def _code_facts(batches):
    import pandas as pd

    columns = ["file", "fact", "language", "kind", "name", "start_line", "end_line", "owner", "candidates", "names", "seq"]
    for batch in batches:
        rows = []
        for file, data, language in zip(batch["id"], batch["content"], batch["language"]):
            facts = extract.code_facts(language, bytes(data))
            if facts is None:
                continue
            rows += [(file, "entity", language, kind, name, a, b, None, None, None, None) for kind, name, a, b in facts[0]]
            rows += [(file, "import", language, None, m, None, None, None, extract.import_candidates(language, file, m, dots), names, k) for k, (m, dots, names) in enumerate(facts[1])]
            rows += [(file, "call", language, None, name, None, None, owner and f"{file}::{owner[0]}::{owner[1]}::{owner[2]}", None, None, k) for k, (name, owner) in enumerate(facts[2])]
        frame = pd.DataFrame(rows, columns=columns)
        for c in ("start_line", "end_line", "seq"):
            frame[c] = frame[c].astype("Int32")
        yield frame


def _methods(entities: DataFrame) -> DataFrame:
    """Functions that start inside a class are methods of the first such class."""
    classes = entities.where("kind = 'class'").select("file", F.col("name").alias("of"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    inside = entities.where("kind in ('function', 'method')").join(classes, "file").where("start_line between a and b")
    first = inside.groupBy("file", "kind", "name", "start_line").agg(F.min(F.struct("a", "of")).alias("c"))
    joined = entities.join(first, ["file", "kind", "name", "start_line"], "left")
    is_method = F.col("c").isNotNull()
    return joined.select(
        "file", "language", F.when(is_method, F.lit("method")).otherwise(F.col("kind")).alias("kind"), "name", "start_line", "end_line",
        F.when(is_method, F.concat_ws("::", "file", F.lit("class"), F.col("c.of"), F.col("c.a").cast("string"))).alias("class_id"),
        F.when(is_method, F.concat_ws(".", F.col("c.of"), "name")).alias("qualified_name"),
    )


def _imports(facts: DataFrame, inventory: DataFrame, entities: DataFrame) -> DataFrame:
    """The one candidate that is a file; in it the one symbol that any imported name has, else the
    file itself."""
    asked = facts.where("fact = 'import'").select("file", "seq", "names", F.explode("candidates").alias("target"))
    hit = asked.join(inventory.where("type = 'file'").select(F.col("id").alias("target")), "target", "left_semi")
    one = hit.groupBy("file", "seq").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n"), F.first("names").alias("names")).where("n = 1")
    symbols = one.select("file", "seq", "target", F.explode("names").alias("name")).join(
        entities.select(F.col("file").alias("target"), "name", "id"), ["target", "name"]
    )
    symbol = symbols.groupBy("file", "seq").agg(F.min("id").alias("id"), F.count("*").alias("hits")).where("hits = 1")
    return one.join(symbol, ["file", "seq"], "left").select(
        F.col("file").alias("source"), F.coalesce("id", "target").alias("target"), F.lit(3).alias("phase"), F.format_string("%08d", "seq").alias("seq"), F.lit("imports").alias("type")
    )


def _documents(files: DataFrame, inventory: DataFrame):
    """Headings as nodes with section_of edges; links as mentions."""

    def facts(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for file, data in zip(batch["id"], batch["content"]):
                text = bytes(data).decode("utf-8", "replace")
                source = {"md": "markdown", "rst": "rst"}.get(file.rpartition(".")[2], "txt")
                headings, links = extract.markdown_facts(text) if source == "markdown" else extract.rst_facts(text)
                rows += [(file, source, "heading", k, level, name, line) for k, (level, name, line) in enumerate(headings)]
                rows += [(file, source, "link", s if s is not None else -1, None, target, None) for target, s in links]
            frame = pd.DataFrame(rows, columns=["file", "source", "fact", "k", "level", "name", "start_line"])
            for c in ("level", "start_line", "k"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    docs = files.where(F.col("id").rlike(r"\.(md|markdown|rst|txt)$"))
    found = G.settle(docs.mapInPandas(facts, "file string, source string, fact string, k int, level int, name string, start_line int"))
    base = found.where("fact = 'heading'").withColumn("base", F.concat_ws("::", "file", F.lit("heading"), slug(F.col("name")), F.col("start_line").cast("string")))
    headings = G.settle(L.outline(L.with_suffix(base, "base", "k", "id"), "file", "k", "level", 8))
    up = headings.select("file", F.col("k").alias("parent"), F.col("id").alias("up"))
    nested = headings.join(up, ["file", "parent"], "left")
    nodes = headings.select("id", F.lit("heading").alias("type"), "name", "file", "source", "start_line", "level")
    edges = [nested.select(F.col("id").alias("source"), F.coalesce("up", "file").alias("target"), F.lit(5).alias("phase"), F.format_string("%08d", "k").alias("seq"), F.lit("section_of").alias("type"))]

    # Link targets: external ones go; '#name' in the file; a relative path; a name that one file has.
    asked = found.where("fact = 'link'").where(~F.col("name").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//")).withColumn("path", F.regexp_replace("name", "#.*$", ""))
    said = F.nullif(F.regexp_extract("name", "#(.*)$", 1), F.lit(""))
    asked = asked.withColumn("fragment", slug(F.coalesce(F.try_url_decode(F.replace(said, F.lit("+"), F.lit("%2B"))), said)))
    unquoted = F.try_url_decode(F.replace(F.regexp_replace("path", r"\?.*$", ""), F.lit("+"), F.lit("%2B")))
    asked = asked.withColumn("path", F.coalesce(unquoted, F.col("path")))
    whole = F.split(F.concat_ws("/", F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")), "path"), "/")
    folded = F.aggregate(
        whole, F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((p == "") | (p == "."), a).otherwise(F.concat(a, F.array(p))),
    )
    asked = asked.withColumn("target", F.when(F.col("path") == "", F.col("file")).otherwise(F.array_join(folded, "/")))
    ids = inventory.where("type = 'file'").select(F.col("id").alias("target"), F.col("id").alias("exact"))
    # A name that one file has stands for it, where no folder is named.
    base_name = E.unique_key(inventory.where("type = 'file'").select(F.regexp_extract("id", "[^/]+$", 0).alias("path"), F.col("id").alias("by_name")), "path", "by_name")
    placed = asked.join(ids, "target", "left").join(base_name, "path", "left").withColumn("to_file", F.coalesce("exact", "by_name")).where("to_file is not null")
    unique_slug = headings.withColumn("fragment", slug(F.col("name"))).groupBy("file", "fragment").agg(F.min("id").alias("to_heading"), F.count("*").alias("n")).where("n = 1")
    placed = placed.join(unique_slug.select(F.col("file").alias("to_file"), "fragment", "to_heading"), ["to_file", "fragment"], "left")
    section = headings.select("file", "k", F.col("id").alias("section"))
    placed = placed.join(section, ["file", "k"], "left")
    edges.append(
        placed.where("path <> '' or to_heading is not null").select(F.coalesce("section", "file").alias("source"), F.coalesce("to_heading", "to_file").alias("target"), F.lit(6).alias("phase"), F.lit("").alias("seq"), F.lit("mentions").alias("type"))
    )
    return nodes, edges


# --- questions ------------------------------------------------------------------------------


def _with_text_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select("*", *[F.lit(None).cast("string").alias(c) for c in X.TEXT_KEYS if c not in nodes.columns])


def _hybrid(scored: DataFrame, phrase: str, embed=None, prefilter: int = 200, notes: list | None = None) -> DataFrame:
    """Adds ``score``: ``fuzzy`` or, for the ``prefilter`` best with text ``t``, the cosine of their
    vectors if that is higher. ``embed`` takes texts and gives as many vectors; one that fails leaves
    the fuzzy scores and a line in ``notes``."""
    plain = scored.withColumn("score", F.col("fuzzy"))
    if embed is None:
        return plain
    few = scored.orderBy(F.desc("fuzzy"), "id").limit(prefilter).select("id", "t").collect()  # bounded by prefilter
    try:
        vectors = [[float(x) for x in v] for v in embed([phrase, *[r.t for r in few]])]
        if len(vectors) != len(few) + 1:
            raise ValueError(f"{len(vectors)} vectors for {len(few) + 1} texts")
    except Exception as e:  # a model is never needed
        if notes is not None:
            notes.append(f"matched without vectors: {e}")
        return plain
    table = scored.sparkSession.createDataFrame([(r.id, v) for r, v in zip(few, vectors[1:])], "id string, v array<double>").dropDuplicates(["id"])
    asked = F.array(*[F.lit(x) for x in vectors[0]]).cast("array<double>")
    near = F.coalesce(X.cosine(F.col("v"), asked), F.lit(0.0))
    return scored.join(F.broadcast(table), "id", "left").withColumn("score", F.greatest("fuzzy", near)).drop("v")


def match(nodes: DataFrame, phrase: str, threshold: float = 0.55, top_n: int = 3, embed=None, prefilter: int = 200) -> list:
    """Best nodes by fuzzy score and, with ``embed`` (texts to vectors), cosine of the ``prefilter``
    best; ties: concepts, shorter ids, ids. A failing model leaves the fuzzy scores."""
    nodes = _with_text_columns(nodes)
    scored = nodes.select("id", "type", X.search_text(nodes.columns).alias("t"), X.fuzzy_score(phrase, nodes.columns).alias("fuzzy"))
    scored = _hybrid(scored, phrase, embed, prefilter)
    best = scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), (F.col("type") != "concept"), F.length("id"), "id")
    return best.limit(max(1, top_n)).select("id", "type", "fuzzy", "score").collect()


def explain(nodes: DataFrame, links: DataFrame, concept: str, hops: int = 2, cap: int = 500, **options):
    """(nodes, links, matches, truncated): the neighbourhood of the concept's best matches."""
    found = match(nodes, concept, **options)
    if not found:
        raise NoEvidenceError(concept)
    n, e, cut = _around(nodes, links, [r.id for r in found], hops, cap)
    return n, e, found, cut


def _loaded(links: DataFrame) -> DataFrame:
    """Links as graph operators see them: of repeated ordered pairs of a document the last."""
    return E.last_link_wins(links) if "ord" in links.columns else links


def _around(nodes, links, seeds, hops, cap):
    links = _loaded(links)
    near, cut = G.neighbourhood(links, seeds, hops, cap)
    ids = nodes.sparkSession.createDataFrame([(i,) for i, _ in near], "id string")
    return *E.induced(nodes, links, F.broadcast(ids)), cut


def query(nodes: DataFrame, links: DataFrame, question: str, k: int = 20, hops: int = 1, threshold: float = 0.40, cap: int = 500,
          embed=None, prefilter: int = 200, notes: list | None = None):
    """(nodes, links, hits, truncated): chunks that answer the question and what is around them.
    ``embed`` and ``prefilter`` as in ``match``; what it could not do is added to ``notes``."""
    if not question.strip():
        raise ValueError("the question is blank")
    if not 1 <= k <= 200:
        raise ValueError("k must be from 1 to 200")
    nodes = _with_text_columns(nodes)
    body = F.nullif(F.trim("text"), F.lit(""))
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord") if "ord" in nodes.columns else F.col("type")))
    corpus = nodes.withColumn("n", first).where("n = 1").withColumn("chunk_text", F.coalesce(body, X.search_text(nodes.columns))).where("chunk_text <> ''")
    scored = corpus.select("id", "type", body.isNotNull().alias("has_body"), F.col("chunk_text").alias("t"), X.chunk_score(question, corpus.columns).alias("fuzzy"))
    scored = _hybrid(scored, question, embed, prefilter, notes)
    order = (F.desc("score"), F.desc("has_body"), F.col("type") != "concept", F.length("id"), F.col("id"))
    hits = scored.where(F.col("score") >= threshold).orderBy(*order).limit(k).select("id", "type", "has_body", "fuzzy", "score").collect()
    if not hits:
        raise NoEvidenceError(question)
    n, e, cut = _around(nodes, links, [r.id for r in hits], hops, cap)
    return n, e, hits, cut


def path(nodes: DataFrame, links: DataFrame, start: str, end: str, max_hops: int = 32, threshold: float = 0.55, **cost) -> dict:
    """The cheapest directed path between the best matches of two phrases."""
    found = [match(nodes, phrase, threshold, 1) for phrase in (start, end)]
    failed = [side for side, m in zip(("start", "end"), found) if not m]
    if failed:
        raise EndpointUnresolvedError(failed)
    ids, steps, total = G.find_path(nodes, _loaded(links), found[0][0].id, found[1][0].id, max_hops, **cost)
    return {"start": found[0][0].id, "end": found[1][0].id, "nodes": ids, "steps": steps, "total_cost": total, "explanation": G.path_sentence(start, end, ids, steps)}


def merge(spark, paths: list[str], output: str) -> str:
    """Merge graph documents; a conflict writes nothing."""
    read = [J.read_graph(spark, p) for p in paths]
    nodes, links = M.merge_graphs([(n, e) for n, e, _ in read])
    roots = list(dict.fromkeys(m.get("project_root") for _, _, m in read if m.get("project_root")))
    meta = M.shared_or_drop([{k: v for k, v in m.items() if k not in ("project_root", "generated_at")} for _, _, m in read])
    meta |= {"generated_at": now(), "merged": True, "merged_from": [str(p) for p in paths]}
    meta |= {"project_root": roots[0]} if len(roots) == 1 else {"project_roots": roots}
    return J.write_graph(output, nodes, links, meta)
