"""A question, the subgraph that supports it and, with a model, an answer that cites it."""

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api, models
from .operators import merge as M
from .sources import graph_json as J

ENVELOPE_VERSION = "1.0.0"  # fixed: version of the envelope below
FACT_CHARS, EXCERPT_CHARS, SAMPLE_HITS = 12_000, 200, 5

RULES = (
    "Use nothing but the facts given below to answer. Name no file, symbol or relation that they do not hold. "
    "Mark what supports each statement: [node:<id>] for a node, [edge:<source>-><target>:<type>] for an edge. Keep it short."
)


def facts(nodes: DataFrame, links: DataFrame, most: int = FACT_CHARS) -> str:
    """The subgraph as lines for a model, ``most`` characters at most. Lines are made by the
    executors; no more of them come to the driver than can fit."""
    nodes = api._with_text_columns(nodes)
    flat = F.substring(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "), 1, EXCERPT_CHARS)
    about = F.concat_ws("; ", F.col("type"), F.nullif("name", F.lit("")), F.nullif(flat, F.lit("")))
    of_nodes = nodes.select(F.concat_ws(" | ", "id", about).alias("line"), F.col("ord") if "ord" in nodes.columns else F.lit(0).alias("ord"))
    of_links = links.select(F.format_string("%s -> %s | %s, %s", "source", "target", "type", F.coalesce("provenance", F.lit("extracted"))).alias("line"))
    fit = most // 4
    lines = ["NODES", *(r.line for r in of_nodes.orderBy("ord", "line").limit(fit).collect())]
    lines += ["EDGES", *(r.line for r in of_links.orderBy("line").limit(fit).collect())]
    whole, mark = "\n".join(lines), "\n(cut)"
    return whole if len(whole) <= most else whole[: most - len(mark)] + mark


def cite(text: str, hits: list[str], nodes: DataFrame, links: DataFrame) -> tuple[str, list[dict]]:
    """The text and what it cites of the subgraph; one that cites nothing valid gets the best hits."""
    spark = nodes.sparkSession
    found = M.citations(spark.createDataFrame([("a", text)], "id string, text string"), nodes, links)
    rows = found.orderBy(F.desc("kind"), "ordinal").collect()  # as many as the text holds
    if not rows:
        ranked = spark.createDataFrame(list(zip(hits, range(len(hits)))), "id string, rank int")
        rows = M.fallback_citations(ranked, nodes, links).orderBy(F.desc("kind"), "ordinal").collect()
        if rows:
            text += "\n\nSources: " + ", ".join(r.node_id or f"{r.source}->{r.target}:{r.type}" for r in rows)
    as_dict = {"node": lambda r: {"node_id": r.node_id}, "edge": lambda r: {"source": r.source, "target": r.target, "edge_type": r.type}}
    return text, [{"kind": r.kind, **as_dict[r.kind](r)} for r in rows]


def answer(question: str, hits: list[str], nodes: DataFrame, links: DataFrame, chat=None, list_models=None, model: str | None = None) -> dict:
    """status (ok, skipped or failed), text, detail, citations. ``chat(system, user)`` gives the text.
    No model, or one that ``list_models()`` does not name, skips the answer; a model that raises or
    says nothing fails it. Neither ever fails the query."""
    other = lambda status, detail: {"status": status, "text": None, "detail": detail, "citations": []}
    if chat is None:
        return other("skipped", "no model is set")
    try:
        if list_models is not None and not models.is_there(model or "", list_models()):
            return other("skipped", f"the model {model} is not there")
    except Exception as e:
        return other("skipped", f"no list of models: {e}")
    try:
        said = chat(RULES, f"{question}\n\nBest matches: {', '.join(hits)}\n\n{facts(nodes, links)}")
    except Exception as e:
        return other("failed", str(e))
    if not isinstance(said, str) or not said.strip():
        return other("failed", "the model said nothing")
    text, cited = cite(said.strip(), hits, nodes, links)
    return {"status": "ok", "text": text, "detail": None, "citations": cited}


def summary(nodes: DataFrame, links: DataFrame, hits: list[str], truncated: bool, output: str) -> dict:
    """Counts of the subgraph, types by count, and its first hits."""
    types = nodes.groupBy("type").count().orderBy(F.desc("count"), "type").collect()  # a row a type
    return {
        "node_count": sum(r["count"] for r in types), "edge_count": links.count(), "node_type_counts": {r.type: r["count"] for r in types},
        "sample_hit_ids": hits[:SAMPLE_HITS], "truncated": truncated, "output_path": output,
    }


def ask(spark, question: str, graph: str, output: str | None = None, k: int = 20, hops: int = 1, threshold: float = 0.40, cap: int = 500,
        embed=None, chat=None, list_models=None, model: str | None = None, no_answer: bool = False) -> dict:
    """The envelope of a question to a graph document; the supporting subgraph is written to
    ``output`` (beside the graph by default), whole or not at all."""
    nodes, links, meta = J.read_graph(spark, graph)
    notes: list[str] = []
    near, edges, found, cut = api.query(nodes, links, question, k, hops, threshold, cap, embed=embed, notes=notes)
    hits = [r.id for r in found]
    output = output or os.path.join(os.path.dirname(os.path.abspath(graph)), "query_subgraph.json")
    about = {key: meta[key] for key in ("project_root",) if key in meta}
    about |= {"generated_at": api.now(), "query_question": question, "query_hit_ids": hits, "query_k": k, "query_hops": hops}
    about |= {"query_hit_scores": {r.id: float(r.score) for r in found}} | ({"query_truncated": True} if cut else {})
    output = J.write_graph(output, near, edges, about)
    said = answer(question, hits, near, edges, None if no_answer else chat, list_models, model)
    return {
        "schema_version": ENVELOPE_VERSION, "question": question, "output": output, "k": k, "hops": hops, "hit_ids": hits, "truncated": cut,
        "embed_note": notes[0] if notes else None, "visualization": summary(near, edges, hits, cut, output), "answer": said,
    }
