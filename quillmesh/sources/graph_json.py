"""The graph document: JSON, plain or gzipped, read and written whole and atomically."""

import gzip
import json
import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import LINKS, META, SCHEMA_VERSION

NODES = f"id string, type string, ord bigint, {META}"
NUMBERS = {"start_line": int, "end_line": int, "page": int, "end_page": int, "level": int, "ordinal": int, "size_bytes": int, "start_sec": float, "end_sec": float}
KNOWN = [c.strip().split(" ")[0] for c in META.split(", ")]


class GraphError(Exception):
    pass


def load_document(path: str) -> dict:
    with open(path, "rb") as f:
        data = f.read()
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    try:
        found = json.loads(data.decode("utf-8"))
    except ValueError as e:
        raise GraphError(f"not a JSON document: {path}") from e
    if not isinstance(found, dict):
        raise GraphError("the document is not an object")
    if found.get("schema_version") != SCHEMA_VERSION:
        raise GraphError(f"unsupported schema_version {found.get('schema_version')!r}")
    for key in ("nodes", "links"):
        if not isinstance(found.get(key), list):
            raise GraphError(f"{key} is not a list")
    return found


def _node(k: int, node: dict) -> tuple:
    meta = dict(node.get("metadata") or {})
    row = [node.get("id"), node.get("type"), k]
    for name in KNOWN[:-1]:
        value = meta.get(name)
        if name in NUMBERS:
            # True and False are no numbers here.
            good = isinstance(value, (int, float)) and not isinstance(value, bool)
            value = NUMBERS[name](value) if good else None
        elif name == "symlink":
            value = value if isinstance(value, bool) else None
        elif name == "aliases":
            value = [str(v) for v in value] if isinstance(value, list) else None
        else:
            value = value if isinstance(value, str) else None
        row.append(value)
    return (*row, json.dumps(meta, sort_keys=True))


def read_graph(spark, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, links, metadata) of a graph document."""
    found = load_document(path)
    nodes = [_node(k, n) for k, n in enumerate(found["nodes"])]

    def number(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None

    links = [
        (e.get("source"), e.get("target"), e.get("type") or "contains", e.get("provenance") or "extracted", number(e.get("confidence")), e.get("evidence"), e.get("reason"), k)
        for k, e in enumerate(found["links"])
    ]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(links, LINKS), found.get("graph") or {}


def to_document(nodes: DataFrame, links: DataFrame, meta: dict) -> dict:
    """The portable document: optional fields that are empty are left out. It is one file by its
    format, so it is made on the driver."""
    known = [c for c in KNOWN[:-1] if c in nodes.columns]

    def of_node(r):
        if "metadata_json" in nodes.columns and r.metadata_json:
            return json.loads(r.metadata_json)
        return {c: r[c] for c in known if r[c] is not None}

    order = ["ord"] if "ord" in nodes.columns else ["id"]
    rows = nodes.orderBy(*order).toLocalIterator()
    out_nodes = [{"id": r.id, "type": r.type, "metadata": of_node(r)} for r in rows]
    order = ["ord"] if "ord" in links.columns else ["source", "target", "type"]
    out_links = []
    for r in links.orderBy(*order).toLocalIterator():
        link = {"source": r.source, "target": r.target, "type": r.type or "contains", "provenance": r.provenance or "extracted"}
        for c in ("reason", "confidence", "evidence"):
            if c in links.columns and r[c] not in (None, ""):
                link[c] = r[c]
        out_links.append(link)
    return {"schema_version": SCHEMA_VERSION, "directed": True, "multigraph": False, "graph": meta, "nodes": out_nodes, "links": out_links}


def write_atomic(path: str, text: str, compress: bool = False) -> str:
    data = text.encode("utf-8")
    if compress or path.endswith(".gz"):
        data = gzip.compress(data, mtime=0)
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise
    return path


def write_graph(path: str, nodes: DataFrame, links: DataFrame, meta: dict, compress: bool = False, check: bool = True) -> str:
    """Validate, then write; an invalid graph writes nothing."""
    if check:
        from ..operators.merge import violations

        bad = violations(*_complete(nodes, links)).orderBy("rule", "what").limit(1).collect()
        if bad:
            raise GraphError(f"{bad[0].rule}: {bad[0].what}")
    if compress and not path.endswith(".gz"):
        path += ".gz"
    return write_atomic(path, json.dumps(to_document(nodes, links, meta), indent=2, ensure_ascii=False) + "\n", compress)


def _complete(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    kinds = dict(c.strip().split(" ", 1) for c in META.split(", "))
    nodes = nodes.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in nodes.columns])
    return nodes, links.select("*", *[F.lit(None).cast("string").alias(c) for c in ("evidence", "reason") if c not in links.columns])


def next_snapshot(folder: str, compress: bool = False) -> str:
    """graph_vN.json[.gz] with N one above the highest there."""
    taken = [int(m[1]) for f in (os.listdir(folder) if os.path.isdir(folder) else ()) if (m := re.fullmatch(r"graph_v(\d+)\.json(\.gz)?", f))]
    return os.path.join(folder, f"graph_v{max(taken, default=0) + 1}.json" + ".gz" * compress)
