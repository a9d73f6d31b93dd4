"""POST /index and POST /query over HTTP on this machine, one request at a time."""

import json
import os
from http.server import BaseHTTPRequestHandler, HTTPServer

from . import answers, api, config
from .operators.edges import stats
from .operators.merge import LargeRepoError
from .sources import graph_json

#: Which failure gives which status and code, the first that fits.
FAILURES = (
    ((FileNotFoundError, NotADirectoryError), 404, "not_found"),
    (LargeRepoError, 400, "large_repo"),
    (TimeoutError, 408, "timeout"),
    (config.ConfigError, 400, "config"),
    (api.NoEvidenceError, 400, "no_evidence"),
    ((ValueError, graph_json.GraphError, OSError), 400, "validation"),
)


class Invalid(Exception):
    """A body that lacks what it must hold."""


def _text(body: dict, field: str) -> str:
    value = body.get(field)
    if not isinstance(value, str) or not value.strip():
        raise Invalid(f"{field} must be a text that is not blank")
    return value


def do_index(spark, body: dict) -> dict:
    root = _text(body, "project_path")
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    flags = {f: body.get(f) for f in ("output", "code_only", "compress", "versioned", "max_reference_scan_bytes", "max_reference_scan_ops", "max_non_code_share", "max_total_bytes", "max_file_count")}
    flags["large_repo_policy"] = "allow" if body.get("allow_large_repo") else None
    have = config.load(body.get("config"), **flags)
    languages = [x.strip() for x in body["languages"].split(",")] if body.get("languages") else have.languages
    nodes, links = api.index(
        spark, root, config.ignores(have), bool(body.get("include_docs", False)), have.max_file_size, config.limits(have), have.code_only,
        have.max_reference_scan_bytes, languages, have.large_repo_policy == "allow",
    )
    folder = os.path.dirname(os.path.abspath(have.output))
    target = graph_json.next_snapshot(folder, have.compress) if have.versioned else have.output
    meta = {"project_root": os.path.abspath(root), "generated_at": api.now()}
    output = graph_json.write_graph(target, nodes, links, meta, have.compress)
    graph = graph_json.load_document(output) if body.get("include_graph") else None
    return {"output": output, "stats": api.stats_to_dict(stats(nodes, links)), "graph": graph}


def do_query(spark, body: dict, models: dict) -> dict:
    question, graph = _text(body, "question"), _text(body, "input")
    if not os.path.exists(graph):
        raise FileNotFoundError(graph)
    have = config.load(body.get("config"))
    given = lambda field, other: other if body.get(field) is None else body[field]
    return answers.ask(
        spark, question, graph, body.get("output"), given("k", have.query_k), given("hops", have.query_hops), given("match_threshold", have.query_match_threshold),
        have.query_node_cap, no_answer=bool(body.get("no_answer")), model=body.get("llm_model") or have.llm_model, **models,
    )


def respond(spark, path: str, body, **models) -> tuple[int, dict]:
    """(status, reply) of a request; ``models``: embed, chat and list_models, all optional."""
    calls = {"/index": lambda: do_index(spark, body), "/query": lambda: do_query(spark, body, models)}
    if path not in calls:
        return 404, {"ok": False, "error": f"nothing at {path}", "code": "not_found"}
    try:
        if not isinstance(body, dict):
            raise Invalid("the body must be a JSON object")
        return 200, {"ok": True, **calls[path]()}
    except Invalid as e:
        return 422, {"ok": False, "error": str(e), "code": "validation"}
    except Exception as e:
        for kind, status, code in FAILURES:
            if isinstance(e, kind):
                return status, {"ok": False, "error": str(e), "code": code}
        return 500, {"ok": False, "error": "internal error", "code": "internal"}


def server(spark, port: int = 8765, **models) -> HTTPServer:
    """A server on the loopback address; call its ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
            except ValueError:
                body = None
            status, reply = respond(spark, self.path, body, **models)
            data = json.dumps(reply).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
