import json
import threading
import urllib.error
import urllib.request

import pytest

from quillmesh import answers, api, serve
from quillmesh.sources import graph_json as J


@pytest.fixture()
def graph(tmp_path):
    texts = {"a.md": "tokens are checked at login", "b.md": "a cache of images", "c.md": "login asks for a password"}
    nodes = [{"id": i, "type": "file", "metadata": {"text": t}} for i, t in texts.items()] + [{"id": ".", "type": "dir", "metadata": {}}]
    links = [{"source": ".", "target": i, "type": "contains", "provenance": "extracted"} for i in texts]
    path = tmp_path / "g.json"
    path.write_text(json.dumps({"schema_version": J.SCHEMA_VERSION, "directed": True, "multigraph": False, "graph": {"project_root": "/p"}, "nodes": nodes, "links": links}))
    return str(path)


def test_envelope_without_a_model(spark, graph):
    got = answers.ask(spark, "login", graph, k=1, hops=1)
    assert got["schema_version"] == "1.0.0" and got["hit_ids"] and got["answer"] == {"status": "skipped", "text": None, "detail": "no model is set", "citations": []}
    kept = J.load_document(got["output"])
    assert kept["graph"]["query_hit_ids"] == got["hit_ids"] and kept["graph"]["project_root"] == "/p"
    seen = got["visualization"]
    assert seen["node_count"] == len(kept["nodes"]) and seen["edge_count"] == len(kept["links"]) and seen["sample_hit_ids"] == got["hit_ids"]


def test_answers_cite_the_subgraph_or_fall_back(spark, graph):
    said = []

    def chat(system, user):
        said.append(user)
        return "Here [node:a.md] [node:gone] [edge:.->a.md:contains] [edge:.->gone:contains]"

    got = answers.ask(spark, "tokens checked login", graph, k=1, chat=chat)["answer"]
    assert got["status"] == "ok" and got["citations"] == [{"kind": "node", "node_id": "a.md"}, {"kind": "edge", "source": ".", "target": "a.md", "edge_type": "contains"}]
    assert "tokens are checked at login" in said[0]
    plain = answers.ask(spark, "tokens checked login", graph, k=1, chat=lambda s, u: "By tokens.")["answer"]
    assert plain["citations"] == got["citations"] and plain["text"].endswith("Sources: a.md, .->a.md:contains")


def test_models_that_fail_never_fail_the_query(spark, graph):
    def broken(*_):
        raise OSError("down")

    for options, status in (({"chat": broken}, "failed"), ({"chat": lambda s, u: " "}, "failed"), ({"chat": broken, "list_models": list, "model": "m"}, "skipped"), ({"chat": broken, "list_models": broken}, "skipped")):
        assert answers.ask(spark, "login", graph, **options)["answer"]["status"] == status
    got = answers.ask(spark, "login", graph, embed=broken)
    assert "down" in got["embed_note"] and got["hit_ids"] == answers.ask(spark, "login", graph)["hit_ids"]


def test_vectors_raise_a_hit(spark, graph):
    nodes, links, _ = J.read_graph(spark, graph)
    embed = lambda texts: [[1.0, 0.0]] + [[1.0, 0.0] if "images" in t else [0.0, 1.0] for t in texts[1:]]
    with pytest.raises(api.NoEvidenceError):
        api.query(nodes, links, "zzzz", threshold=0.9)
    hits = api.query(nodes, links, "zzzz", threshold=0.9, embed=embed)[2]
    assert [(r.id, r.score) for r in hits] == [("b.md", 1.0)]


def test_facts_are_cut(spark, graph):
    nodes, links, _ = J.read_graph(spark, graph)
    whole = answers.facts(nodes, links)
    assert whole.startswith("NODES\n") and "\nEDGES\n" in whole
    assert len(answers.facts(nodes, links, 60)) == 60


def test_http(spark, graph, tmp_path):
    server = serve.server(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def post(path, body):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        status, got = post("/query", {"question": "login", "input": graph, "output": str(tmp_path / "s.json"), "no_answer": True})
        assert status == 200 and got["ok"] and got["output"] == str(tmp_path / "s.json") and got["answer"]["status"] == "skipped"
        assert post("/query", {"question": "login", "input": str(tmp_path / "none.json")})[0] == 404
        assert post("/query", {"question": " ", "input": graph})[0] == post("/index", {})[0] == post("/index", [])[0] == 422
        assert post("/query", {"question": "qqqq", "input": graph, "match_threshold": 0.99})[1]["code"] == "no_evidence"
        assert post("/query", {"question": "login", "input": graph, "k": 0})[1]["code"] == "validation"
        (tmp_path / "p").mkdir()
        (tmp_path / "p" / "m.py").write_text("def f():\n    pass\n")
        status, got = post("/index", {"project_path": str(tmp_path / "p"), "output": str(tmp_path / "i.json"), "include_graph": True})
        assert status == 200 and any(n["id"] == "m.py" for n in got["graph"]["nodes"]) and got["stats"]["node"]["file"] == 1
    finally:
        server.shutdown()
        server.server_close()
