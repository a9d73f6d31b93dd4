import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quillmesh import api, models


def _pdf(name, data):
    if data == b"locked":
        raise ValueError("locked")
    return ([(1, "Intro", 1), (3, " Deep ", 2), (2, "", 2), (2, "Intro", 1)], []) if data == b"toc" else ([], ["\n  First line\nmore", "", "x" * 130])


def _ocr(name, data):
    return {b"a": "  the login session token redis ", b"b": " "}[data]


def _speech(name, data):
    return [(0, 10, "hello there"), (10, 31, " tower talk "), (31, 32, "")]


def _chat(system, user):
    if "fail" in user:
        raise RuntimeError("no")
    return {"entities": [{"name": "Redis", "kind": "library", "evidence": "uses redis", "confidence": 0.9}], "relations": []} if "uses redis" in user else "not json"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("media")
    held = {
        "a.pdf": b"toc", "b.pdf": b"pages", "c.pdf": b"locked", "img/tower.png": b"a", "img/empty.PNG": b"b", "img/odd.jpg": b"?", "talk.mp3": b"s",
        "src/tower.py": b"def tower():\n    pass  # uses redis\n", "login.md": b"# Login session token\nfail\n", "skip.bin": b"uses redis",
    }
    for name, data in held.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    notes = []
    nodes, links = api.index(spark, str(root), pdf=_pdf, ocr=_ocr, speech=_speech, chat=_chat, notes=notes)
    return {r.id: r for r in nodes.collect()}, {(r.source, r.target): r for r in links.collect()}, notes


def test_sections_of_pdf_files(graph):
    nodes, links, notes = graph
    ids = ["a.pdf::heading::intro::p1", "a.pdf::heading::deep::p2", "a.pdf::heading::untitled::p2", "a.pdf::heading::intro::p1-2"]
    assert [nodes[i].page for i in ids] == [1, 2, 2, 1] and nodes[ids[1]].source == "pdf"
    assert [links[i, up].type for i, up in zip(ids, ("a.pdf", ids[0], ids[0], ids[0]))] == ["section_of"] * 4
    assert {r.name for r in nodes.values() if r.file == "b.pdf"} == {"First line", "Page 2", "x" * 120}
    assert "c.pdf: locked" in notes and any(n.startswith("img/odd.jpg") for n in notes)


def test_texts_of_media_and_their_links(graph):
    nodes, links, _ = graph
    assert nodes["img/tower.png::media_text::1"].text == "the login session token redis" and "img/empty.PNG::media_text::1" not in nodes
    chunk = nodes["talk.mp3::transcript_chunk::1"]
    assert (chunk.text, chunk.start_sec, chunk.end_sec, chunk.ordinal) == ("hello there tower talk", 0.0, 31.0, 1)
    assert links["talk.mp3::transcript_chunk::1", "talk.mp3"].type == "section_of"
    by_name = links["img/tower.png", "src/tower.py"]
    assert (by_name.type, by_name.provenance, by_name.reason) == ("related_to", "inferred", "filename")
    by_text = links["img/tower.png::media_text::1", "login.md::heading::login-session-token::1"]
    assert (by_text.provenance, by_text.reason) == ("inferred", "content")


def test_a_model_is_asked_file_by_file(graph):
    nodes, links, notes = graph
    assert nodes["concept::redis"].kind == "library" and ("src/tower.py", "concept::redis") in links
    assert ("skip.bin", "concept::redis") not in links and notes[-1].startswith("added 1") and notes[-1].endswith("failed 1")


def test_models_over_http():
    class Model(BaseHTTPRequestHandler):
        def reply(self, found):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(found).encode())

        def do_GET(self):
            self.reply({"models": [{"name": "small:latest"}, {"model": "other"}, 3]})

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.reply({"message": {"content": " yes "}} if self.path == "/api/chat" and body["model"] == "small" else {"embedding": [1, "2"]} if "prompt" in body else [])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}/"
    assert models.list_models(at) == ["small:latest", "other"]
    assert models.ready("small", at) == (True, "") and not models.ready("big", at)[0]
    assert models.chat("", "q", "small", at) == "yes" and models.embed(["a", "b"], "m", at) == [[1.0, 2.0]] * 2
    with pytest.raises(models.ModelError):
        models.chat("s", "q", "big", at)
    server.shutdown()
    server.server_close()
    assert not models.ready("small", at)[0]
