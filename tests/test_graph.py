import json
import math

import pytest
from pyspark.sql import functions as F

from quillmesh import api
from quillmesh.functions import text as X
from quillmesh.operators import edges as E
from quillmesh.operators import expand as G
from quillmesh.operators import links as L
from quillmesh.operators import merge as M
from quillmesh.plans.model import slug
from quillmesh.sources import files as S
from quillmesh.sources import graph_json as J

LINK = "source string, target string, type string, provenance string, confidence double"


def routes(spark):
    rows = [
        ("start-a", "mid", "mentions", "extracted", 0.95), ("mid", "end-b", "calls", "extracted", 0.9), ("start-a", "end-b", "related_to", "inferred", 0.15),
        ("end-b", "far", "contains", "extracted", None),
    ]
    return spark.createDataFrame(rows, LINK)


def test_two_sure_hops_beat_one_unsure(spark):
    links = routes(spark)
    nodes = spark.createDataFrame([(x, "concept") for x in ("start-a", "mid", "end-b", "far", "alone")], "id string, type string")
    ids, steps, total = G.find_path(nodes, links, "start-a", "end-b")
    assert ids == ["start-a", "mid", "end-b"] and math.isclose(total, 2.426901, abs_tol=1e-6)
    assert math.isclose(sum(s["cost"] for s in steps), total)
    assert G.find_path(nodes, links, "mid", "mid") == (["mid"], [], 0.0)
    with pytest.raises(G.NoPathError):
        G.find_path(nodes, links, "end-b", "start-a")
    with pytest.raises(G.PathTooLongError):
        G.find_path(nodes, links, "start-a", "end-b", max_hops=1)
    assert "start-a -(mentions, extracted, 95%)-> mid" in G.path_sentence("a", "b", ids, steps)


def test_neighbourhood_and_cap(spark):
    links = routes(spark)
    assert dict(G.neighbourhood(links, ["far"], 1)[0]) == {"far": 0, "end-b": 1}
    found, cut = G.neighbourhood(links, ["far"], 2, cap=3)
    assert found == [("far", 0), ("end-b", 1), ("mid", 2)] and cut
    assert not G.neighbourhood(links, ["far"], 2, cap=4)[1]


def test_first_edge_wins_and_unique_keys(spark):
    rows = [("a", "b", 1, 0, "imports"), ("a", "b", 0, 5, "references"), ("a", "a", 0, 0, "calls"), ("a", "x", 0, 0, "calls")]
    df = spark.createDataFrame(rows, "source string, target string, phase int, seq int, type string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in E.first_edge_wins(df, nodes).collect()] == [("a", "b", "references")]
    names = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "3"), ("m", "3"), (None, "4")], "name string, id string")
    assert [tuple(r) for r in E.unique_key(names, "name", "id").collect()] == [("m", "3")]


def test_references_by_name(spark):
    names = spark.createDataFrame([("x/main.py", "main.py"), ("a/u.py", "u.py"), ("b/u.py", "u.py"), ("n/my file", "my file")], "id string, name string")
    texts = spark.createDataFrame([("r", "see main.py, u.py and (my file)"), ("s", "main.py. xmain.py"), ("x/main.py", "main.py")], "id string, text string")
    assert {tuple(r) for r in L.name_references(texts, names).collect()} == {("r", "x/main.py"), ("r", "n/my file")}


def test_outline_is_the_heading_stack(spark):
    levels = [2, 1, 3, 2, 3, 3, 1, 2]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(levels)], "f string, k int, level int")
    stack, want = [], {}
    for k, v in enumerate(levels):
        while stack and levels[stack[-1]] >= v:
            stack.pop()
        want[k] = stack[-1] if stack else None
        stack.append(k)
    assert {r.k: r.parent for r in L.outline(df, "f", "k", "level").collect()} == want


def test_segments_fold(spark):
    rows = [("u", 0.0, 40.0, "long first"), ("u", 40.0, 41.0, "b"), ("u", 50.0, 51.0, "c"), ("u", 60.0, 61.0, " ")]
    got = L.merge_segments(spark.createDataFrame(rows, "g string, start_sec double, end_sec double, text string"), "g").orderBy("ordinal").collect()
    assert [(r.ordinal, r.start_sec, r.end_sec, r.text) for r in got] == [(0, 0.0, 41.0, "long first b"), (1, 50.0, 51.0, "c")]


def test_merge(spark):
    nodes = lambda *rows: spark.createDataFrame(rows, "id string, type string, name string, ord int")
    none = spark.createDataFrame([("a", "b", "calls", "extracted", "")], "source string, target string, type string, provenance string, evidence string")
    absent = none.withColumn("evidence", F.lit(None).cast("string"))
    n, e = M.merge_graphs([(nodes(("a", "file", "x", 0)), none), (nodes(("a", "file", "x", 4), ("b", "file", "y", 0)), absent)])
    assert sorted(r.id for r in n.collect()) == ["a", "b"] and e.count() == 1
    with pytest.raises(M.MergeConflictError):
        M.merge_graphs([(nodes(("a", "file", "x", 0)), none), (nodes(("a", "dir", "x", 0)), none)])
    assert M.shared_or_drop([{"a": 1, "b": 2}, {"a": 1, "b": 3}]) == {"a": 1}


def test_scores(spark):
    df = spark.createDataFrame([("n1", "concept", "Authentication"), ("n2", "file", "Other")], "id string, type string, name string")
    got = {r.id: r.s for r in df.select("id", X.fuzzy_score("autentication", df.columns).alias("s")).collect()}
    assert got["n1"] >= 0.55 > got["n2"]
    assert df.select(X.fuzzy_score("AUTHENTICATION", df.columns)).first()[0] == 1.0
    assert X.ratio("tide", "diet") == 0.25 and X.ratio("diet", "tide") == 0.5
    vectors = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in vectors.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.707107, 0.0, 0.0]
    assert [r[0] for r in spark.createDataFrame([("A b--C!",), ("--",)], "s string").select(slug(F.col("s"))).collect()] == ["a-b-c", "untitled"]


def test_gates():
    cost = {"total_bytes": 100, "n_files": 2, "scan_ops": 4, "non_code_share": 0.9}
    M.enforce_gates(cost, {"total_bytes": 100, "scan_ops": 4})
    with pytest.raises(M.LargeRepoError) as e:
        M.enforce_gates(cost, {"scan_ops": 3, "n_files": 1, "non_code_share": 0.85})
    assert e.value.tripped_gates == ["n_files", "scan_ops"]
    M.enforce_gates(cost, {"scan_ops": 3, "non_code_share": 0.85}, code_only=True, allow=True)


def test_ignore_rules():
    rules = S.ignore_rules(["*.log", "build/", "!keep.log", "/top.txt", "docs/**/x.md", "# note"])
    hit = lambda p, d=False: S.is_ignored(p, d, rules)
    assert hit("a/b.log") and not hit("keep.log") and hit("build", True) and hit("a/build/c.py") and not hit("build")
    assert hit("top.txt") and not hit("a/top.txt") and hit("docs/a/b/x.md") and hit("docs/x.md")


def test_index_and_questions(spark, tmp_path):
    root = tmp_path / "project"
    tree = {
        "src/app.py": "def greet():\n    return 1\n\n\nclass Greeter:\n    def hello(self):\n        return greet()\n",
        "src/main.py": "from app import greet\n\n\ndef run():\n    return greet()\n",
        "src/util.go": "package util\n\nfunc Add(a int) int { return a }\n",
        "broken/bad.py": "def (:\n",
        "README.md": "# Guide\n\nSee main.py and [app](src/app.py#x).\n\n## Use\n\n### More\n\n[back](#guide)\n",
        "skip/me.log": "x",
        ".gitignore": "*.log\n",
    }
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    nodes, links = api.index(spark, str(root))
    ids = {r.id for r in nodes.collect()}
    assert {"src/app.py::function::greet::1", "src/app.py::class::Greeter::5", "src/app.py::method::hello::6", "src/main.py::function::run::4", "src/util.go::function::Add::3"} <= ids
    assert "skip/me.log" not in ids and "README.md::heading::guide::1" in ids
    edges = {(r.source, r.target): r.type for r in links.collect()}
    assert edges["src/main.py::function::run::4", "src/app.py::function::greet::1"] == "calls"
    assert edges["src/main.py", "src/app.py::function::greet::1"] == "imports"
    assert edges["README.md", "src/main.py"] == "references"
    assert edges["README.md::heading::guide::1", "src/app.py"] == "mentions"
    assert edges["README.md::heading::more::7", "README.md::heading::use::5"] == "section_of"
    assert edges["src/app.py::class::Greeter::5", "src/app.py::method::hello::6"] == "defines"
    out = J.write_graph(str(tmp_path / "g.json.gz"), nodes, links, {"project_root": "p"})
    n2, e2, meta = J.read_graph(spark, out)
    assert n2.count() == nodes.count() and e2.count() == links.count() and meta == {"project_root": "p"}
    assert "src/app.py::function::greet::1" in [r.id for r in api.query(n2, e2, "greet")[2]]
    found = api.path(n2, e2, "src/main.py", "greet")
    assert found["nodes"] == ["src/main.py", "src/app.py::function::greet::1"]
    assert api.explain(n2, e2, "Greeter", hops=1)[2][0].id == "src/app.py::class::Greeter::5"
    with pytest.raises(J.GraphError):
        J.write_graph(str(tmp_path / "bad.json"), nodes.withColumn("type", F.lit("what")), links, {})
    assert not (tmp_path / "bad.json").exists()
    merged = api.merge(spark, [out, out], str(tmp_path / "m.json"))
    assert len(json.loads(open(merged).read())["nodes"]) == nodes.count()
    assert J.next_snapshot(str(tmp_path)).endswith("graph_v1.json")
