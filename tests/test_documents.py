from quillmesh.operators import edges as E
from quillmesh.operators import extract as X
from quillmesh.operators import links as L
from quillmesh.operators import merge as M


def test_markdown_headings_and_links():
    text = "[top](a.md)\n# One #\nsee [b](b.md#x) and ![c](pic.png) <https://d/e> <notes.txt> <b>\n#none\n## [two](no.md)\nThree\n~~~\n[f](#one)\n####### seven"
    headings, links = X.markdown_facts(text)
    assert headings == [(1, "One", 2), (2, "[two](no.md)", 5), (2, "Three", 6)]
    assert links == [("a.md", None), ("b.md#x", 0), ("pic.png", 0), ("https://d/e", 0), ("notes.txt", 0), ("#one", 2)]


def test_rules_fix_the_level():
    text = "====\nBook\n====\nPart\n----\nsee `here <x.rst>`_ and [y](y.txt)\nSmall\n^^^^^\nNext\n===="
    headings, links = X.rst_facts(text)
    assert headings == [(1, "Book", 2), (2, "Part", 4), (4, "Small", 7), (1, "Next", 9)]
    assert links == [("x.rst", 1), ("y.txt", 1)]
    assert X.rst_facts("") == X.markdown_facts("") == ([], [])


def test_citations(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    links = spark.createDataFrame([("a", "a", "contains"), ("a", "b", "calls")], "source string, target string, type string")
    said = "See [node:a] [node: a ] [node:gone] [a] and [edge:a->a:contains] [edge:b->a:calls] [edge:a->b:calls][edge:a->b:calls]"
    answers = spark.createDataFrame([(1, said), (2, None), (3, "")], "id int, text string").selectExpr("*", "'x' as kind")
    got = sorted((r.answer_id, r.kind, r.node_id or "", r.source or "", r.target or "", r.type or "") for r in M.citations(answers, nodes, links).collect())
    assert got == [(1, "edge", "", "a", "a", "contains"), (1, "edge", "", "a", "b", "calls"), (1, "node", "a", "", "", "")]
    hits = spark.createDataFrame([("b", 1), ("gone", 0), ("b", 4)], "id string, rank int")
    fallback = [(r.kind, r.ordinal, r.node_id or r.source) for r in M.fallback_citations(hits, nodes, links).collect()]
    assert sorted(fallback) == [("edge", 0, "a"), ("node", 0, "b")]
    assert M.fallback_citations(hits.limit(0), nodes, links).count() == 0


def test_last_link_degrees_and_stems(spark):
    links = spark.createDataFrame([("a", "b", "x", 0), ("a", "b", "y", 3), ("b", "a", "z", 1)], "source string, target string, type string, ord int")
    assert sorted((r.source, r.type) for r in E.last_link_wins(links).collect()) == [("a", "y"), ("b", "z")]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert sorted(tuple(r) for r in E.degrees(nodes, links).collect()) == [("a", 2, 1), ("b", 1, 2), ("c", 0, 0)]
    media, files = ([(i,) for i in names] for names in (["img/Tower.PNG", "m/.png", "two.jpg"], ["src/tower.py", "a/two.md", "b/TWO.rst", ".md"]))
    found = L.same_stem(spark.createDataFrame(media, "id string"), spark.createDataFrame(files, "id string"))
    assert [tuple(r) for r in found.collect()] == [("img/Tower.PNG", "src/tower.py")]
