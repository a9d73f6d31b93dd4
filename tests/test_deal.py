import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh import catalogue as C
from quillmesh.functions import text as X
from quillmesh.operators import edges as E
from quillmesh.operators import expand as G
from quillmesh.operators import merge as M
from quillmesh.plans import deal as D

SF = "/root/testdata/sf0.001"
LINK = "source string, target string, type string, provenance string, confidence double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_follow_the_files(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert D.tasks(lines) == 0 and "Exchange" not in plan(D.deal(lines, "l_orderkey"))
    monkeypatch.setattr(D, "PIECE", 2000)
    n = D.tasks(lines)
    assert n > 40 and D.tasks(lines, lines) >= 2 * n - 1
    assert D.deal(lines, "l_orderkey").rdd.getNumPartitions() == n
    won = E.first_edge_wins(C.candidate_links(spark, SF))
    assert f"{D.tasks(C.candidate_links(spark, SF))}), REPARTITION_BY_NUM" in plan(won)
    marks = spark.createDataFrame([(0,), (7,), (-3,), ((1 << 60) - 1,)], "k bigint")
    assert [r[0] for r in marks.select(C._named(C._mark("orders", "k"))).collect()] == [f"orders::{k}" for k in (0, 7, -3, (1 << 60) - 1)]


def test_merge_aggregates_once(spark):
    n = spark.createDataFrame([("a", "file", "x", 0), ("b", "file", None, 1)], "id string, type string, name string, ord int")
    e = spark.createDataFrame([("a", "b", "calls", "extracted", 0.5), ("b", "a", "calls", "extracted", None)], LINK)
    nodes, links = M.merge_graphs([(n, e), (n, e)])
    assert "Exchange" not in plan(nodes) and "Exchange" not in plan(links)  # settled with the check, not made again
    assert {r.id: r.name for r in nodes.collect()} == {"a": "x", "b": None} and links.count() == 2
    with pytest.raises(M.MergeConflictError, match=r"\[0, 1, 2\]"):
        M.merge_graphs([(n, e), (n, e), (n, e.withColumn("confidence", F.lit(0.5)))])


def test_dangling_shuffles_each_end_once(spark, monkeypatch):
    links = spark.createDataFrame([("a", "b", "calls"), ("x", "a", "calls"), ("x", "y", "uses"), (None, "a", "uses")], "source string, target string, type string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {tuple(r) for r in E.dangling(nodes, links).collect()}
    assert got == {("x", "a", "calls", "source"), ("x", "y", "uses", "source"), ("x", "y", "uses", "target"), (None, "a", "uses", "source")}
    monkeypatch.setattr(D, "PIECE", 20000)
    wide = E.dangling(C.nodes(spark, SF, C._mark), C.marked_links(spark, SF))
    n = D.tasks(C.nodes(spark, SF), C.marked_links(spark, SF))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert f"hashpartitioning(id#" in plan(wide) and f", {n}), ENSURE_REQUIREMENTS" in plan(wide) and wide.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outline_is_dealt_by_its_input(spark, monkeypatch):
    want = {tuple(r) for r in C.q12_outline(spark, SF).collect()}
    monkeypatch.setattr(D, "PIECE", 2000)
    dealt = C.q12_outline(spark, SF)
    assert dealt.rdd.getNumPartitions() == D.tasks(spark.read.parquet(f"{SF}/lineitem.parquet")) > 40
    assert {tuple(r) for r in dealt.collect()} == want


def test_violations_join_the_ends_once(spark):
    nodes = spark.createDataFrame([(1, "dir"), (1, "dir"), (2, "dir")], "id bigint, type string")
    for c in ("name", "file", "source", "kind", "text", "language"):
        nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    nodes = nodes.withColumns({c: F.lit(None).cast("int") for c in ("start_line", "page", "start_sec", "end_sec")})
    links = spark.createDataFrame([(1, 3, "calls", "extracted", None, None), (4, 2, "calls", "extracted", None, None)], "source bigint, target bigint, type string, provenance string, confidence double, evidence string")
    found = M.violations(nodes, links, lambda c: F.concat(F.lit("n"), F.col(c).cast("string")))
    assert {tuple(r) for r in found.collect()} == {("dangling_target", "n1 -> n3"), ("dangling_source", "n4 -> n2"), ("duplicate_id", "n1")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1


def test_conflicts_sort_once_and_name_all_inputs(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 64), ("a", 1, 70), ("b", 1, 3), ("b", 1, 4), ("c", None, 62), ("c", 1, 63)], "id string, v int, input int")
    found = M.conflicts(rows, ["id"], ["v"], 71)
    assert {r.id: r.inputs for r in found.collect()} == {"a": [0, 64, 70], "c": [62, 63]}
    assert "ObjectHashAggregate" not in plan(found)


def test_ratios_that_characters_rule_out_are_not_computed(spark, monkeypatch):
    asked, made = "smal brused brass", []
    texts, names, ids = ["part::45678 concept tin nut other", "part::3 concept small brushed brass"], ["tin nut", "small brushed brass"], ["part::45678", "part::3"]
    real = X.ratio
    want = [max(max(real(asked, x) for x in row), max((0.95 * r for w in row[0].split() for a in asked.split() if (r := real(a, w)) >= 0.8), default=0.0)) for row in zip(texts, names, ids)]
    monkeypatch.setattr(X, "ratio", lambda a, b: made.append((a, b)) or real(a, b))
    assert X.ratio_scores(asked).func(pd.Series(texts), pd.Series(names), pd.Series(ids)).tolist() == want
    assert "45678" not in [b for _, b in made]  # of a fitting length, but of no common character


def test_fuzzy_rows_are_dealt(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(C, "deal", lambda df, *keys, n=None: dealt.append((keys, n)) or df.repartition(3, *keys))
    monkeypatch.setattr(C, "tasks", lambda df, piece: 3)
    assert C.q11_fuzzy_top(spark, SF).count() > 0 and dealt == [(("id",), 3)]


def test_paths_shuffle_links_once_and_stop_at_the_dearest_end(spark, monkeypatch):
    rows = [(0, 1, "calls", "extracted", 1.0), (1, 2, "calls", "extracted", 1.0), (0, 9, "calls", "extracted", 0.35), (9, 10, "calls", "extracted", 1.0)]
    links = spark.createDataFrame([(a, b, *rest) for a, b, *rest in rows], "source bigint, target bigint, type string, provenance string, confidence double")
    settled, real = [], G.settle
    monkeypatch.setattr(G, "settle", lambda df: settled.append(df.columns) or real(df))
    found = G.shortest_paths(links, 0, [2], shown=lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))).collect()
    assert [(r.id, r.cost, r.hops, r.nodes) for r in found] == [(2, 2.0, 2, ["n0", "n1", "n2"])]
    assert len(settled) == 5 and ["source", "target", "w"] not in settled  # two rounds and an empty one, whose frontier is the end alone
    assert not spark.sparkContext._jsc.getPersistentRDDs()
