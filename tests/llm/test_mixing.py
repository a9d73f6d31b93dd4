import hashlib
import math
import random
import re

from quillmesh.llm import mixing as M

WEIGHTS = (3, 1, 2)


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    total = {s: sum(n for (_, x, _), n in zip(rows, size) if x == s) for s in names}
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(size), {s: 0.0 for s in names}, set(names)
    left = budget
    while open_:
        w = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / w for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    return size, total, target


def make(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "é", None]), "w " * rng.randrange(40)) for i in range(400)]
    rows += [(7, "a", "w w w"), (7, "a", "w w w"), (None, "b", "x y"), (500, "zero", ""), (501, "zero", None), (502, "b", "q r " * 9000)]
    return rows


def test_targets_and_cut(spark):
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as _w")
    size, total, target = brute(rows)
    for per_range in (20000, 13):
        got = M.mix_report(docs, rows_per_range=per_range).collect()
        assert len(got) == len(rows)
        by = {}
        source = {i: s for i, s, _ in rows}
        for r in got:
            s = source[r.doc_id]
            assert r.source_size == total[s] and math.isclose(r.target, target[s], rel_tol=1e-12)
            assert 0 <= r.taken <= 2 * r["size"]
            by[s] = by.get(s, 0) + r.taken
        assert all(abs(by[s] - target[s]) <= 0.5 for s in by)
    again = M.mix_report(docs.orderBy("text"), rows_per_range=13).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_order_is_by_key(spark):
    rows = [(i, "a", "w " * 3) for i in range(50)] + [(i, "b", "w") for i in range(50, 60)]
    got = {r.doc_id: r.taken for r in M.mix_report(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    order = sorted(range(50), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
    taken = [got[i] for i in order]
    assert taken == sorted(taken, reverse=True) and set(taken) <= {3, 4, 5, 6}


def test_empty_and_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix_report(empty).count() == 0
    docs = spark.createDataFrame(make(), "doc_id long, source string, text string").selectExpr("*", "3 as _size")
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and 0 < out.count() < 2 * docs.count()
