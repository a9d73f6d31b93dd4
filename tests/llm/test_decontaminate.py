import random
import re
from itertools import combinations

from quillmesh.llm import decontaminate as D


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, window=13):
    out = set()
    for i, t in docs:
        d = toks(t)
        for k, u in items:
            w = toks(u)
            if len(w) < 6:
                continue
            width = min(window, len(w))
            best = 0
            for shift in range(-len(w), len(d)):
                seeded = any(
                    all(0 <= q + o + shift < len(d) and d[q + o + shift] == w[q + o] for o in mask)
                    for q in range(len(w) - 5)
                    if 0 <= q + shift and q + shift + 5 < len(d)
                    for mask in D.MASKS
                )
                if not seeded:
                    continue
                lo, hi = max(0, -shift), min(len(w), len(d) - shift)
                for a in range(lo, hi - width + 1):
                    best = max(best, sum(w[j] == d[j + shift] for j in range(a, a + width)))
            if best >= 0.8 * width - 1e-9:
                out.add((i, k, best, width))
    return out


def test_masks_never_miss():
    for miss in combinations(range(13), 2):
        assert any(all(a + o not in miss for o in m) for m in D.MASKS for a in range(13 - 5))


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(9)] + ["Été", "naïve"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([4, 6, 9, 13, 14, 30, 60])] + [(50, None), (51, ""), (3, "dup " * 8)]
    docs = [(None, text(20)), (1, None), (2, ""), (3, text(5)), (4, text(3000))]
    for i in range(5, 60):
        w = rng.choice([t for _, t in items if t and len(t.split()) > 8]).split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "other"
        a = rng.randrange(3)
        docs.append((i, text(rng.randrange(12)) + ", " + "; ".join(w[a:]).upper() + ". " + text(rng.randrange(12))))
    docs += [docs[-1], (docs[-1][0], text(40))]
    dd = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words")
    bb = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 as doc_id")
    want = brute(docs, items)
    for limit in (D.BROADCAST_SEEDS, 0):
        got = {(r.doc_id, r.item_id, r.overlap, r.window) for r in D.report(dd, bb, broadcast_seeds=limit).collect()}
        assert got == want and len(want) > 20
    flagged = {i for i, *_ in want}
    left = D.clean(dd, bb)
    assert left.columns == dd.columns
    assert {r.doc_id for r in left.collect()} >= {i for i, _ in docs} - flagged


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert D.report(none, bench).count() == 0 and D.report(some, bench).count() == 0
    assert D.clean(some, bench).count() == 1


def all_alignments(docs, items, window=13):
    """As ``brute``, without seeds and for items of any length."""
    out = set()
    for i, t in docs:
        d = toks(t)
        for k, u in items:
            w = toks(u)
            width = min(window, len(w))
            found = [sum(w[a + j] == d[b + j] for j in range(width)) for a in range(len(w) - width + 1) for b in range(len(d) - width + 1)]
            if w and max(found, default=0) >= 0.8 * width - 1e-9:
                out.add((i, k, max(found), width))
    return out


def test_short_items(spark):
    rng = random.Random(2)
    items = [(m, " ".join(f"i{m}w{j}" for j in range(m))) for m in range(1, 16)]
    docs = []
    for m, t in items:
        for miss in range(4):
            for gone in list(combinations(range(min(m, 13)), miss)):
                w = ["zz" if j in gone else x for j, x in enumerate(t.split())]
                docs.append((len(docs), " ".join(["a"] * rng.randrange(3) + w + ["b"] * rng.randrange(3))))
        docs.append((len(docs), " ".join(t.split()[1:])))
    want = all_alignments(docs, items)
    assert {w for *_, w in want} == set(range(1, 14))
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.overlap, r.window) for r in D.report(dd, bb).collect()}
    assert got == want
    assert {r.doc_id for r in D.clean(dd, bb).collect()} == {i for i, _ in docs} - {i for i, *_ in want}


def test_clashing_columns_pass(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, item), (2, "clean words only here"), (3, None)], "doc_id long, text string").selectExpr("*", "7 as _d1", "8 as k1", "9 as row", "'z' as item_id")
    left = D.clean(docs, spark.createDataFrame([(1, item, 5)], "item_id long, text string, words int"))
    assert left.columns == docs.columns and sorted((r.doc_id, r._d1, r.k1, r.row, r.item_id) for r in left.collect()) == [(2, 7, 8, 9, "z"), (3, 7, 8, 9, "z")]
