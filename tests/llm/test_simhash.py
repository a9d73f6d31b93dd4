import random
from itertools import combinations

import numpy as np
import xxhash

from quillmesh.llm import simhash as S


def slow_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or ""))]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    rows = [(i, slow_fingerprint(t)) for i, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if bin(rows[a][1] ^ rows[b][1]).count("1") <= 4:
            root[top(a)] = top(b)
    out = []
    for k, (i, fp) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        out.append((i, f"{fp:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_golay_facts():
    tables = S.golay_tables()
    assert set(tables[2].tolist()) == {1, 6}
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(1 << 23))
        kx, nx = S.golay_keys(np.array([x]), tables)
        flips = rng.choice(23, 2, replace=False)
        y1, y2 = x ^ (1 << int(flips[0])), x ^ (1 << int(flips[0])) ^ (1 << int(flips[1]))
        ky, ny = S.golay_keys(np.array([y1, y2]), tables)
        assert kx[0, 0] in ky[0, : ny[0]]
        assert set(kx[0, : nx[0]].tolist()) & set(ky[1, : ny[1]].tolist())


def test_every_pair_within_four_bits_meets():
    tables, rng = S.golay_tables(), random.Random(2)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        keys, rows = S.bucket_keys(np.array([x, y], np.uint64), tables)
        kx, ky = set(keys[rows == 0].tolist()), set(keys[rows == 1].tolist())
        assert {k >> 1 for k in kx if not k & 1} & {k >> 1 for k in ky} or {k >> 1 for k in ky if not k & 1} & {k >> 1 for k in kx}


def words(rng, n):
    return " ".join(rng.choice(["the", "cat", "Saß", "on", "mat", "and", "dog", "ran", "off", "hill"]) + str(rng.randrange(30)) for _ in range(n))


def corpus():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "a b c"), (7, "A  B\tc"), (7, "A  B\tc"), (None, "a b c")]
    for k in range(12):
        base = words(rng, 200).split()
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(9))
            rows.append((100 - 5 * k - c, " ".join(copy)))
    rows.append((200, words(rng, 30000)))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted([tuple(r) for r in S.simhash_groups(docs).collect()], key=str)
    assert got == slow_components(rows)


def test_pieces_do_not_matter():
    text = words(random.Random(4), 5000).encode()
    assert S.fingerprint(text, piece=100) == S.fingerprint(text) == slow_fingerprint(text.decode())


def test_hot_buckets(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(3):
        x = rng.getrandbits(63)
        values |= {x ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(60)}
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for bits in (4, 3):
        want = S.connected_components(S.fingerprint_links(fps, bits)).collect()
        got = S.connected_components(S.fingerprint_links(fps, bits, hot=8)).collect()
        assert sorted(map(tuple, want)) == sorted(map(tuple, got)) and want


def test_empty_table_and_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert S.simhash_groups(empty).count() == 0
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source")
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in slow_components(rows)}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)


def test_rows_that_share_an_id(spark):
    rows = [(1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (2, "quite another text stands here alone", "b"), (None, "one two three four five six", "c"),
            (None, "no id and no copy of anything here", "d"), (None, "no id and no copy of anything here", "d"), (3, None, "e"), (4, "", "e"), (5, "twice the very same row of words", "f"), (5, "twice the very same row of words", "f")]
    docs = spark.createDataFrame([(*r, 1, {"k": "v"}) for r in rows], "doc_id long, text string, k1 string, `row` int, m map<string,string>").repartition(4)
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "", r.k1) for r in kept.collect())
    assert left == sorted([(1, rows[0][1], "a"), (2, rows[2][1], "b"), (0, rows[4][1], "d"), (3, "", "e"), (5, rows[8][1], "f")])


def test_crowded_fingerprint(spark):
    rows = [(i, "the same words in all of these") for i in range(600)] + [(1000 + i, f"text number {i} of its own {i * i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "2 as n").repartition(5)
    got = {r.doc_id: r.component_id for r in S.simhash_groups(docs).collect()}
    assert len(got) == 650 and {got[i] for i in range(600)} == {0} and all(got[i] >= 1000 for i in range(1000, 1050))
    assert [r.doc_id for r in S.drop_near_copies(docs).where("doc_id < 1000").collect()] == [0]
