import hashlib
import random
from collections import Counter

import numpy as np

from quillmesh.llm import suffix_dedup as S


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cé", "dog", "e", "fgh", "zulu"]) + str(rng.randrange(99))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (15, 30, 60, 200)]
    rows = [(None, None), (1, ""), (2, "short"), (3, "a" * (length * 3)), (4, "ab" * length), (5, text(3000))]
    for i in range(10, 60):
        t = text(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            t += rng.choice([p, p[a:b], p[a:]]) + text(rng.randrange(20))
        rows.append((i, t))
    rows += [rows[12], (rows[12][0], rows[13][1]), (70, rows[5][1][100:9000]), (71, rows[20][1] + "x"), (72, "y" + rows[20][1])]
    return rows


def run(spark, rows, length, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "2 as lo").repartition(7)
    got = S.dedup_substrings(docs, length, **options).drop("kept").collect()
    return sorted([tuple(r) for r in got], key=str)


def test_against_brute_force(spark):
    for seed, length in ((1, 200), (2, 80)):
        rows = corpus(seed, length)
        want = brute(rows, length)
        assert sum(r[2] for r in want) > 1000
        assert run(spark, rows, length) == want


def test_hot_groups(spark):
    rows = corpus(3, 100)
    assert run(spark, rows, 100, hot=3) == brute(rows, 100)


def test_windows_through_several_hot_anchors(spark):
    # The passages are shorter than a window, so nothing repeats; some hold several hot anchors.
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [*[noise(190) for _ in range(5)], "=-" * 70]
    rows = [(i, noise(300) + passages[i % 6] + noise(300)) for i in range(120)]
    powers = S._powers(120_000)
    _, _, h, _ = S.find_anchors([t.encode() for _, t in rows], powers, 200)
    assert sum(n > 3 for n in Counter(h.tolist()).values()) > 6
    # A document that holds a longer stretch of another loses it, and no more.
    longer = [*rows, (300, noise(40) + rows[0][1][250:700] + noise(40))]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(batch)
    spark.conf.set(batch, 4)  # a group that ends inside a batch is not taken for hot
    try:
        for case, gone in ((rows, 0), (longer, 900)):
            want = brute(case, 200)
            assert sum(r[2] for r in want) == gone
            assert run(spark, case, 200, hot=3) == want
    finally:
        spark.conf.set(batch, old)


def test_long_texts_in_pieces():
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 101) for _ in range(5000))
    powers = S._powers(9000)
    whole = S.find_anchors([text, b"x", text[:150]], powers, 100)
    parts = S.find_anchors([text, b"x", text[:150]], powers, 100, piece=300)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_suffix_sort_is_a_sort():
    rng = random.Random(5)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(300)]
    suffixes = S.Suffixes(*S._matrix(parts, 12))
    sizes = np.array([1, 2, 130, 67, 100])
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    order = suffixes.sort(starts, sizes)
    for s, n in zip(starts, sizes):
        assert [parts[i] for i in order[s : s + n]] == sorted(parts[s : s + n])
    # A weak hash collides; the bytes are looked at and the order is mended.
    suffixes.prefix[:] = 0
    order = suffixes.sort(starts, sizes)
    suffixes.neighbours(order, starts, sizes)
    for s, n in zip(starts, sizes):
        assert [parts[i] for i in order[s : s + n]] == sorted(parts[s : s + n])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup_substrings(empty).count() == 0
