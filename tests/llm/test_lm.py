import math
import random
import zlib
from collections import Counter

import numpy as np

from quillmesh.llm import lm as L


def small(seed=1):
    rng = np.random.default_rng(seed)
    sequences = []
    for _ in range(40):
        s, at = [], int(rng.integers(5))
        for _ in range(int(rng.integers(0, 60))):
            at = (at * 3 + int(rng.integers(2))) % 11
            s.append(100 + at)
        sequences.append(np.array(s, np.int64))
    return sequences


def fitted(steps=150):
    return L.fit(small(), d=8, hidden=12, classes=8, rows=64, steps=steps, batch=64)


def naive(model, sequence):
    """Score of one sequence, place by place, in doubles and plain loops."""
    p = {n: getattr(model, n).astype(float) for n in L.Model.names}
    inputs, targets, score = [L.START] * (L.OVERLAP + 1) + list(sequence), list(sequence) + [L.END], 0.0
    for t, target in enumerate(targets):
        begin = t // L.STEP * L.STEP
        x = [p["e"][model.row[i]] + p["pos"][k] for k, i in enumerate(inputs[begin : L.OVERLAP + t + 1])]
        a = np.array([x[-1] @ p["q"] @ (y @ p["k"]) for y in x])
        a = np.exp(a - a.max()) / np.exp(a - a.max()).sum()
        h = x[-1] + sum(w * (y @ p["v"]) for w, y in zip(a, x)) @ p["o"]
        h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        row = int(model.row[target])
        c, z = row // model.members, h @ p["u"] + p["b"]
        span = slice(c * model.members, (c + 1) * model.members)
        y = p["g"][span] @ h + p["m"][span]
        score += (z[c] - np.log(np.exp(z).sum()) + y[row - span.start] - np.log(np.exp(y).sum())) / np.log(10) + model.share[target]
    return score


def test_against_a_naive_model():
    model = fitted(60)
    rng = np.random.default_rng(5)
    sequences = [rng.integers(100, 113, n) for n in (0, 1, 2, 15, 16, 17, 31, 32, 33, 90)] + [np.array([7, 48000, 101])]
    got = L.score_sequences(model, sequences, chunk=3, places=70)
    assert np.allclose(got, [naive(model, s) for s in sequences], rtol=1e-4)


def test_probabilities_sum_to_one():
    model = fitted(5)
    for context in ([L.START], [L.START, 101, 105], [L.START, 7, 48000]):
        ids = np.full((L.VOCABULARY, L.WINDOW), L.START)
        ids[:, L.WINDOW - len(context) :] = context
        targets = np.zeros((L.VOCABULARY, L.STEP), int)
        targets[:, -1] = np.arange(L.VOCABULARY)
        p = sum((10.0 ** model.log10(ids[a : a + 8192], targets[a : a + 8192])[:, -1].astype(float)).sum() for a in range(0, L.VOCABULARY, 8192))
        assert math.isclose(p, 1, abs_tol=1e-3)


def test_causal_and_windows():
    model = fitted(20)
    ids = np.random.default_rng(2).integers(100, 111, (1, L.WINDOW))
    targets = ids[:, : L.STEP]
    later = ids.copy()
    later[0, L.OVERLAP + 9 :] = 7
    a, b = model.log10(ids, targets), model.log10(later, targets)
    assert np.allclose(a[0, :9], b[0, :9]) and not np.allclose(a[0, 9:], b[0, 9:])
    for n in (0, 1, 2, L.STEP - 1, L.STEP, L.WINDOW, 29, 100):
        inputs, wanted, starts, seq = L.lay_out([np.arange(200, 200 + n), np.arange(3)])
        scored = Counter(s + k for s, q in zip(starts, seq) for k in range(L.OVERLAP, L.WINDOW) if q == 0 and wanted[s + k] >= 0)
        assert scored == Counter(range(L.OVERLAP, L.OVERLAP + n + 1))  # each id and the end once
    one = L.score_sequences(model, small()[:1])
    many = L.score_sequences(model, small(), chunk=7)
    assert math.isclose(one[0], many[0], rel_tol=1e-5)


def test_gradients():
    model = fitted(3)
    for name in L.Model.names:
        setattr(model, name, getattr(model, name).astype(np.float64))
    rng = np.random.default_rng(3)
    ids, targets = rng.integers(100, 111, (3, L.WINDOW)), rng.integers(99, 112, (3, L.STEP))
    targets[rng.random((3, L.STEP)) > 0.8] = -1

    def loss():
        flat = targets.ravel()
        return -model.logs(model.forward(model.row[ids])[-1], model.row[np.maximum(flat, 0)])[0][flat >= 0].mean()

    found = L.gradients(model, ids, targets)
    for name in L.Model.names:
        p = getattr(model, name)
        for _ in range(4):
            at = tuple(int(rng.integers(s)) for s in p.shape)
            if name in "egm":
                at = (int(model.row[ids[0, 3]]), *at[1:])
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert math.isclose((up - down) / 2e-5, found[name][at], rel_tol=1e-3, abs_tol=1e-7), name


def test_training_helps():
    assert L.score_sequences(fitted(150), small(9)).sum() > L.score_sequences(fitted(1), small(9)).sum()


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["The", "cat", "É", "x\x00y", "\x00", "dog　a", "z"]) + str(rng.randrange(30))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40)))) for i in range(120)] + [(None, "the cat1"), (500, None), (501, ""), (3, "same id"), (3, "same id"), (502, "long word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as block").repartition(5)
    model = L.train(docs, steps=5, d=8)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [[w.encode() for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low(t))] + [b"\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), h, len(t), sum(count[w] > 0 for w in t), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), 5)) for (i, _), t, h in zip(rows, tokens, held))
    for block in (4 << 20, 300):
        got = L.score_documents(docs, model, block_bytes=block, buckets=5).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert L.score_documents(docs.limit(0), model).count() == 0
    assert L.score_documents(docs, L.train(docs.limit(0), steps=2, d=4)).count() == len(rows)


def test_statistics_and_windows_cover_all_training_documents(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "zulu", "naïve", "7"]) + str(rng.randrange(9)) for _ in range(rng.randrange(30)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"rows": 64, "classes": 8}
    model = L.train(docs.repartition(5), max_rows=3, steps=2, d=4, **options)
    kept = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    whole = L.fit(L.WordEncoder.of_worker(None).encode_all(kept), steps=0, d=4, **options)
    assert (model.row == whole.row).all()
    assert np.allclose(model.share, whole.share, atol=1e-5)
    more = spark.createDataFrame([(1000 * k + i, t) for k in range(20) for i, t in rows], "doc_id long, text string")
    small_windows, many = model.windows, L.train(more.repartition(5), max_rows=3, steps=2, d=4, every=1, batch=8, **options).windows
    assert small_windows > 0 and many > 4 * L.train(docs.repartition(5), max_rows=3, steps=2, d=4, every=1, batch=8, **options).windows


def test_blocks_are_spread(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 9) for i in range(90)], "doc_id long, text string").repartition(3)
    info = L.prepare(docs, block_bytes=300, buckets=2).where("info is not null").select("bucket", "block").collect()
    assert len(info) > 20 and len({r.bucket for r in info}) == len({r.block for r in info}) == len(info)


def test_weights_learn_from_every_window(spark):
    sequences = small(3)
    inputs, targets, starts, _ = L.lay_out(sequences)
    parts = list(L.every_window(np.random.default_rng(1), inputs, targets, starts, 7))
    place = starts[:, None] + np.arange(L.WINDOW)
    want = sorted(zip(map(tuple, inputs[place]), map(tuple, targets[place[:, L.OVERLAP :]])))
    assert sorted((tuple(i), tuple(t)) for ids, goal in parts for i, t in zip(ids, goal)) == want
    assert max(len(ids) for ids, _ in parts) <= 7

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "zulu"]) + str(rng.randrange(9)) for _ in range(rng.randrange(300)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids = L.WordEncoder.of_worker(None).encode_all([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    found = [L.train(docs, prepared=L.prepare(docs, block_bytes=size), max_rows=3, steps=2, d=4, rows=64, classes=8) for size in (1 << 20, 2000)]
    assert [m.windows for m in found] == [len(L.lay_out(ids)[2])] * 2
    assert all(L.score_sequences(m, ids).sum() > L.score_sequences(L.fit(ids, steps=2, d=4, rows=64, classes=8), ids).sum() for m in found)


def test_short_runs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 255, 256, 257, 700):
        a, b = rng.standard_normal((n, 5)), rng.standard_normal((n, 3))
        assert np.allclose(L._gram(a, b), a.T @ b)
    inputs, targets, starts, _ = L.lay_out(small())
    found = []
    for run in (7, 1 << 13):
        model = fitted(3)
        adam = L.Adam(model)
        for ids, goal in L.every_window(np.random.default_rng(2), inputs, targets, starts, 16):
            adam.step(ids, goal, 0.01, run)
        found.append(model)
    assert all(np.allclose(getattr(found[0], n), getattr(found[1], n)) for n in L.Model.names)


class Counted(np.ndarray):
    """Counts the multiplications of matrix products, its own and of all that is made from it."""

    done = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **options):
        plain = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs]
        if out is not None:
            options["out"] = tuple(x.view(np.ndarray) for x in out)
        found = getattr(ufunc, method)(*plain, **options)
        if ufunc is np.matmul:
            Counted.done += found.size * plain[0].shape[-1]
        return out[0] if out is not None else found.view(Counted) if isinstance(found, np.ndarray) else found


def test_no_keys_or_values_are_made():
    model = fitted(3)
    ids, targets = (np.random.default_rng(7).integers(100, 111, (40, n)) for n in (L.WINDOW, L.STEP))
    want, rows = L.gradients(model, ids, targets), model.row.take(ids)
    state = model.forward(rows)[-1].copy()
    for name in L.Model.names:
        setattr(model, name, getattr(model, name).view(Counted))
    d, hidden = model.w1.shape
    Counted.done = 0
    assert np.allclose(model.forward(rows)[-1], state)
    # By place that is scored: what it asks, its matches, their mixture and what comes of it, the layer.
    forward = len(ids) * L.STEP * (d * d + L.WINDOW * d + L.WINDOW + L.WINDOW * d + d * d + 2 * d * hidden) + 2 * d**3
    assert Counted.done <= forward
    found = L.gradients(model, ids, targets)
    assert all(np.allclose(found[n], want[n], atol=1e-6) for n in L.Model.names)


def test_sums_by_row():
    rng = np.random.default_rng(2)
    for width, kind in ((4, np.float32), (3, np.float32), (4, np.float64)):
        for n in (1, 300):
            x, row = rng.standard_normal((n, width)).astype(kind), rng.integers(0, 50, n)
            want = np.zeros((64, width))
            np.add.at(want, row, x)
            found = L._sum_by_row(x, row, 64)
            assert found.dtype == kind and np.allclose(found, want, atol=1e-5)


def test_steps_are_those_of_adam():
    inputs, targets, starts, _ = L.lay_out(small())
    model, plain = fitted(3), fitted(3)
    adam, moments = L.Adam(model), {n: [0.0, 0.0] for n in L.Model.names}
    for k, (ids, goal) in enumerate(L.every_window(np.random.default_rng(2), inputs, targets, starts, 16), 1):
        adam.step(ids, goal, 0.01)
        for n, g in L.gradients(plain, ids, goal).items():
            m, v = moments[n] = [0.9 * moments[n][0] + 0.1 * g, 0.99 * moments[n][1] + 0.01 * g * g]
            step = 0.01 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-7)
            setattr(plain, n, (getattr(plain, n) - step).astype(np.float32))
        if k == 6:
            break
    assert all(np.allclose(getattr(model, n), getattr(plain, n), atol=2e-3) for n in L.Model.names)
    assert np.array_equal(adam.w, np.concatenate([getattr(model, n).ravel() for n in L.Model.names]))
