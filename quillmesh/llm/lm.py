"""Language-model scores: a causal self-attention model over subword ids, beside word counts.

An id's place in the softmax is (class, member): 64 classes of 64 members, cut by what stands before
an id, so a probability costs two short softmaxes, and both are the network's own: class and member
logits come from the same state, which is an input embedding, one head of masked attention over the
window and a small rectified layer. Ids beyond the commonest share one member and are told apart by
their counted shares.

Ids and left neighbours are counted over all training documents. The weights are learned from every
window of every training document: one task takes the first steps on a few blocks, so that all start
from one point; then all tasks go on from there, each over all windows of its blocks, and their
weights are averaged. Texts are scored in half-overlapping windows, each token once, with ``OVERLAP``
to ``WINDOW`` - 1 ids before it, many windows at a time.

The base score needs the count of every word of the corpus. Tasks count inside blocks of
documents; what travels is, for each block and hash bucket of words, the distinct words with their
training counts and the (document, word, count) triples. A bucket adds up its words over all blocks
and answers each block with sums per document, so no word, however frequent, has more than a row
for each block. Buckets follow the bytes of the input, so a task's share of words stays the same.
"""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, id_bucket, settle, small_batches, worker_store
from .token_codes import WordEncoder, word_hashes, words_of

START = 49406  # ids of the vocabulary's own marks
END = 49407
VOCABULARY = 49408
WINDOW, OVERLAP = 32, 16
STEP = WINDOW - OVERLAP
FEW = 256  # left neighbours that the classes tell apart
CELLS = 1 << 16  # of a sum over all tasks, in one row


class Model:
    """Parameters: e (embeddings by row), pos, q, k, v, o (attention), w1, b1, w2 (layer), u, b (class
    logits), g, m (member logits by row). Given: row (id to row; rows lie class by class), share
    (log10 of an id's share of its row)."""

    names = ("e", "pos", "q", "k", "v", "o", "w1", "b1", "w2", "u", "b", "g", "m")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)
        self.members = len(self.g) // self.u.shape[1]

    def forward(self, rows: np.ndarray):
        """What the gradients need, and the states of the places from OVERLAP on, a one behind each for
        the biases. With one head q and k act only as the product q k', v and o as v o, so neither keys
        nor values are made: places are matched and mixed as they are. Attention weights come without
        their sums, which divide what is mixed."""
        n, t = rows.shape
        x = np.take(self.e, rows, axis=0)
        x += self.pos
        d = x.shape[2]
        y = np.ascontiguousarray(x[:, OVERLAP:]).reshape(-1, d)
        across = np.ascontiguousarray(x.transpose(0, 2, 1))
        asked = (y @ (self.q @ self.k.T)).reshape(n, -1, d)
        a = asked @ across
        a, total = _exp_sums(a, np.tri(t - OVERLAP, t, OVERLAP, dtype=a.dtype))
        mixed = a @ x
        mixed /= total[..., None]
        mixed = mixed.reshape(-1, d)
        h = mixed @ (self.v @ self.o)
        h += y
        z = h @ self.w1
        z += self.b1
        np.maximum(z, 0, out=z)
        state = np.empty((len(h), d + 1), h.dtype)
        state[:, d] = 1
        np.add(h, z @ self.w2, out=state[:, :d])
        return x, across, y, asked, a, total, mixed, h, z, state

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and biases of the class logits, and of the member logits of each class."""
        d, classes = self.u.shape
        of_members = np.empty((classes, d + 1, self.members), self.g.dtype)
        of_members[:, :d] = self.g.reshape(classes, self.members, d).transpose(0, 2, 1)
        of_members[:, d] = self.m.reshape(classes, self.members)
        return np.concatenate([self.u, self.b[None]]), of_members

    def logs(self, state: np.ndarray, goal: np.ndarray, heads=None):
        """Natural log of the probability of the row ``goal`` at each state, and what the gradients need:
        (exponents of class logits, their sums, where among them the goals are, order of the places by
        class, where each class begins in it, states in that order, exponents of member logits, their
        sums, where among them the goals are). ``heads`` is made here if not given."""
        of_classes, of_members = heads or self.heads()
        m, classes, at = self.members, len(of_members), np.arange(len(goal))
        of = goal // m
        z = state @ of_classes
        at_class = at * classes + of
        out = z.take(at_class)
        p, total = _exp_sums(z)
        out -= np.log(total)
        order = np.argsort(of.astype(np.int16), kind="stable")
        cuts = [0, *np.cumsum(np.bincount(of, minlength=classes)).tolist()]
        here, z = state.take(order, axis=0), np.empty((len(goal), m), state.dtype)
        for w, a, b in zip(of_members, cuts, cuts[1:]):
            if a < b:
                np.matmul(here[a:b], w, out=z[a:b])
        at_member = at * m + (goal - of * m).take(order)
        found = z.take(at_member)
        members, sums = _exp_sums(z)
        out[order] += found - np.log(sums)
        return out, p, total, at_class, order, cuts, here, members, sums, at_member

    def log10(self, ids: np.ndarray, targets: np.ndarray, heads=None) -> np.ndarray:
        """Of each target (ids, after the places from OVERLAP on), given the window up to its place."""
        flat = targets.ravel()
        found = self.logs(self.forward(self.row.take(ids))[-1], self.row.take(flat), heads)[0]
        return (found * np.float32(1 / np.log(10)) + self.share.take(flat)).reshape(targets.shape)


def _exp_sums(x: np.ndarray, seen=None) -> tuple[np.ndarray, np.ndarray]:
    """(exponents, their sums over the last axis), those not ``seen`` as zero; ``x`` is used up. A sum
    that leaves the middle of the type's range is made in doubles from the exponents' logs, and a row of
    attention, where only shares count, with its largest exponent taken off first."""
    ones = np.ones(x.shape[-1], x.dtype)
    low, high = np.sqrt(np.finfo(x.dtype).tiny), np.sqrt(np.finfo(x.dtype).max)
    if max(x.max(initial=0), -x.min(initial=0)) < np.log(high) - np.log(x.shape[-1]):
        np.exp(x, out=x)
        if seen is not None:
            x *= seen
        return x, x @ ones
    e = np.exp(x.astype(np.float64))
    if seen is not None:
        x = np.where(seen > 0, x, -np.inf)
        e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e, e @ ones


def lay_out(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, start of each window, its sequence). Each sequence stands behind OVERLAP start
    marks; its windows begin STEP places apart and score the places from OVERLAP on, which hold its
    ids and the end mark; targets of places beyond are -1."""
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    count = -(-lengths // STEP)
    size = OVERLAP + count * STEP
    begin = np.cumsum(size) - size
    inputs, targets = np.full(int(size.sum()), END, np.int32), np.full(int(size.sum()), -1, np.int32)
    for a, n, s in zip(begin.tolist(), lengths.tolist(), sequences):
        inputs[a : a + OVERLAP + 1] = START
        inputs[a + OVERLAP + 1 : a + OVERLAP + n] = s
        targets[a + OVERLAP : a + OVERLAP + n - 1] = s
        targets[a + OVERLAP + n - 1] = END
    seq = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count)
    return inputs, targets, begin[seq] + number * STEP, seq


def score_sequences(model: Model, sequences: list[np.ndarray], chunk: int = 256, places: int = 1 << 20) -> np.ndarray:
    """log10 probability of each id sequence, the end mark included; ``places`` bounds what is laid out
    at a time, but for a longer sequence."""
    out, a, heads = np.zeros(len(sequences)), 0, model.heads()
    while a < len(sequences):
        b, size = a + 1, len(sequences[a])
        while b < len(sequences) and size + len(sequences[b]) <= places:
            size += len(sequences[b]) + WINDOW
            b += 1
        inputs, targets, starts, seq = lay_out(sequences[a:b])
        place = np.arange(WINDOW)
        for k in range(0, len(starts), chunk):
            index = starts[k : k + chunk, None] + place
            goal = targets[index[:, OVERLAP:]]
            scores = model.log10(inputs[index], np.maximum(goal, 0), heads)
            out[a:b] += np.bincount(seq[k : k + chunk], np.where(goal >= 0, scores, 0).sum(axis=1, dtype=np.float64), b - a)
        a = b
    return out


def rows_of(count: np.ndarray, rows: int) -> np.ndarray:
    """Row of each id by count, the last for all beyond."""
    row = np.full(VOCABULARY, rows - 1)
    row[np.argsort(-count, kind="stable")[: rows - 1]] = np.arange(rows - 1)
    return row


def left_counts(inputs, targets, row: np.ndarray, rows: int) -> np.ndarray:
    """By row of an id and row of the id before it, those from FEW on as one."""
    return np.bincount(row[targets] * (FEW + 1) + np.minimum(row[inputs], FEW), minlength=rows * (FEW + 1))


def class_order(left: np.ndarray, rows: int, classes: int, seed: int) -> np.ndarray:
    """New place of each row, so that each of ``classes`` (a power of two) equal runs holds rows of like
    left neighbours: halves at the median of the leading component, again and again."""
    left, rng = left.reshape(rows, FEW + 1), np.random.default_rng(seed)
    profile = np.sqrt(left / np.maximum(1, left.sum(axis=1, keepdims=True)))
    weight = np.sqrt(left.sum(axis=1) + 1.0)
    parts = [np.arange(rows)]
    while len(parts) < classes:
        cut = []
        for r in parts:
            p = profile[r]
            p = (p - np.average(p, axis=0, weights=weight[r])) * weight[r][:, None]
            v = rng.standard_normal(FEW + 1)
            for _ in range(12):
                v = p.T @ (p @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = r[np.argsort(profile[r] @ v, kind="stable")]
            cut += [order[: len(r) // 2], order[len(r) // 2 :]]
        parts = cut
    place = np.empty(rows, np.int64)
    place[np.concatenate(parts)] = np.arange(rows)
    return place


def fit(
    sequences: list[np.ndarray], d: int = 16, hidden: int = 32, classes: int = 64, rows: int = 4096, steps: int = 600, batch: int = 256, rate: float = 0.01, seed: int = 11, statistics=None
) -> Model:
    """Train on id sequences. ``statistics`` (count of each id, its row) are counted from the sequences
    if not given; ``classes`` is a power of two that divides ``rows``."""
    rng = np.random.default_rng(seed)
    inputs, targets, starts, _ = lay_out(sequences or [np.empty(0, np.int64)])
    if statistics is None:
        real = targets >= 0
        count = np.bincount(targets[real], minlength=VOCABULARY)
        by_count = rows_of(count, rows)
        statistics = count, class_order(left_counts(inputs[real], targets[real], by_count, rows), rows, classes, seed)[by_count]
    count, row = statistics
    smooth = count + 0.05
    of_row = np.bincount(row, smooth, rows)
    of_class = of_row.reshape(classes, -1).sum(axis=1)
    f = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    model = Model(
        e=f(rows, d, s=0.3), pos=f(WINDOW, d, s=0.1), q=f(d, d, s=d**-0.5), k=f(d, d, s=d**-0.5), v=f(d, d, s=d**-0.5), o=f(d, d, s=0.3 * d**-0.5),
        w1=f(d, hidden, s=d**-0.5), b1=np.zeros(hidden, np.float32), w2=f(hidden, d, s=0.3 * hidden**-0.5), u=f(d, classes, s=0.1),
        b=np.log(of_class / of_class.sum()).astype(np.float32), g=f(rows, d, s=0.1),
        m=np.log(np.maximum(of_row, 1e-9) / np.repeat(of_class, rows // classes)).astype(np.float32),
        row=row, share=np.log10(smooth / of_row[row]).astype(np.float32),
    )
    adam = Adam(model)
    for step in range(1, steps + 1):
        adam.step(*draw(rng, inputs, targets, starts, batch), rate * min(1, step / 50) * (1 - 0.95 * step / steps))
    return model


def draw(rng, inputs, targets, starts, batch: int):
    """ids and targets of windows picked at random."""
    index = starts[rng.integers(0, len(starts), batch)][:, None] + np.arange(WINDOW)
    return inputs[index], targets[index[:, OVERLAP:]]


def every_window(rng, inputs, targets, starts, batch: int, every: int = 1):
    """(ids, targets) of batches of like size, ``batch`` at most, that hold each window once, or one
    window in ``every``."""
    order = starts[rng.permutation(len(starts))][: -(-len(starts) // every)]
    for part in np.array_split(order, -(-len(order) // batch)):
        index = part[:, None] + np.arange(WINDOW)
        yield inputs[index], targets[index[:, OVERLAP:]]


class Adam:
    """All parameters lie in one run ``w``, of which the model's become views. ``m`` and ``v`` are sums,
    not means, of the gradients and their squares; the rate and the smallest divisor make up for it."""

    def __init__(self, model: Model):
        self.model, self.n, at = model, 0, 0
        self.w = np.concatenate([getattr(model, n).ravel() for n in Model.names])
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)
        for n in Model.names:
            old = getattr(model, n)
            setattr(model, n, self.w[at : at + old.size].reshape(old.shape))
            at += old.size

    def step(self, ids, targets, rate: float, run: int = 1 << 13) -> None:
        """In runs of so many parameters, which stay in the cache from one operation to the next."""
        self.n += 1
        scale = (1 - 0.99**self.n) ** -0.5
        rate, least = rate / (1 - 0.9**self.n) / scale, 1e-6 / scale
        found = gradients(self.model, ids, targets)
        g = np.concatenate([found[n].ravel() for n in Model.names], dtype=self.w.dtype, casting="same_kind")
        for k in range(0, len(g), run):
            d, m, v, w = (x[k : k + run] for x in (g, self.m, self.v, self.w))
            m *= 0.9
            m += d
            d *= d
            v *= 0.99
            v += d
            np.sqrt(v, out=d)
            d += least
            np.divide(m, d, out=d)
            d *= rate
            w -= d


def _gram(a: np.ndarray, b: np.ndarray, run: int = 256) -> np.ndarray:
    """a.T @ b by short runs of rows, which takes half the time where both are narrow."""
    whole = len(a) // run * run
    out = (a[:whole].reshape(-1, run, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, run, b.shape[1])).sum(axis=0)
    return out + a[whole:].T @ b[whole:]


def gradients(model: Model, ids, targets) -> dict:
    """Of the mean cross-entropy over the places with a target."""
    rows, flat = model.row.take(ids), targets.ravel()
    x, across, y, asked, a, total, mixed, h, z, state = model.forward(rows)
    n, t, d = x.shape
    use = flat >= 0
    weight = use * state.dtype.type(1 / max(1, np.count_nonzero(use)))
    goal = np.where(use, model.row.take(np.maximum(flat, 0)), 0)
    _, p, sums, at_class, order, cuts, here, members, of_members, at_member = model.logs(state, goal)
    # Both softmaxes less one at the goal, times their sums: a factor of each place puts that right.
    p.reshape(-1)[at_class] -= sums
    members.reshape(-1)[at_member] -= of_members
    by, by_member = (weight / sums)[:, None], (weight[order] / of_members)[:, None]
    du = _gram(state * by, p)
    dstate, dhere = p @ model.u.T, np.empty((len(p), d), state.dtype)
    dstate *= by
    dg = np.zeros((len(model.g), d + 1), state.dtype)
    here *= by_member
    of_class = (w.reshape(-1, model.members, w.shape[1]) for w in (model.g, dg))
    for g, of_g, i, j in zip(*of_class, cuts, cuts[1:]):
        if i < j:
            np.matmul(members[i:j], g, out=dhere[i:j])
            np.matmul(members[i:j].T, here[i:j], out=of_g)
    dhere *= by_member
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    dstate += dhere.take(back, axis=0)
    dz = dstate @ model.w2.T
    dz *= z > 0
    dh = dz @ model.w1.T
    dh += dstate
    dmixed = dh @ (model.v @ model.o).T
    dmixed /= total.reshape(-1, 1)
    ds = dmixed.reshape(n, -1, d) @ across
    ds -= ((dmixed * mixed) @ np.ones(d, dmixed.dtype)).reshape(n, -1, 1)
    ds *= a
    dasked = (ds @ x).reshape(-1, d)
    dx = ds.transpose(0, 2, 1) @ asked
    dx += a.transpose(0, 2, 1) @ dmixed.reshape(n, -1, d)
    dh_y = dasked @ (model.q @ model.k.T).T
    dh_y += dh
    dx[:, OVERLAP:] += dh_y.reshape(n, -1, d)
    dqk, dvo = _gram(y, dasked), _gram(mixed, dh)
    return {
        "e": _sum_by_row(dx.reshape(-1, d), rows.ravel(), len(model.e)), "pos": dx.sum(axis=0), "q": dqk @ model.k, "k": dqk.T @ model.q, "v": dvo @ model.o.T, "o": model.v.T @ dvo,
        "w1": _gram(h, dz), "b1": np.ones(len(dz), dz.dtype) @ dz, "w2": _gram(z, dstate), "u": du[:d], "b": du[d], "g": dg[:, :d], "m": dg[:, d],
    }


def _sum_by_row(x: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the rows of ``x`` that share a ``row``. Of an even width, two numbers are added at a time
    as one complex number."""
    pair = np.result_type(x, np.complex64) if x.shape[1] % 2 == 0 else x.dtype
    count, out = np.bincount(row, minlength=rows), np.zeros((rows, x.shape[1]), x.dtype)
    found = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[found]
    out.view(pair)[found] = np.add.reduceat(x.take(np.argsort(row.astype(np.int16), kind="stable"), axis=0).view(pair), first, axis=0)
    return out


def training_sequences(info: dict) -> list[np.ndarray]:
    """Ids of the documents of a block that are not held out."""
    pieces = np.split(np.frombuffer(info["pieces"], "<u2"), np.cumsum(info["sizes"])[:-1])
    return [p for p, held in zip(pieces, info["held"]) if not held]


def training_places(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of all places that have a target, without the start marks before."""
    ends = np.cumsum([len(s) + 1 for s in sequences])
    inputs, targets = np.full(int(ends[-1]), START, np.int64), np.full(int(ends[-1]), END, np.int64)
    real = np.ones(len(inputs), bool)
    real[ends - 1] = False
    targets[real] = np.concatenate(sequences)
    first = np.r_[0, ends[:-1]]
    inputs[1:] = targets[:-1]
    inputs[first] = START
    return inputs, targets


def sum_over(blocks: DataFrame, local) -> DataFrame:
    """key, at, n: the sum over all tasks of the array that ``local`` makes of the training sequences
    of a task's blocks, in runs of CELLS cells, cells of zero left out."""
    schema = "key int, at binary, n binary"

    def emit(key, run):
        at = np.flatnonzero(run)
        return key, at.astype("<u2").tobytes(), run[at].astype("<f8").tobytes()

    def batch_of(rows):
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["key", "at", "n"])

    def of_task(batches):
        os.environ["OMP_NUM_THREADS"] = "1"
        if encoder := worker_store().get(("encoder", None)):
            encoder.store.clear()  # texts are encoded by now, and memory is short
        blocks = (training_sequences(r) for batch in batches for r in batch.to_pylist())
        found = local(b for b in blocks if b)
        if found is not None:
            yield batch_of([emit(k, found[k * CELLS : (k + 1) * CELLS]) for k in range(-(-len(found) // CELLS))])

    def add(batches):
        key, run = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        yield batch_of([emit(key, run)])
                    key, run = r["key"], np.zeros(CELLS)
                run[np.frombuffer(r["at"], "<u2")] += np.frombuffer(r["n"], "<f8")
        if key is not None:
            yield batch_of([emit(key, run)])

    return blocks.mapInArrow(of_task, schema).repartition("key").sortWithinPartitions("key").mapInArrow(add, schema)


def dense(table: pa.Table, size: int) -> np.ndarray:
    out = np.zeros(-(-size // CELLS) * CELLS)
    for key, at, n in zip(*(table.column(c).to_pylist() for c in range(3))):
        out[key * CELLS + np.frombuffer(at, "<u2").astype(np.int64)] = np.frombuffer(n, "<f8")
    return out[:size]


def counted_by(count):
    """The sum of ``count`` over all places, for ``sum_over``."""

    def local(blocks):
        total = None
        for sequences in blocks:
            found = count(*training_places(sequences))
            if total is None:
                total = found
            else:
                total += found
        return total

    return local


def train(
    docs: DataFrame, max_rows: int = 1500, max_bytes: int = 24 << 20, split: int = 7, held: int = 2, prepared: DataFrame | None = None, every: int = 1, batch: int = 256, **options
) -> Model:
    """Fit on all documents but those of crc32(id) mod ``split`` = ``held``.

    Ids and left neighbours are counted over all of them. The first steps are taken in one task, on
    at most ``max_rows`` documents and ``max_bytes`` of ids of some blocks; from there all tasks go
    over every window of all training documents, those included, and the weights are averaged by
    windows. ``model.windows`` is how many that were; ``every`` above 1 takes one in so many.
    ``prepared`` is ``prepare(docs)``, made here if not given.
    """
    if prepared is None:
        prepared = prepare(docs, split, held)
    whole = prepared.where("info is not null")
    blocks = whole.select("info.held", "info.sizes", "info.pieces")
    rows, classes, seed = (options.pop(k, v) for k, v in (("rows", 4096), ("classes", 64), ("seed", 11)))
    count = fit_in_task(sum_over(blocks, counted_by(lambda i, t: np.bincount(t, minlength=VOCABULARY))), lambda t: dense(t, VOCABULARY))
    by_count = rows_of(count, rows)
    left = sum_over(blocks, counted_by(lambda i, t: left_counts(i, t, by_count, rows)))
    row = fit_in_task(left, lambda t: class_order(dense(t, rows * (FEW + 1)), rows, classes, seed))[by_count]

    narrow = whole.select("block", F.size("info.ids").alias("n"), F.octet_length("info.pieces").alias("size"))
    some, n, size = [], 0, 0
    for r in narrow.orderBy(F.xxhash64("block"), "block").limit(64).collect():
        if some and (n >= 2 * max_rows or size + r["size"] > max_bytes):
            break
        some, n, size = [*some, r.block], n + r.n, size + r["size"]

    def learn(table):
        found = sorted(table.to_pylist(), key=lambda r: r["block"])
        sequences = [s for r in found for s in training_sequences(r)]
        order = np.random.default_rng(seed).permutation(len(sequences))[:max_rows]
        within = np.cumsum([2 * len(sequences[i]) for i in order]) <= max_bytes
        return fit([sequences[i] for i in order[within]], rows=rows, classes=classes, batch=batch, seed=seed, statistics=(count, row), **options)

    first = whole.where(F.col("block").isin(some)).select("block", "info.held", "info.sizes", "info.pieces")
    model = fit_in_task(first, learn)
    weights = {n: getattr(model, n) for n in Model.names}
    size = sum(w.size for w in weights.values())

    def go_on(blocks):
        """Weights of the task times its windows, and the windows."""
        own, windows = Model(row=row, **{n: w.copy() for n, w in weights.items()}), 0
        adam = Adam(own)
        for sequences in blocks:
            inputs, targets, starts, _ = lay_out(sequences)
            rng = np.random.default_rng([seed, len(inputs)])
            for ids, goal in every_window(rng, inputs, targets, starts, batch, every):
                adam.step(ids, goal, 0.005 * (1 + adam.n / 100) ** -0.5 * min(1, len(ids) / batch))
                windows += len(ids)
        return np.r_[adam.w.astype(float) * windows, windows] if windows else None

    found = fit_in_task(sum_over(blocks, go_on), lambda t: dense(t, size + 1))
    at, model.windows = 0, int(found[-1])
    if model.windows:
        for n, w in weights.items():
            setattr(model, n, (found[at : at + w.size] / found[-1]).reshape(w.shape).astype(np.float32))
            at += w.size
    return model


LAST = b"\n"  # stands for the end of a text: no word holds it
BUCKET_BYTES = 24 << 20  # of text for each bucket of words


INFO = "struct<ids:array<long>,held:array<boolean>,tokens:array<long>,sizes:array<long>,pieces:binary>"


def prepare(docs: DataFrame, split: int = 7, held: int = 2, block_bytes: int = 4 << 20, buckets: int | None = None) -> DataFrame:
    """Word counts of all rows by block and bucket, and the subword ids of each block (info): what
    ``train`` and ``score_documents`` share, so texts are encoded once. ``buckets`` of words follow
    the bytes of all texts if not given."""
    spark = docs.sparkSession
    small_batches(spark)
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    names = ["bucket", "block", "words", "lengths", "trained", "doc", "word", "count", "info"]
    schema = f"bucket int, block long, words binary, lengths binary, trained binary, doc binary, word binary, count binary, info {INFO}"
    info_type = pa.struct([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("pieces", pa.binary())])

    def scan(batches):
        from pyspark import TaskContext

        encoder, number = WordEncoder.of_worker(None), 0
        part = TaskContext.get().partitionId()

        def block(rows):
            nonlocal number
            found, of_text = words_of([t.lower() for _, _, t in rows])
            found = found.dictionary_encode()
            vocabulary = pa.concat_arrays([found.dictionary, pa.array([LAST], pa.binary())])
            size, every = len(vocabulary), np.arange(len(rows))
            flat = np.concatenate([found.indices.to_numpy(zero_copy_only=False), np.full(len(rows), size - 1)])
            doc = np.concatenate([of_text, every])
            pieces = encoder.encode_all([t for _, _, t in rows])
            learn = ~np.array([h for _, h, _ in rows])
            trained = np.bincount(flat[learn[doc]], minlength=size).astype("<u4")
            pairs, counts = np.unique(doc * size + flat, return_counts=True)
            bucket = (word_hashes(vocabulary) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            local = np.empty(size, np.int64)  # place of a word in its bucket
            local[order] = np.arange(size) - starts[bucket[order]]
            sorted_words = vocabulary.take(pa.array(order))
            bounds = np.frombuffer(sorted_words.buffers()[1], np.int32, size + 1)
            text, lengths, trained = sorted_words.buffers()[2].to_pybytes(), np.diff(bounds).astype("<u4"), trained[order]
            pair_doc, pair_word = pairs // size, pairs % size
            by = np.argsort(bucket[pair_word], kind="stable")
            pair_starts = np.searchsorted(bucket[pair_word[by]], np.arange(buckets + 1)).tolist()
            pair_doc, pair_word, counts = (x.astype("<u4") for x in (pair_doc[by], local[pair_word[by]], counts[by]))
            name = (part << 32) | number
            number += 1
            out = []
            for b in np.flatnonzero(np.diff(starts)).tolist():
                w, p = slice(starts[b], starts[b + 1]), slice(pair_starts[b], pair_starts[b + 1])
                out.append(
                    (b, name, text[bounds[w.start] : bounds[w.stop]], lengths[w].tobytes(), trained[w].tobytes(), pair_doc[p].tobytes(), pair_word[p].tobytes(), counts[p].tobytes(), None)
                )
            tokens = (np.bincount(of_text, minlength=len(rows)) + 1).tolist()
            info = {"ids": [i for i, _, _ in rows], "held": [bool(h) for _, h, _ in rows], "tokens": tokens, "sizes": [len(p) for p in pieces], "pieces": np.concatenate(pieces).astype("<u2").tobytes()}
            own = -1 - (part * 0x9E3779B1 + number) % (1 << 31)  # a key of its own spreads the blocks over the tasks
            out.append((own, name, None, None, None, None, None, None, info))
            columns = list(zip(*out))
            types = (pa.int32(), pa.int64(), *[pa.binary()] * 6, info_type)
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        rows, size = [], 0
        for batch in batches:
            for i, h, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                text = text or b""
                rows.append((i, h, text))
                size += len(text) + 16
                if size >= block_bytes:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    totals = "known binary, logs binary, n long, v long"

    def count(batches):
        """Rows by bucket: add up, then answer each block."""

        def answer(rows):
            lengths = [np.frombuffer(r["lengths"], "<u4") for r in rows]
            bounds = np.concatenate([[0], *lengths]).cumsum(dtype=np.int64)
            text = pa.py_buffer(b"".join([r["words"] for r in rows]))
            index = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), text]).dictionary_encode().indices
            index = index.to_numpy(zero_copy_only=False)
            total = np.bincount(index, np.concatenate([np.frombuffer(r["trained"], "<u4") for r in rows])).astype(np.int64)
            logs, out, a = np.log10(total + 1.0), [], 0
            for r, own in zip(rows, lengths):
                doc, word, n = (np.frombuffer(r[c], "<u4") for c in ("doc", "word", "count"))
                word = index[a : a + len(own)][word]
                a += len(own)
                seen = np.unique(doc)
                known = np.bincount(doc, n * (total[word] > 0))[seen]
                log = np.bincount(doc, n * logs[word])[seen]
                out.append((r["bucket"], r["block"], seen.astype("<u4").tobytes(), None, known.astype("<u4").tobytes(), log.astype("<f8").tobytes(), None, None))
            out.append((rows[0]["bucket"], None, None, None, None, None, int(total.sum()), int((total > 0).sum())))
            return batch_of(out)

        def batch_of(out):
            types = (pa.int32(), pa.int64(), pa.binary(), info_type, pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["bucket", "block", "doc", "info", "known", "logs", "n", "v"])

        held_rows = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] < 0:
                    yield batch_of([(r["bucket"], r["block"], None, r["info"], None, None, None, None)])
                    continue
                if held_rows and held_rows[0]["bucket"] != r["bucket"]:
                    yield answer(held_rows)
                    held_rows = []
                held_rows.append(r)
        if held_rows:
            yield answer(held_rows)

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(F.col("doc_id"), split) == held).alias("h"), F.col("text").cast("binary").alias("text"))
    return settle(
        base.mapInArrow(scan, schema)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(count, f"bucket int, block long, doc binary, info {INFO}, {totals}")
    )


def score_documents(
    docs: DataFrame, model: Model, split: int = 7, held: int = 2, block_bytes: int = 4 << 20, buckets: int | None = None, prepared: DataFrame | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty and hold the end alone. One row per row of ``docs``; other columns are
    ignored. With no training document every count is zero. ``prepared`` is ``prepare(docs)``, made
    here if not given.
    """
    counted = prepare(docs, split, held, block_bytes, buckets) if prepared is None else prepared
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input
    n, v = counted.agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    per_token = float(np.log10(n + (v + 1.0)))

    def add(batches):
        """Rows by block, its information first, then its buckets in order."""
        os.environ["OMP_NUM_THREADS"] = "1"
        info, known, logs = None, None, None

        def done():
            tokens = np.array(info["tokens"])
            size = len(tokens)
            pieces = np.split(np.frombuffer(info["pieces"], "<u2"), np.cumsum(info["sizes"])[:-1])
            scores = score_sequences(sent.value, pieces)
            return pa.record_batch(
                [
                    pa.array(info["ids"], pa.int64()), pa.array(info["held"], pa.bool_()), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                    pa.array([n] * size, pa.int64()), pa.array(logs - tokens * per_token, pa.float64()), pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                if r["info"] is not None:
                    if info is not None:
                        yield done()
                    info = r["info"]
                    known, logs = np.zeros(len(info["tokens"]), np.int64), np.zeros(len(info["tokens"]))
                else:
                    doc = np.frombuffer(r["doc"], "<u4")
                    known[doc] += np.frombuffer(r["known"], "<u4")
                    logs[doc] += np.frombuffer(r["logs"], "<f8")
        if info is not None:
            yield done()

    return (
        counted.where("block is not null")
        .select("block", "bucket", "doc", "info", "known", "logs")
        .repartition("block")
        .sortWithinPartitions("block", "bucket")
        .mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )
