"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a neighbour graph; balanced cuts of that graph give partitions; a small
network learns which partitions a vector's neighbours lie in. A partition that holds too many rows
gets a graph, cuts and a network of its own, so cells grow in number with the table. Every row is
stored in its most probable cell, every query visits the several most probable ones and reranks
all it finds there by exact distance. How many are visited is set, for a stated recall, on rows of
the sample that the first network was not fitted on (one below a crowded part may have met some).
"""

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_in_task, settle


# --- graph and partitions -------------------------------------------------------------------


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest rows of each row, itself left out."""
    n, out = len(x), []
    norms = (x * x).sum(axis=1)
    for a in range(0, n, 1024):
        d = norms[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _halves(near: np.ndarray, rows: np.ndarray, rng, rounds: int = 60) -> np.ndarray:
    """Which rows go to the second half: the median cut of a smooth vector of the graph."""
    n = len(rows)
    local = np.full(len(near), -1)
    local[rows] = np.arange(n)
    src = np.repeat(np.arange(n), near.shape[1])
    dst = local[near[rows]].ravel()
    inside = dst >= 0
    src, dst = src[inside], dst[inside]
    degree = np.bincount(src, minlength=n) + np.bincount(dst, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(rounds):
        v -= (degree @ v) / degree.sum()
        v = (v + np.bincount(src, v[dst], n) + np.bincount(dst, v[src], n)) / degree
        v /= np.abs(v).max() or 1.0
    order = np.lexsort((np.arange(n), v))
    second = np.zeros(n, bool)
    second[order[n // 2 :]] = True
    return second


def balanced_partition(near: np.ndarray, parts: int, seed: int = 7, slack: float = 1.05, passes: int = 8) -> np.ndarray:
    """A part (0 to ``parts`` - 1, a power of two) for each row: spectral halves, then moves that
    cut fewer edges, while no part grows beyond ``slack`` times its share."""
    n, rng = len(near), np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    step = 1
    while step < parts:
        for p in range(step):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                part[rows[_halves(near, rows, rng)]] = p + step
        step *= 2
    most = int(np.ceil(slack * n / parts))
    edges = np.concatenate([np.c_[np.repeat(np.arange(n), near.shape[1]), near.ravel()], np.c_[near.ravel(), np.repeat(np.arange(n), near.shape[1])]])
    for _ in range(passes):
        votes = np.zeros((n, parts))
        np.add.at(votes, (edges[:, 0], part[edges[:, 1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


# --- router ---------------------------------------------------------------------------------


class Router:
    """One hidden layer; softmax over partitions."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale = mean, scale
        self.w = [a.astype(np.float32) for a in (w1, b1, w2, b2)]

    @property
    def parts(self) -> int:
        return self.w[2].shape[1]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.w
        s = np.maximum(((x - self.mean) / self.scale).astype(np.float32) @ w1 + b1, 0) @ w2 + b2
        s -= s.max(axis=1, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=1, keepdims=True))

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.log_probabilities(x).argmax(axis=1)


def one_part(dim: int) -> Router:
    return Router(np.zeros(dim), 1.0, np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))


def held_back(n: int) -> np.ndarray:
    """Every fourth row of a sample, in its order of hashes: what the first network is not fitted on."""
    return np.arange(n) % 4 == 3


def fit(x: np.ndarray, parts: int = 16, k: int = 10, hidden: int = 96, epochs: int = 60, seed: int = 7) -> Router:
    """Partition the neighbour graph of ``x`` and learn to route. Too few rows give one part."""
    n, dim = x.shape
    parts = min(parts, 1 << int(np.log2(max(2, n // 4))))
    if n <= 4 * k or parts < 2:
        return one_part(dim)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std() or 1.0
    near = neighbour_graph(x, min(k, n - 1))
    part = balanced_partition(near, parts, seed)
    # A row's target: where it and its neighbours lie.
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
    target[np.arange(n), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    p = [
        rng.standard_normal((dim, hidden)) * np.sqrt(2 / dim),
        np.zeros(hidden),
        rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden),
        np.zeros(parts),
    ]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = (s / s.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            grads = [z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *p)


class Routes:
    """A router over parts and, below crowded parts, routers over their cells: ``width`` + 1 at most."""

    def __init__(self, top: Router, below: dict[int, Router], width: int):
        self.top, self.below, self.width, self.probes, self.recall = top, below, width, 1, 0.0
        self.cells = np.array([p * width + s for p in range(top.parts) for s in range(below[p].parts if p in below else 1)])

    def home(self, x: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """The cell each row is stored in."""
        part = self.top.home(x) if part is None else part
        cell = part.astype(np.int64) * self.width
        for p in np.unique(part).tolist():
            if p in self.below:
                mine = part == p
                cell[mine] += self.below[p].home(x[mine])
        return cell

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """All cells for each row, the most probable first."""
        top = self.top.log_probabilities(x)
        score = [top[:, [p]] + (self.below[p].log_probabilities(x) if p in self.below else 0) for p in range(self.top.parts)]
        return self.cells[np.argsort(-np.concatenate(score, axis=1), axis=1, kind="stable")]

    def settle_probes(self, x: np.ndarray, k: int, recall: float) -> "Routes":
        """Visit the fewest cells that hold ``recall`` of the neighbours, among the whole sample
        ``x``, of those of its rows that are held back."""
        asked = np.flatnonzero(held_back(len(x)))
        if not len(asked):
            self.probes, self.recall = len(self.cells), 1.0
            return self
        near = neighbour_graph(x, min(k, len(x) - 1))[asked]
        place = np.zeros((len(asked), int(self.cells.max()) + 1), np.int64)
        np.put_along_axis(place, self.ranked(x[asked]), np.arange(len(self.cells))[None, :].repeat(len(asked), 0), axis=1)
        visit = np.sort(place[np.arange(len(asked))[:, None], self.home(x)[near]].ravel())
        reached = np.searchsorted(visit, np.arange(1, len(self.cells) + 1)) / len(visit)
        enough = np.flatnonzero(reached >= recall)
        self.probes = int(enough[0]) + 1 if len(enough) else len(self.cells)
        self.recall = float(reached[self.probes - 1])
        return self


# --- search ---------------------------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec of the vectors that take part: of the commonest length, without null or
    non-finite components, not all zero, with an id."""
    sized = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    clean = sized.where(
        "vec_id is not null and vec is not null and size(vec) > 0"
        " and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    common = clean.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return clean.where(F.size("vec") == (common[0].d if common else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distinct_nearest(rows: DataFrame, k: int) -> DataFrame:
    """rows (vec_id, vec) without the copies that no answer can hold: of equal vectors only the
    k + 1 smallest ids can be among the k nearest of any query, since ties go to smaller ids. The
    limit is applied before the shuffle too, so a vector that a third of the rows share stays small."""
    same = Window.partitionBy("_key", "vec").orderBy("vec_id")
    ranked = rows.withColumn("_key", F.xxhash64("vec")).withColumn("_rank", F.dense_rank().over(same)).where(F.col("_rank") <= k + 1)
    return ranked.groupBy("_key", "vec", "vec_id").agg(F.lit(1).alias("_one")).select("vec_id", "vec")


def _sample(rows: DataFrame, most: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("vec")).limit(most)


def _power(n: float, least: int, most: int) -> int:
    return 1 << int(np.clip(np.round(np.log2(max(n, 1))), least, most))


def _crowded_routers(parted: DataFrame, crowded: dict[int, int], sample: int, cell: int, width: int, k: int) -> dict[int, Router]:
    """A router for each crowded part, fitted in executor tasks on at most ``sample`` of its rows,
    those of the smallest hash. What comes back is at most ``width`` routers."""
    spark = parted.sparkSession
    share = spark.createDataFrame([(p, min(1.0, 1.2 * sample / n)) for p, n in crowded.items()], "part int, share double")
    # Hashes spread evenly over 2^63: about 1.2 samples of rows leave each part.
    place = F.xxhash64("vec_id", "vec", F.lit(3))
    chosen = parted.join(F.broadcast(share), "part").withColumn("_at", place).where("(_at & 9223372036854775807) <= share * 9223372036854775807D")

    def run(batches):
        here, ids, held = None, 0, []

        def learnt():
            x = np.concatenate(held)[:sample]
            return pa.record_batch([pa.array([here], pa.int32()), pa.array([cloudpickle.dumps(fit(x, _power(crowded[here] / cell, 1, int(np.log2(width))), k))], pa.binary())], names=["part", "model"])

        for batch in batches:
            part, x = batch.column(0).to_numpy(zero_copy_only=False), None
            for p in dict.fromkeys(part.tolist()):
                if p != here:
                    if held:
                        yield learnt()
                    here, ids, held = p, 0, []
                if ids < sample:
                    x = _matrix(batch.column(1)) if x is None else x
                    held.append(x[part == p])
                    ids += len(held[-1])
        if held:
            yield learnt()

    rows = chosen.select("part", "vec", "_at", "vec_id").repartition(len(crowded), "part").sortWithinPartitions("part", "_at", "vec_id")
    return {r.part: cloudpickle.loads(r.model) for r in rows.select("part", "vec").mapInArrow(run, "part int, model binary").collect()}


def search(
    vectors: DataFrame,
    query_filter: str = "vec_id % 100 = 0",
    k: int = 10,
    sample: int = 4096,
    recall: float = 0.97,
    block: int = 8192,
    parts: int | None = None,
    cell: int = 3000,
    width: int = 64,
) -> tuple[DataFrame, Routes | None]:
    """(query_id, rank, vec_id, score), routes. Queries are the rows of ``query_filter``, against
    every other row.

    Networks are fitted, in executor tasks, on at most ``sample`` rows each, those of the smallest
    hash of id; every row is indexed but copies of a vector beyond its k + 1 smallest ids, which
    cannot be answers. Parts, and cells below parts of over ``2 * cell`` rows, aim at ``cell`` rows;
    a router has ``width`` parts at most, a power of two.
    A query visits more cells than the learned number where those hold k other ids too few. A cell
    is searched in blocks of about ``block`` rows and queries stream past one block at a time, so
    a crowded cell does not fill a task. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part, nor do null ids; an id that repeats counts
    once, by its nearest vector. Equal distances go to the smaller vec_id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    clean = usable(vectors)
    rows = settle(distinct_nearest(clean, k))
    total = rows.count()
    if total < 2:
        return spark.createDataFrame([], schema), None
    parts = parts or _power(total / cell, 2, int(np.log2(width)))

    def learn(table):
        x = _matrix(table.column("vec").combine_chunks())
        return fit(x[~held_back(len(x))], parts, k)

    chosen = _sample(rows, sample)
    top = fit_in_task(chosen, learn)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([pa.array(top.home(_matrix(batch.column(1))).astype(np.int32)), *batch.columns], names=["part", "vec_id", "vec"])

    parted = settle(rows.mapInArrow(put, "part int, vec_id long, vec array<double>"))
    sizes = {r.part: r.n for r in parted.groupBy("part").agg(F.count("*").alias("n")).collect()}  # ``width`` rows at most
    crowded = {p: n for p, n in sizes.items() if n > 2 * cell and parts == width}
    below = _crowded_routers(parted, crowded, sample, cell, width, k) if crowded else {}
    routes = Routes(top, below, width)
    routes = fit_in_task(chosen, lambda table: routes.settle_probes(_matrix(table.column("vec").combine_chunks()), k, recall))
    sent = spark.sparkContext.broadcast(routes)  # ``width`` + 1 small networks at most

    def store(batches):
        for batch in batches:
            if batch.num_rows:
                home = sent.value.home(_matrix(batch.column(2)), batch.column(0).to_numpy(zero_copy_only=False))
                yield pa.record_batch([pa.array(home.astype(np.int32)), batch.column(1), batch.column(2)], names=["cell", "vec_id", "vec"])

    stored = settle(parted.mapInArrow(store, "cell int, vec_id long, vec array<double>"))
    # Rows of each cell, and ids that no cell before it holds: a row a cell, width * width at most.
    held = stored.groupBy("cell").agg(F.count("*").alias("n"))
    first = stored.groupBy("vec_id").agg(F.min("cell").alias("cell")).groupBy("cell").agg(F.count("*").alias("own"))
    held = held.join(first, "cell", "left").collect()
    blocks, own = np.zeros(width * width, np.int64), np.zeros(width * width, np.int64)
    for r in held:
        blocks[r.cell], own[r.cell] = -(-r.n // block), r.own or 0

    def visit(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):  # all cells are ranked for 512 queries at a time
                some = batch.slice(a, 512)
                cells = sent.value.ranked(_matrix(some.column(1)))
                short = (np.cumsum(own[cells], axis=1) < k + 1).sum(axis=1) + 1
                seen = np.arange(cells.shape[1])[None, :] < np.maximum(short, sent.value.probes)[:, None]
                times = np.where(seen, blocks[cells], 0).ravel()
                at = np.repeat(np.repeat(np.arange(len(cells)), cells.shape[1]), times)
                number = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                out = some.take(pa.array(at))
                columns = [np.repeat(cells.ravel(), times).astype(np.int32), number.astype(np.int32), np.ones(len(at), np.int32)]
                yield pa.record_batch([*map(pa.array, columns), out.column(0), out.column(1)], names=["part", "block", "kind", "vec_id", "vec"])

    of_cell = F.broadcast(spark.createDataFrame([(r.cell, int(blocks[r.cell])) for r in held], "cell int, blocks int"))
    candidates = stored.join(of_cell, "cell").select(
        F.col("cell").alias("part"), F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks").cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "vec"
    )
    queries = clean.where(query_filter).distinct().mapInArrow(visit, "part int, block int, kind int, vec_id long, vec array<double>")

    def rerank(batches):
        here, parts_x, ids, data, norms, starts = None, [], None, None, None, None

        def index():
            """Candidates of the block by id, and where each id starts."""
            all_ids = np.concatenate([p[0] for p in parts_x])
            all_x = np.concatenate([p[1] for p in parts_x])
            order = np.argsort(all_ids, kind="stable")
            all_ids, all_x = all_ids[order], all_x[order]
            starts = np.flatnonzero(np.r_[True, all_ids[1:] != all_ids[:-1]])
            return all_ids, all_x, (all_x * all_x).sum(axis=1), starts

        def answer(q_ids, q):
            out = [[], [], []]
            for a in range(0, len(q), 64):
                part = q[a : a + 64]
                rough = norms[None, :] - 2 * part @ data.T
                for i, r in enumerate(rough):
                    own = ids == q_ids[a + i]
                    r[own] = np.inf
                    n = min(k + (len(ids) - len(starts)), len(ids))
                    edge = np.partition(r, n - 1)[n - 1]
                    # Rounding of the short form cannot hide a true neighbour behind this margin.
                    near = np.flatnonzero((r <= edge + 1e-9 * (1 + abs(edge) + norms.max() + part[i] @ part[i])) & ~own)
                    exact = np.sqrt(((data[near] - part[i]) ** 2).sum(axis=1))
                    order = np.lexsort((ids[near], exact))
                    near, exact = near[order], exact[order]
                    _, first = np.unique(ids[near], return_index=True)
                    keep = np.sort(first)[:k]
                    out[0] += [int(q_ids[a + i])] * len(keep)
                    out[1] += ids[near[keep]].tolist()
                    out[2] += exact[keep].tolist()
            return pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, number, kind, vec_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = _matrix(batch.column(4))
            group = part.astype(np.int64) << 32 | number
            cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
                if group[a] != here:
                    here, parts_x, ids = group[a], [], None
                if kind[a] == 0:
                    parts_x.append((vec_ids[a:b], x[a:b]))
                elif parts_x:
                    if ids is None:
                        ids, data, norms, starts = index()
                    yield answer(vec_ids[a:b], x[a:b])

    found = (
        candidates.unionByName(queries)
        .repartition("part", "block")
        .sortWithinPartitions("part", "block", "kind")
        .mapInArrow(rerank, "query_id long, vec_id long, score double")
    )
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score"), routes
