"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits, each read as a 23-bit word
of the perfect (23, 12) Golay code. ``keys(x)`` are the codewords within four errors of x: one or
six. Two facts about words x, y carry the search:

* at most two errors apart: ``keys(x)`` and ``keys(y)`` meet (every 4-set lies in one 7-block);
* at most one error apart: the nearest codeword of x is in ``keys(y)``.

Four errors over three segments leave either a segment without error beside one with two at most
(bucket: the exact segment and a key of the other), or two segments with one error each (bucket: a
key of both). Every pair within four bits so meets in a bucket, where it is verified.
"""

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, settle, small_batches
from .components import connected_components

SEGMENTS = ((0, 21), (21, 21), (42, 22))
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
PIECE = 4 << 20  # bytes of a text that are split into words at a time


# --- fingerprints ---------------------------------------------------------------------------


def _pieces(data: bytes, size: int):
    """The text in pieces that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        yield data[at:end]
        at = end


def fingerprint(data: bytes | None, width: int = 4, piece: int = PIECE) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 (seed 42) of the word shingles."""
    data = data or b""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in _pieces(data, piece) if len(data) > piece else (data,):
        words = tail + part.lower().split()
        if len(words) < width:
            tail = words
            continue
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        joined = b" ".join(words)
        starts = [0, *ends]
        values = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])]
        hashes = np.array(values, np.uint64)
        for k in range(0, len(hashes), 1 << 16):
            block = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        tail = words[len(words) - width + 1 :] if width > 1 else []
    if not total and tail:
        return digest(b" ".join(tail), 42)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())) if total else 0


def fingerprints(docs: DataFrame, width: int = 4, more: tuple = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the long columns ``more``. Null and wordless texts
    have fingerprint zero."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *names])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more)
    names = rows.columns[2:]
    return rows.mapInArrow(run, "doc_id long, fp long" + "".join(f", {n} long" for n in names))


# --- Golay keys -----------------------------------------------------------------------------


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """high: remainder of each 12-bit message; errors: the patterns of up to four errors by
    syndrome, nearest first; count: how many there are (one or six)."""
    high = np.zeros(4096, np.uint32)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        high[m] = r
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found[int(high[e >> 11]) ^ (e & 2047)].append(e)
    count = np.array([len(x) for x in found], np.int64)
    errors = np.array([x + x[:1] * (6 - len(x)) for x in found], np.uint32)
    return high, errors, count


def golay_keys(values: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices, nearest first, and how many of each row count."""
    high, errors, count = tables
    words = values.astype(np.uint32)
    syndrome = high[words >> 11] ^ (words & np.uint32(2047))
    return ((words[:, None] ^ errors[syndrome]) >> np.uint32(11)).astype(np.int64), count[syndrome]


def bucket_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows): all buckets of each fingerprint. A key's last bit is 0 where the row may lead
    a pair; of two rows in a bucket one at least must."""
    cut = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay_keys(c, tables) for c in cut]
    keys, rows = [], []
    index = np.arange(len(fps))
    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        code, count = near[j]
        for k in range(6):
            use = index[count > k]
            keys.append((tag << 41) | (cut[i][use] << 13) | (code[use, k] << 1))
            rows.append(use)
    for tag, (i, j) in enumerate(combinations(range(3), 2), 6):
        for a in range(6):
            for b in range(6):
                use = index[(near[i][1] > a) & (near[j][1] > b)]
                keys.append((tag << 41) | (near[i][0][use, a] << 13) | (near[j][0][use, b] << 1) | (a + b > 0))
                rows.append(use)
    return np.concatenate(keys), np.concatenate(rows)


# --- links ----------------------------------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest linked row of each of n rows."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    while (root[root] != root).any():
        root = root[root]
    return root


def _search(fps: np.ndarray, bits: int) -> np.ndarray:
    """Roots of one large bucket, breadth first: what is found is not compared again."""
    root, left = np.full(len(fps), -1), np.arange(len(fps))
    while len(left):
        start, left = left[0], left[1:]
        root[start] = start
        queue = [start]
        while queue and len(left):
            near = np.bitwise_count(fps[left] ^ fps[queue.pop()]) <= bits
            found, left = left[near], left[~near]
            root[found] = start
            queue.extend(found.tolist())
    return root


def bucket_links(key: np.ndarray, fps: np.ndarray, bits: int, small: int = 32):
    """Rows sorted by key: (a, b) fingerprints that span the links inside each bucket."""
    bucket = key >> 1
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size = np.repeat(sizes, sizes)
    some = np.flatnonzero((size > 1) & (size <= small))
    out = []
    if len(some):
        b, f, lead = bucket[some], fps[some], (key[some] & 1) == 0
        left, right = [], []
        for step in range(1, small):
            pair = np.flatnonzero((b[:-step] == b[step:]) & lead[:-step])
            if not len(pair) and not (b[:-step] == b[step:]).any():
                break
            pair = pair[np.bitwise_count(f[pair] ^ f[pair + step]) <= bits]
            left.append(pair)
            right.append(pair + step)
        if left:
            root = _roots(len(f), np.concatenate(left), np.concatenate(right))
            other = np.flatnonzero(root != np.arange(len(f)))
            out.append((f[other], f[root[other]]))
    for k in np.flatnonzero(sizes > small).tolist():
        f = fps[starts[k] : starts[k] + sizes[k]]
        root = _search(f, bits)
        other = np.flatnonzero(root != np.arange(len(f)))
        out.append((f[other], f[root[other]]))
    return out


def fingerprint_links(fps: DataFrame, bits: int = 4, hot: int = 8192) -> DataFrame:
    """fps: fp (distinct longs). Links (a, b) that connect exactly what pairs of up to ``bits``
    (4 at most) differing bits connect.

    Buckets of over ``hot`` fingerprints are not held in a task: their rows go on to
    ``midpoint_links``, which is exact and linear in them.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the code corrects up to 4 bits")

    def emit(batches):
        tables = golay_tables()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(0, len(values), 2048):
                part = values[k : k + 2048]
                keys, rows = bucket_keys(part.view(np.uint64), tables)
                yield pa.record_batch([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    def link(batches):
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)
        hot_bucket = None

        def rows(pairs):
            a = np.concatenate([p[0] for p in pairs] or [np.empty(0, np.uint64)])
            b = np.concatenate([p[1] for p in pairs] or [np.empty(0, np.uint64)])
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
            both = both.view(np.int64)
            return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        def over(values):
            return pa.record_batch([pa.array(values), pa.nulls(len(values), pa.int64())], names=["a", "b"])

        def done(k, f):
            return rows(bucket_links(k, f.view(np.uint64), bits))

        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
            if hot_bucket is not None:
                n = int(np.searchsorted(k >> 1, hot_bucket, "right"))
                yield over(f[:n])
                k, f = k[n:], f[n:]
                hot_bucket = hot_bucket if not len(k) else None
            if not len(k):
                held_k, held_f = k, f
                continue
            cut = int(np.searchsorted(k >> 1, k[-1] >> 1, "left"))
            whole_k, whole_f = k[:cut], f[:cut]
            held_k, held_f = k[cut:], f[cut:]
            sizes = np.unique(whole_k >> 1, return_counts=True)
            big = np.isin(whole_k >> 1, sizes[0][sizes[1] > hot])
            if big.any():
                yield over(whole_f[big])
            yield done(whole_k[~big], whole_f[~big])
            if len(held_k) > hot:
                yield over(held_f)
                hot_bucket = held_k[0] >> 1
                held_k, held_f = held_k[:0], held_f[:0]
        if len(held_k):
            yield done(held_k, held_f)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long")
    # A fresh column is dealt by, so that both kinds of row of a bucket meet.
    dealt = keyed.withColumn("bucket", F.shiftright("key", 1)).repartition("bucket")
    found = settle(
        dealt.drop("bucket").sortWithinPartitions("key", "fp").mapInArrow(link, "a long, b long").distinct()
    )
    hot_rows = found.where("b is null").select(F.col("a").alias("fp"))
    links = found.where("b is not null")
    return links if hot_rows.isEmpty() else links.unionByName(midpoint_links(hot_rows, bits)).distinct()


def midpoint_links(fps: DataFrame, bits: int) -> DataFrame:
    """Exact links among many close fingerprints: x and y are within ``bits`` if and only if some
    word is within ``ceil(bits / 2)`` of x and ``floor(bits / 2)`` of y. All words within
    ``floor(bits / 2)`` of one midpoint are linked; for odd ``bits`` the leading side reaches one
    bit further. One row per fingerprint and midpoint, and a minimum per midpoint."""
    inner, outer = bits // 2, bits - bits // 2
    masks = [sum(1 << b for b in c) for w in range(outer + 1) for c in combinations(range(64), w)]
    close = sum(1 for w in range(inner + 1) for _ in combinations(range(64), w))

    def reach(batches):
        flips = np.array(masks, np.uint64)
        near = np.arange(len(flips)) < close
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for v in values:
                yield pa.record_batch(
                    [pa.array((flips ^ v).view(np.int64)), pa.array(np.full(len(flips), v).view(np.int64)), pa.array(near)],
                    names=["mid", "fp", "near"],
                )

    rows = fps.distinct().mapInArrow(reach, "mid long, fp long, near boolean")
    least = rows.where("near").groupBy("mid").agg(F.min("fp").alias("b"))
    return rows.join(least, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


# --- the operator ---------------------------------------------------------------------------


def simhash_groups(docs: DataFrame, width: int = 4, bits: int = 4, hot: int = 8192) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of
    up to ``bits`` differing bits, the document's own included.

    Null and empty texts have fingerprint zero and link like any other. Rows that share a doc_id
    keep a row each. Null ids never name a component; a component of null ids alone has a null
    component_id. Exact copies are one fingerprint throughout, so groups of copies of any size are
    a count away. An empty table gives an empty result; other columns are ignored.
    """
    base = settle(fingerprints(docs, width))
    owners = settle(base.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    named = _members(base, bits, hot).join(owners, "fp").select("fp", "root", "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_linked = named.join(least, "root").select("fp", "component_id")
    of_all = owners.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    # A fingerprint with over a thousandth of the rows would crowd the task of its key: there are fewer
    # than a thousand of them, so theirs are sent to every task.
    total = owners.agg(F.sum("n")).first()[0] or 0
    of_all = settle(of_all.withColumn("crowd", F.col("n") > max(256, total // 1000)))
    crowds = F.broadcast(of_all.where("crowd").select("fp", "component_id"))
    alone = base.join(crowds, "fp", "left_anti").join(of_all.where("not crowd"), "fp")
    both = base.join(crowds, "fp").select("doc_id", "fp", "component_id").unionByName(alone.select("doc_id", "fp", "component_id"))
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _members(base: DataFrame, bits: int, hot: int) -> DataFrame:
    """fp, root of the fingerprints that are linked to others."""
    linked = connected_components(fingerprint_links(base.select("fp").distinct(), bits, hot))
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")


def drop_near_copies(docs: DataFrame, width: int = 4, bits: int = 4, hot: int = 8192) -> DataFrame:
    """The columns of ``docs``; of each component one row stays: that of the smallest id, null ids last,
    then of the smallest hash of (id, text).

    Rows are told apart by id, text and the other columns, so a row whose id another, unrelated row
    shares is not lost with it; of wholly equal rows one stays. The texts are dealt once, after equal
    rows are combined; the choice itself is made on narrow rows."""
    k1, k2 = row_key("doc_id", "text")
    plain = [c for c, kind in docs.dtypes if not ("map<" in kind or "variant" in kind)]
    k3 = F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("k3")
    base = settle(fingerprints(docs, width, (k1, k2, k3)))
    own = base.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "k3")).alias("first"))
    stays = own.join(_members(base, bits, hot), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    chosen = stays.select("first.k1", "first.k2", "first.k3")
    whole = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), k1, k2, k3)
    once = whole.groupBy("k1", "k2", "k3").agg(F.any_value("row").alias("row"))
    return once.join(chosen, ["k1", "k2", "k3"], "left_semi").select("row.*")
