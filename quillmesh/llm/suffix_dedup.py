"""Exact substring dedup: every byte under a string of ``length`` bytes that also starts elsewhere.

1. Anchors. Each window of ``length`` bytes names the smallest hash among its 64-byte grams, so
   equal windows name the same gram at the same place: about one byte in 70 is an anchor. Two
   windows are equal if and only if their anchors' contexts agree far enough to both sides.
2. Whole contexts. Anchors meet by gram hash. Those with an equal whole context (all bytes that a
   window through the anchor can touch) are settled at once: everything around them repeats.
3. Suffix sort. The rest of each group sends its contexts. The suffixes that start at the anchors,
   and the reversed prefixes that end there, are sorted by a mergesort that compares by prefix
   polynomial hashes: a binary search finds the common extension, the next byte decides. Adjacent
   common extensions, verified byte by byte, give the classes of equal windows at each offset.

Groups of over ``hot`` contexts are not held in a task: their windows go out as 128-bit hashes, each
from the anchor it names alone, and are counted by Spark, which is exact up to that hash and linear.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches

GRAM = 64
PIECE = 1 << 19  # bytes that are hashed at a time
SOME = 4 << 20  # bytes of texts that a task holds as objects at a time
ANCHORS = 1 << 20  # anchors among which repeats are settled before the shuffle
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OFFSET_BITS = 36


# --- anchors --------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray, powers) -> np.ndarray:
    """Hash of every 64-byte gram, from prefix sums of a polynomial modulo 2^64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * powers[1][: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def anchors(data: np.ndarray, spans: list[tuple[int, int]], powers, length: int):
    """(places, gram hashes): of every window inside a span, the place of its smallest gram."""
    n = len(data)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data, powers)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    mark = np.zeros(n + 1, np.int8)
    for a, b in spans:
        if b - a >= length:
            mark[a] += 1
            mark[b - length + 1] -= 1
    at = (least[np.cumsum(mark, dtype=np.int8)[: len(least)].astype(bool)] & low).astype(np.int64)
    if len(at):
        at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, h[at]


def own_windows(context: bytes, before: int, powers, length: int) -> np.ndarray:
    """Of the windows through the anchor at ``before``, those that name it their smallest gram, as
    bytes before the anchor. So a window that holds several anchors belongs to one of them."""
    h = gram_hashes(np.frombuffer(context, np.uint8), powers)
    low = np.uint64((1 << 24) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    return before - np.flatnonzero((least & low) == before)


def _pieces(texts: list[bytes], length: int, piece: int):
    """(document, offset of the piece in it, bytes) in pieces of about equal size; the pieces of a
    long document overlap by ``length`` - 1 bytes, so each window is in one of them."""
    held, size = [], 0
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), piece):
            part = t[a : a + piece + length - 1]
            if held and size + len(part) > piece + length:
                yield held
                held, size = [], 0
            held.append((d, a, part))
            size += len(part)
    if held:
        yield held


def find_anchors(texts: list[bytes], powers, length: int, piece: int = PIECE):
    """Arrays over all anchors of the texts: document, offset, gram hash, context hash."""
    left = length - GRAM
    out = ([], [], [], [])
    last: dict[int, int] = {}
    for held in _pieces(texts, length, piece):
        starts = np.cumsum([0, *[len(p) for _, _, p in held]])
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        at, h = anchors(data, list(zip(starts[:-1].tolist(), starts[1:].tolist())), powers, length)
        part = np.searchsorted(starts, at, "right") - 1
        doc = np.array([d for d, _, _ in held], np.int64)[part]
        off = at - starts[part] + np.array([a for _, a, _ in held], np.int64)[part]
        # An anchor where two pieces of a document overlap is taken once.
        new = off > np.array([last.get(d, -1) for d, _, _ in held], np.int64)[part]
        doc, off, h = doc[new], off[new], h[new]
        for d, o in zip(*[x[np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])].tolist() for x in (doc, off)] if len(doc) else ((), ())):
            last[d] = o
        context = [
            xxhash.xxh3_64_intdigest(texts[d][(a := o - left if o > left else 0) : o + length], o - a)
            for d, o in zip(doc.tolist(), off.tolist())
        ]
        for x, y in zip(out, (doc, off, h, np.array(context, np.uint64))):
            x.append(y)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


# --- suffix sort ----------------------------------------------------------------------------


class Suffixes:
    """Rows of bytes (padded) with lengths, compared through prefix polynomial hashes."""

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        self.rows, self.lengths = rows, lengths
        m, n = rows.shape
        self.prefix = np.zeros((m, n + 1), np.uint64)
        for t in range(n):
            self.prefix[:, t + 1] = self.prefix[:, t] * BASE + rows[:, t] + np.uint64(1)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common beginning, by binary search."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.lengths[i], self.lengths[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix[i, mid] == self.prefix[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = self.extension(i, j)
        end_i, end_j = at >= self.lengths[i], at >= self.lengths[j]
        top = self.rows.shape[1] - 1
        bytes_less = self.rows[i, np.minimum(at, top)] < self.rows[j, np.minimum(at, top)]
        return np.where(end_i | end_j, end_i & ~end_j, bytes_less)

    def sort(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order of the rows inside each group: merges of runs of 1, 2, 4, ... rows, all groups at
        once; each row finds its place in the run beside its own by binary search."""
        m = int(sizes.sum())
        start, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        place = np.arange(m) - start
        order, width = np.arange(m), 1
        while width < sizes.max(initial=0):
            run = place // width
            own = start + run * width
            even = run % 2 == 0
            beside = np.where(even, own + width, own - width)
            stop = np.where(even, np.minimum(beside + width, end), own)
            low, high = np.minimum(beside, end), np.maximum(np.minimum(beside, end), stop)
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                a, b = order[open_], order[mid]
                # A row of the left run goes before its equals of the right one.
                before = np.where(even[open_], self.less(b, a), ~self.less(a, b))
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            to = np.minimum(own, base) + (np.arange(m) - own) + (low - base)
            merged = np.empty_like(order)
            merged[to] = order
            order, width = merged, width * 2
        return order

    def neighbours(self, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Common extension of each row of ``order`` with the one before it in its group, -1 for the
        first. Extensions found by hash are verified on the bytes; after a collision the group rows
        are ordered by their bytes instead."""
        first = np.zeros(len(order), bool)
        first[starts] = True
        rest = np.flatnonzero(~first)
        i, j = order[rest - 1], order[rest]
        inside = np.arange(self.rows.shape[1])[None, :] < np.minimum(self.lengths[i], self.lengths[j])[:, None]
        agree = (self.rows[i] == self.rows[j]) & inside
        true = np.where(agree.all(axis=1), agree.shape[1], np.argmin(agree, axis=1))
        if (true != self.extension(i, j)).any():
            for s, n in zip(starts.tolist(), sizes.tolist()):
                order[s : s + n] = sorted(range(s, s + n), key=lambda r: self.rows[r, : self.lengths[r]].tobytes())
            i, j = order[rest - 1], order[rest]
            inside = np.arange(self.rows.shape[1])[None, :] < np.minimum(self.lengths[i], self.lengths[j])[:, None]
            agree = (self.rows[i] == self.rows[j]) & inside
            true = np.where(agree.all(axis=1), agree.shape[1], np.argmin(agree, axis=1))
        out = np.full(len(order), -1)
        out[rest] = true
        return out


def _matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return data.reshape(len(parts), width), lengths


def repeated_windows(group: np.ndarray, contexts: list[bytes], before: np.ndarray, length: int):
    """(row, lo, hi) relative to the anchor: unions of the windows through each anchor that are
    also windows through another anchor of its group. Rows are sorted by group; ``before`` is how
    many bytes of the context stand before its anchor."""
    reach = length - GRAM
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    right = Suffixes(*_matrix([c[b:] for c, b in zip(contexts, before.tolist())], length))
    r_order = right.sort(starts, sizes)
    r_next = right.neighbours(r_order, starts, sizes)
    left = Suffixes(*_matrix([c[:b][::-1] for c, b in zip(contexts, before.tolist())], reach))
    l_order = left.sort(starts, sizes)
    l_next = left.neighbours(l_order, starts, sizes)
    m = len(group)
    hit = np.zeros((m, reach + 2), bool)  # by bytes of the window before the anchor
    old, found = None, None
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(reach + 1):
        r_cut, l_cut = r_next < length - d, (l_next < d) | (l_next < 0)
        state = (int(r_cut.sum()), int(l_cut.sum()))
        if state != old:
            r_class[r_order], l_class[l_order] = np.cumsum(r_cut), np.cumsum(l_cut)
            _, inverse, count = np.unique(r_class * (m + 1) + l_class, return_inverse=True, return_counts=True)
            found, old = count[inverse] > 1, state
        hit[:, d] = found
    edge = np.diff(np.c_[np.zeros(m, bool), hit].astype(np.int8), axis=1)
    row_a, d_low = np.nonzero(edge == 1)
    row_b, d_end = np.nonzero(edge == -1)
    return row_a, -(d_end - 1), length - d_low


# --- the operator ---------------------------------------------------------------------------


def _some(batch):
    """(k, k2, texts) of the rows of a batch, about SOME bytes of text at a time."""
    keys, twos = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    text = batch.column(2)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(keys):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SOME, "right")))
        yield keys[a:b], twos[a:b], text.slice(a, b - a).to_pylist()
        a = b


def dedup_substrings(docs: DataFrame, length: int = 200, hot: int = 16_384) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes).

    Matches never cross documents; texts shorter than ``length`` bytes lose nothing. Null texts are
    empty. Rows that share an id are told apart by id and text; equal rows repeat each other. An
    empty table gives an empty result; other columns are ignored.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    small_batches(docs.sparkSession)
    reach = length - GRAM
    key = F.xxhash64("doc_id", "text").alias("k")
    k2 = (F.hash("text", "doc_id").cast("long").bitwiseAND(0xFFFFFF)).alias("k2")
    base = docs.select(F.col("doc_id"), key, k2, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def scan(batches):
        powers = _powers(PIECE + 4 * length)

        def settled(parts):
            """What repeats among these is settled here; one row of each such context goes on."""
            h, c, k, meta = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, h))
            same = np.zeros(len(order), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            many = same.copy()
            many[:-1] |= same[1:]
            flags = np.empty(len(order), np.int64)
            flags[order] = many.astype(np.int64) << 1 | same
            return pa.record_batch([pa.array(x) for x in (h.view(np.int64), c.view(np.int64), k, meta | flags << OFFSET_BITS)], names=["h", "c", "k", "meta"])

        held, size = [], 0
        for batch in batches:
            for keys, twos, texts in _some(batch):
                doc, off, h, c = find_anchors(texts, powers, length)
                if len(doc):
                    held.append((h, c, keys[doc], twos[doc] << (OFFSET_BITS + 2) | off))
                    size += len(doc)
                if size >= ANCHORS:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)

    one = np.int64(1)

    def meet(batches):
        """Rows sorted by done, h, c. Out: h, k, meta (k2, kind, offset in one long, which halves what is
        settled). Kinds: 0 repeats whole, 1 to be compared, 2 both (the one that stands for its class)."""

        def rows(h, c, k, meta, kind):
            packed = meta & ~np.int64(3 << OFFSET_BITS) | kind.astype(np.int64) << OFFSET_BITS
            return pa.record_batch([pa.array(h, mask=kind == 0), pa.array(k), pa.array(packed)], names=["h", "k", "meta"])

        empty = tuple(np.empty(0, np.int64) for _ in range(4))

        def settle_groups(h, c, k, meta):
            """Kinds of the rows of whole groups; -1 for a row that meets nothing."""
            new_class = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            new_group = np.r_[True, h[1:] != h[:-1]]
            size = np.bincount(np.cumsum(new_class) - 1)
            many = np.maximum.reduceat((meta >> (OFFSET_BITS + 1)) & one, np.flatnonzero(new_class)).astype(bool) | (size > 1)
            repeats = many[np.cumsum(new_class) - 1]
            classes = np.add.reduceat(new_class.astype(np.int64), np.flatnonzero(new_group))
            # A group of whole repeats alone needs no comparing either.
            singles = np.add.reduceat((new_class & ~repeats).astype(np.int64), np.flatnonzero(new_group))
            g = np.cumsum(new_group) - 1
            compare = ((classes > 1) & (singles > 0))[g]
            return np.where(repeats, np.where(compare & new_class, 2, 0), np.where(compare, 1, -1))

        buffer, big = [empty], False
        for batch in batches:
            h, c, k, meta = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            done = ((meta >> OFFSET_BITS) & one).astype(bool)
            if done.any():
                yield rows(*(x[done] for x in (h, c, k, meta)), np.zeros(int(done.sum())))
                h, c, k, meta = (x[~done] for x in (h, c, k, meta))
            if not len(h):
                continue
            h, c, k, meta = (np.concatenate(x) for x in zip(*buffer, (h, c, k, meta)))
            cut = int(np.searchsorted(h, h[-1], "left"))
            buffer = [(h[cut:], c[cut:], k[cut:], meta[cut:])]
            if len(h) - cut > 4 * hot:
                # One gram in very many contexts: repeats are let go but for one of each class, so
                # that the buffer holds a row of each context.
                part = buffer[0]
                first = np.r_[True, part[1][1:] != part[1][:-1]]
                twice = ~first
                twice[:-1] |= ~first[1:]
                if (~first).any():
                    yield rows(*(x[~first] for x in part), np.zeros(int((~first).sum())))
                    buffer = [tuple(x[first] for x in part)]
                    buffer[0][3][...] |= twice[first].astype(np.int64) << (OFFSET_BITS + 1)
            h, c, k, meta = h[:cut], c[:cut], k[:cut], meta[:cut]
            if cut:
                kind = settle_groups(h, c, k, meta)
                use = kind >= 0
                yield rows(*(x[use] for x in (h, c, k, meta)), kind[use])
        h, c, k, meta = buffer[0]
        if len(h):
            kind = settle_groups(h, c, k, meta)
            use = kind >= 0
            yield rows(*(x[use] for x in (h, c, k, meta)), kind[use])

    def cut_contexts(batches):
        def contexts(parts):
            h, k, k2, off, before = (np.concatenate(x) for x in list(zip(*parts))[:5])
            cut = [c for p in parts for c in p[5]]
            arrays = [pa.array(h), pa.array(k), pa.array(k2), pa.array(off), pa.array(before.astype(np.int32)), pa.array(cut, pa.binary())]
            return pa.record_batch(arrays, names=["h", "k", "k2", "off", "before", "context"])

        held, size = [], 0
        for batch in batches:
            wanted = batch.column(3)
            ends = wanted.offsets.to_numpy()
            off, h = (x.to_numpy(zero_copy_only=False) for x in wanted.values.flatten())
            k, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for r, text in enumerate(batch.column(2)):
                text = text.as_py()
                for a in range(int(ends[r]), int(ends[r + 1]), 4096):
                    b = min(a + 4096, int(ends[r + 1]))
                    lows = np.maximum(off[a:b] - reach, 0)
                    cut = [text[x : y + length] for x, y in zip(lows.tolist(), off[a:b].tolist())]
                    held.append((h[a:b], np.full(b - a, k[r]), np.full(b - a, k2[r]), off[a:b], off[a:b] - lows, cut))
                    size += b - a
                    if size >= 4096:
                        yield contexts(held)
                        held, size = [], 0
        if held:
            yield contexts(held)

    names = ["w1", "w2", "k", "k2", "lo", "hi"]

    def compare(batches):
        powers = _powers(2 * length)

        def intervals(t, take):
            """Of whole groups, some thousand rows at a time."""
            if take < 2:
                return
            ends = np.flatnonzero(np.r_[t[0][1:take] != t[0][: take - 1], True]) + 1
            a = 0
            while a < take:
                b = int(ends[np.minimum(np.searchsorted(ends, a + 4096), len(ends) - 1)])
                h, k, k2, off, before, context = (x[a:b] for x in t)
                a = b
                row, lo, hi = repeated_windows(h, context, before, length)
                yield pa.record_batch(
                    [pa.array(k[row]), pa.nulls(len(row), pa.int64()), pa.array(k[row]), pa.array(k2[row]), pa.array(off[row] + lo), pa.array(off[row] + hi)],
                    names=names,
                )

        def windows(t, n):
            h, k, k2, off, before, context = t
            for i in range(n):
                c, b = context[i], int(before[i])
                d = own_windows(c, b, powers, length)
                digest = np.array([divmod(xxhash.xxh3_128_intdigest(c[b - x : b - x + length]), 1 << 64) for x in d], np.uint64).reshape(-1, 2)
                lo = off[i] - np.array(d, np.int64)
                yield pa.record_batch(
                    [
                        pa.array(digest[:, 0].copy().view(np.int64)),
                        pa.array(digest[:, 1].copy().view(np.int64)),
                        pa.array(np.full(len(lo), k[i])),
                        pa.array(np.full(len(lo), k2[i])),
                        pa.array(lo),
                        pa.array(lo + length),
                    ],
                    names=names,
                )

        t, hot_h = None, None
        for batch in batches:
            new = [batch.column(x).to_numpy(zero_copy_only=False) for x in range(5)] + [batch.column(5).to_pylist()]
            t = new if t is None else [np.concatenate([a, b]) for a, b in zip(t[:5], new[:5])] + [t[5] + new[5]]
            if hot_h is not None:
                n = int(np.searchsorted(t[0], hot_h, "right"))
                yield from windows(t, n)
                t = [x[n:] for x in t]
                if not len(t[0]):
                    continue
                hot_h = None
            cut = int(np.searchsorted(t[0], t[0][-1], "left"))
            if cut >= 4096 or len(t[0]) - cut > hot:
                yield from intervals(t, cut)
                t = [x[cut:] for x in t]
            if len(t[0]) > hot and t[0][0] == t[0][-1]:
                hot_h = t[0][0]
                yield from windows(t, len(t[0]))
                t = [x[:0] for x in t]
        if t is not None and len(t[0]):
            yield from intervals(t, len(t[0]))

    done_bit = F.shiftright("meta", OFFSET_BITS).bitwiseAND(1)
    found = base.select("k", "k2", "text").where(F.length("text") >= length).mapInArrow(scan, "h long, c long, k long, meta long")
    met = (
        found.withColumn("at", F.when(done_bit == 1, F.col("k")).otherwise(F.col("h")))
        .repartition("at")
        .drop("at")
        .sortWithinPartitions(done_bit.desc(), "h", "c", "k", "meta")
        .mapInArrow(meet, "h long, k long, meta long")
    )
    met = settle(met).select(
        "h", "k", F.shiftright("meta", OFFSET_BITS + 2).alias("k2"), F.col("meta").bitwiseAND((1 << OFFSET_BITS) - 1).alias("off"),
        F.shiftright("meta", OFFSET_BITS).bitwiseAND(3).alias("kind"),
    )
    # The texts are dealt once; both joins below read the same exchange.
    texts = base.repartition("k")
    wanted = met.where("kind > 0").groupBy("k", "k2").agg(F.collect_list(F.struct("off", "h")).alias("wanted"))
    compared = settle(
        texts.join(wanted, ["k", "k2"])
        .select("k", "k2", "text", "wanted")
        .mapInArrow(cut_contexts, "h long, k long, k2 long, off long, before int, context binary")
        .repartition("h")
        .sortWithinPartitions("h")
        .mapInArrow(compare, "w1 long, w2 long, k long, k2 long, lo long, hi long")
    )
    # Intervals pass; windows of hot groups pass where their hash is seen twice. Counts combine before
    # the shuffle, so a common window is a row a task.
    windows = compared.where("w2 is not null")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    contexts = compared.where("w2 is null").drop("w1", "w2").unionByName(windows.join(twice, ["w1", "w2"], "left_semi").drop("w1", "w2"))
    whole = met.where("kind <> 1").select("k", "k2", F.greatest(F.col("off") - reach, F.lit(0)).alias("lo"), (F.col("off") + length).alias("hi"))
    spans = (
        contexts.select("k", "k2", "lo", "hi")
        .unionByName(whole)
        .groupBy("k", "k2")
        .agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    )

    def remove(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches:
            types = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            out, size = [], 0
            for r in range(batch.num_rows):
                doc_id, text, spans = (batch.column(c)[r].as_py() for c in range(3))
                merged = []
                for s in spans or ():
                    lo, hi = s["lo"], min(s["hi"], len(text))
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                ends = [0, *[x for m in merged for x in m], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))
                out.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size >= SOME:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        texts.join(spans, ["k", "k2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    )
