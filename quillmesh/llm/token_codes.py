"""Token ids as directly addressable codes.

An id is cut into chunks of eight bits, low chunk first. Level k holds the k-th chunk of every id
that has one; a bitmap beside each level says which ids go on to the next, and a rank directory
(ones before every 512 bits) turns a place on one level into a place on the next. Any id is read
in one probe a level, and any slice without decoding what is around it.

File layout, little-endian: b"DAC1", levels u32, then per level n u64, the chunks (n bytes), the
bitmap ((n + 7) // 8 bytes), the directory (u64 for each 512 bits begun).
"""

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, worker_store

MAGIC = b"DAC1"
BLOCK = 512


def encode_codes(ids: np.ndarray) -> bytes:
    values = np.asarray(ids, np.uint64)
    levels = []
    while True:
        more = values > 255
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint64) if len(more) else np.empty(0, np.uint64)
        directory = np.r_[np.uint64(0), np.cumsum(ones, dtype=np.uint64)][: len(ones)].astype("<u8")
        levels.append(
            struct.pack("<Q", len(values))
            + (values & np.uint64(255)).astype(np.uint8).tobytes()
            + np.packbits(more, bitorder="little").tobytes()
            + directory.tobytes()
        )
        values = values[more] >> np.uint64(8)
        if not len(values):
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)


class Codes:
    """Random access to an encoded sequence."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a code file")
        (count,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at + n)
            at += n + len(bits)
            directory = np.frombuffer(data, "<u8", -(-n // BLOCK), at)
            at += 8 * len(directory)
            self.levels.append((chunks, bits, directory))

    def __len__(self):
        return len(self.levels[0][0])

    @staticmethod
    def _rank(level, i: int) -> int:
        """Ones before bit i."""
        chunks, bits, directory = level
        if not i:
            return 0
        block = (i - 1) // BLOCK
        ones = int(directory[block])
        start, whole = block * (BLOCK // 8), i // 8
        ones += int(np.bitwise_count(bits[start:whole]).sum())
        return ones + (int(bits[whole]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][i]) << 8 * k
            if not level[1][i // 8] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int, k: int = 0) -> np.ndarray:
        level = self.levels[k]
        values = level[0][a:b].astype(np.uint64)
        bits = np.unpackbits(level[1][a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a].astype(bool)
        if bits.any():
            start = self._rank(level, a)
            values[bits] |= self.slice(start, start + int(bits.sum()), k + 1) << np.uint64(8)
        return values


# --- encoding texts -------------------------------------------------------------------------


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte its kind (0 white space, 1 ASCII letter, 2 plain mark, 4 other) and its lower case."""
    kind, lower = np.full(256, 4, np.uint8), np.arange(256, dtype=np.uint8)
    kind[[32, *range(9, 14)]] = 0
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[list(b".,!?%&$#*;:")] = 2
    lower[65:91] += 32
    return kind, lower


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words, number of the text of each): runs of bytes other than space and 0x09-0x0D."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    own = (data != 32) & ((data < 9) | (data > 13))
    before = np.r_[False, own[:-1]]
    starts, stops = np.flatnonzero(own & ~before), np.flatnonzero(before & ~own)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=bounds[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[own])]).cast(pa.binary())
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")


POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _hashes(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the words that lie end to end; places beyond the table wrap round."""
    size = np.diff(bounds)
    place = np.arange(len(text), dtype=np.int32) - np.repeat(bounds[:-1], size)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * POWERS[place & 0xFFF], out=sums[1:])
    h = sums[bounds[1:]] - sums[bounds[:-1]]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.Array) -> np.ndarray:
    bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)
    h = _hashes(np.frombuffer(words.buffers()[2], np.uint8, int(bounds[-1])), bounds)
    return h ^ (h >> np.uint64(32))


class WordStore:
    """Words met lately and their ids, in flat arrays in order of a 64-bit hash; a hit is verified on
    the bytes. Beyond ``limit`` bytes only words that were met again stay, or none."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes, self.text, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint8), np.empty(0, "<u2")
        self.at, self.size, self.first, self.count = (np.empty(0, np.int32) for _ in range(4))
        self.used = np.empty(0, bool)

    def find(self, hashes: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Place of each word here, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        size = np.diff(bounds)
        likely = np.flatnonzero((self.hashes[place] == hashes) & (self.size[place] == size))
        here, n = place[likely], size[likely]
        step = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(np.cumsum(n, dtype=np.int32) - n, n)
        differ = self.text[np.repeat(self.at[here], n) + step] != text[np.repeat(bounds[:-1][likely], n) + step]
        good = np.ones(len(likely), bool)
        good[np.repeat(np.arange(len(likely)), n)[differ]] = False
        found = np.full(len(hashes), -1)
        found[likely[good]] = here[good]
        self.used[here[good]] = True
        return found

    def add(self, hashes, text, bounds, ids, counts) -> None:
        """Words that are not here; ``text`` and ``ids`` lie end to end."""
        if self.text.nbytes + self.ids.nbytes + 26 * len(self.hashes) > self.limit:
            self._shrink()
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        put = lambda old, new: np.insert(old, place, new[order])
        self.at, self.size = put(self.at, bounds[:-1] + np.int32(len(self.text))), put(self.size, np.diff(bounds))
        self.first, self.count = put(self.first, (np.cumsum(counts) - counts + len(self.ids)).astype(np.int32)), put(self.count, counts.astype(np.int32))
        self.used, self.hashes = put(self.used, np.zeros(len(hashes), bool)), put(self.hashes, hashes)
        self.text, self.ids = np.concatenate([self.text, text]), np.concatenate([self.ids, ids.astype("<u2")])

    def _shrink(self) -> None:
        if self.used.mean() > 0.5:
            return self.clear()
        for name in ("hashes", "at", "size", "first", "count"):
            setattr(self, name, getattr(self, name)[self.used])
        self.text, self.ids = _runs(self.text, self.at, self.size), _runs(self.ids, self.first, self.count)
        self.at, self.first = ((np.cumsum(n) - n).astype(np.int32) for n in (self.size, self.count))
        self.used = np.zeros(len(self.hashes), bool)


def _runs(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + count] end to end."""
    total = np.cumsum(count, dtype=np.int32)
    at = np.repeat(first - (total - count), count)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class WordEncoder:
    """Encodes by words, each distinct word of a slice of text once.

    This tokenizer never joins what white space divides, nor letters and marks, so texts are cut at
    both. Runs of Latin letters and runs of plain marks are single pre-tokens: they are put in lower
    case here and go to the library's model without its normalizer and pattern; their last id alone
    ends a word, so the ids of many words fall apart again at those. All other runs go through the
    whole tokenizer one by one. Memory is bounded by ``slice_bytes``, the longest word and
    ``store_bytes`` of words met lately.
    """

    def __init__(self, path: str | None = None, slice_bytes: int = 4 << 20, store_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer, self.slice_bytes = Tokenizer.from_file(path), slice_bytes
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind, self.lower = _byte_kinds()
        self.store = WordStore(store_bytes)

    @classmethod
    def of_worker(cls, path: str | None) -> "WordEncoder":
        """One encoder for each Python worker: loading costs more than a small task."""
        store = worker_store()
        return store.get(("encoder", path)) or store.setdefault(("encoder", path), cls(path))

    def _one_by_one(self, words: list[bytes]) -> list[list[int]]:
        found = []
        for k in range(0, len(words), 4096):
            some = [w.decode("utf-8", "replace") for w in words[k : k + 4096]]
            found += [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return found

    def _encode_plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of distinct lower-case words."""
        ids, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(words), 8192):
            some = words.slice(k, 8192)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), b" ")[0].as_py().decode()
            found = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(some) or (len(cuts) and cuts[-1] != len(found)):
                lists = self._one_by_one(some.to_pylist())
                found, cuts = np.array([i for x in lists for i in x], "<u4"), np.cumsum([len(x) for x in lists])
            ids.append(found)
            counts.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def _plain_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each word, where they begin), by the store where it can."""
        if not len(words):
            return np.empty(0, "<u4"), np.empty(0, np.int32), np.empty(0, np.int32)
        store, (_, offsets, data) = self.store, words.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(words) + 1)
        text = np.frombuffer(data, np.uint8, int(bounds[-1])) if bounds[-1] else np.empty(0, np.uint8)
        hashes = _hashes(text, bounds)
        place = store.find(hashes, text, bounds)
        old, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        counts = np.empty(len(words), np.int32)
        counts[old] = store.count[place[old]]
        ids = _runs(store.ids, store.first[place[old]], counts[old]).astype("<u4")
        fresh, counts[new] = self._encode_plain(words.take(pa.array(new)))
        # Ids lie in the order of ``old``, then of ``new``; each word's begin there.
        order = np.concatenate([old, new])
        begin = np.empty(len(words), np.int32)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        if len(new):
            size = np.diff(bounds)[new]
            own = np.r_[np.int32(0), np.cumsum(size, dtype=np.int32)]
            store.add(hashes[new], _runs(text, bounds[:-1][new], size), own, fresh, counts[new])
        return np.concatenate([ids, fresh]), counts, begin

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text in them)."""
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        kind, lower = self.kind[data], self.lower[data]
        # Two bytes from C3 80 to C3 BF are a Latin letter, but for the signs of multiplication and division.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = data[lead + 1]
        lead = lead[(after & 0xC0 == 0x80) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        upper = lead[data[lead + 1] < 0x9F] + 1
        lower[upper] += 32
        before = np.r_[np.uint8(0), kind[:-1]]
        divided = (before ^ kind) == 3  # a letter beside a mark
        starts = np.flatnonzero((kind != 0) & ((before == 0) | divided)).astype(np.int32)
        stops = np.flatnonzero((before != 0) & ((kind == 0) | divided)).astype(np.int32)
        own = kind != 0
        rest = np.unique(np.searchsorted(starts, np.flatnonzero(kind == 4), "right") - 1)
        plain = np.ones(len(starts), bool)
        plain[rest] = False
        if len(rest):
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[rest]] = 1
            edge[stops[rest]] -= 1
            own &= np.cumsum(edge[:-1], dtype=np.int8) == 0
        bounds = np.zeros(int(plain.sum()) + 1, np.int32)
        np.cumsum((stops - starts)[plain], out=bounds[1:])
        words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(lower[own])]).dictionary_encode()
        ids, counts, begin = self._plain_ids(words.dictionary)
        index = np.empty(len(starts), np.int32)
        index[plain] = words.indices.to_numpy(zero_copy_only=False)
        if len(rest):
            blob, place = data.tobytes(), {}
            index[rest] = [place.setdefault(blob[a:b], len(place) + len(counts)) for a, b in zip(starts[rest].tolist(), stops[rest].tolist())]
            lists = self._one_by_one(list(place))
            more = np.array([len(x) for x in lists], np.int32)
            begin = np.concatenate([begin, (len(ids) + np.cumsum(more) - more).astype(np.int32)])
            ids = np.concatenate([ids, np.array([i for x in lists for i in x], "<u4")])
            counts = np.concatenate([counts, more])
        many = counts[index]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return _runs(ids, begin[index], many), np.r_[0, np.cumsum(many)][np.searchsorted(starts, ends)]

    def _parts(self, texts: list[bytes]):
        """(text number, bytes) of at most about ``slice_bytes``, cut at white space."""
        for k, t in enumerate(texts):
            a = 0
            while True:
                b = a + self.slice_bytes
                while b < len(t) and self.kind[t[b]]:
                    b += 1
                yield k, t[a:b]
                a = b
                if a >= len(t):
                    break

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        held, size = [], 0

        def done():
            ids, ends = self._slice([t for _, t in held])
            for (k, _), a, b in zip(held, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                found[k].append(ids[a:b])

        for k, part in self._parts(texts):
            if held and size + len(part) > self.slice_bytes:
                done()
                held, size = [], 0
            held.append((k, part))
            size += len(part)
        if held:
            done()
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]


def write_codes(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, shard_tokens: int = 1 << 18) -> None:
    """Write ids of every whole text, each document's followed by ``end_id``, in ascending doc_id
    order, as a table of shards at ``path``: part and seq (the order of shards), doc_ids (i64) and
    ends (u64, places after each document) as little-endian arrays, tokens, codes.

    A shard ends with the document that fills it. Tasks write through Spark's commit protocol, so
    a lost executor leaves no half shard. Null texts are empty; null ids come first; rows that
    share an id are ordered by text.
    """

    def run(batches):
        encoder, ids, ends, chunks, seq, total = WordEncoder.of_worker(tokenizer), [], [], [], 0, 0
        end = np.array([end_id], "<u4")

        def shard():
            # A null id travels as the smallest long, with a flag in its own array.
            null = np.array([i is None for i in ids], bool)
            known = np.array([0 if i is None else i for i in ids], "<i8")
            return pa.record_batch(
                [
                    pa.array([seq], pa.int32()),
                    pa.array([known.tobytes()], pa.binary()),
                    pa.array([null.tobytes()], pa.binary()),
                    pa.array([np.array(ends, "<u8").tobytes()], pa.binary()),
                    pa.array([total], pa.int64()),
                    pa.array([encode_codes(np.concatenate(chunks))], pa.binary()),
                ],
                names=["seq", "doc_ids", "null_ids", "ends", "tokens", "codes"],
            )

        def encoded(batches):
            """(id, token ids), a few MB of text at a time."""
            for batch in batches:
                some, size = [], 0
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    some.append((i, text.as_py() or b""))
                    size += len(some[-1][1])
                    if size >= 1 << 22:
                        yield from zip([i for i, _ in some], encoder.encode_all([t for _, t in some]))
                        some, size = [], 0
                yield from zip([i for i, _ in some], encoder.encode_all([t for _, t in some]))

        for i, tokens in encoded(batches):
            chunks += [tokens, end]
            total += len(tokens) + 1
            ids.append(i)
            ends.append(total)
            if total >= shard_tokens:
                yield shard()
                ids, ends, chunks, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(run, "seq int, doc_ids binary, null_ids binary, ends binary, tokens long, codes binary")
    # A shard is a large value: pages are cut by size after each, not after the usual hundred rows.
    shards.select(F.spark_partition_id().alias("part"), "*").write.mode("overwrite").option("parquet.page.size.row.check.min", "1").parquet(path)


def read_codes(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from a table of shards; each document is read by its
    place in the codes."""
    shards = spark.read.parquet(path)
    # Running sums: over the few rows that stand for parts, then inside each part.
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    part_start = parts.select(
        "part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "seq", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("within")).join(part_start, "part")
    starts = starts.select("part", "seq", (F.col("within") + F.col("before")).alias("at"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, ends = Codes(row["codes"]), np.frombuffer(row["ends"], "<u8").astype(np.int64)
                begins = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["null_ids"], bool)),
                        pa.array(begins + row["at"]),
                        pa.array(ends - begins),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = shards.join(starts, ["part", "seq"]).select("at", "doc_ids", "null_ids", "ends", "codes")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, ids: the token ids themselves."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, ends = Codes(row["codes"]), np.frombuffer(row["ends"], "<u8").astype(int).tolist()
                ids = np.frombuffer(row["doc_ids"], "<i8")
                mask = np.frombuffer(row["null_ids"], bool)
                lists = [codes.slice(a, b).astype(np.int64).tolist() for a, b in zip([0, *ends], ends)]
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=mask), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    shards = spark.read.parquet(path).select("doc_ids", "null_ids", "ends", "codes")
    return shards.mapInArrow(run, "doc_id long, ids array<long>")


def code_report(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as codes in the shared folder (or ``path``) and read them back.

    Empty texts give the end id alone; an empty table gives an empty result; other columns are
    ignored."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/token_codes_{uuid.uuid4().hex}"
    write_codes(docs, path, **options)
    return read_codes(spark, path)
