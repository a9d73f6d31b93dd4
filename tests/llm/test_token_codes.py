import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillmesh.llm import token_codes as T


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 31, n) >> rng.integers(0, 31, n)).astype(np.uint64)
        codes = T.Codes(T.encode_codes(ids))
        assert len(codes) == n and (codes.slice(0, n) == ids).all()
        for _ in range(40):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (codes.slice(a, b) == ids[a:b]).all()
        for i in rng.integers(0, n, 40).tolist() if n else []:
            assert codes[i] == ids[i]


TEXTS = ["Hello WORLD's é", None, "", " \n\t ", "a b　c", "<|endoftext|>x <|startoftext|>", "don't we'll 12 3½ é ́a", "😀😀 漢字かな", "İstanbul ΣΑΣ ß", "x" * 3000, "it 's"]


def test_words_encode_as_texts():
    encoder = T.WordEncoder(None, slice_bytes=40, store_bytes=2000)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for t in TEXTS:
        want = whole.encode(t or "", add_special_tokens=False).ids
        assert encoder.encode((t or "").encode()).tolist() == want, t
    many = encoder.encode_all([(t or "").encode() for t in TEXTS * 3])
    assert [x.tolist() for x in many] == [whole.encode(t or "", add_special_tokens=False).ids for t in TEXTS * 3]
    rng = random.Random(3)
    for _ in range(300):
        t = "".join(rng.choice("abéßİǅ 漢가ᄀ́'’.,!?% 12½<|endoftext|>s\n") for _ in range(rng.randrange(40)))
        assert encoder.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_report(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-50, 400), t) for t in TEXTS * 9] + [(None, "no id"), (5, "same"), (5, "same"), (5, "other"), (900, "many words " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as codes").repartition(5)
    got = T.code_report(docs, shard_tokens=64).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, at = [], 0
    for i, t in order:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    assert T.code_report(docs.limit(0)).count() == 0
