import math
import random
import zlib

from quillmesh.llm import langid as L

PARTS = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "tr", "eg"], "cc": ["é", "ñi", "ou"]}


def make(n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(PARTS))
        words = ["".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(words).capitalize() + ".", lang if rng.random() > 0.05 else None))
    return rows


def test_held_out_accuracy_and_contract(spark):
    rows = make() + [(None, "kalomi", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 ½ !!", "bb"), (903, "kalo " * 60000, None), (904, "ZUTR", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as w")
    model = L.train(docs)
    got = L.predict(docs, model).collect()
    assert len(got) == len(rows)
    at = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert at[i].lang_pred == "und"
    assert at[903].lang_pred == "aa" and at[904].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)
    held = [(at[i].lang_pred == lang) for i, _, lang in rows if lang and i is not None and i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(held) / len(held) > 0.97
    assert L.train(docs.limit(0)).langs == [] and L.predict(docs, L.train(docs.limit(0))).first().lang_pred == "und"
    assert L.predict(docs.limit(0), model).count() == 0


def test_backoff_by_hand():
    import numpy as np

    matrix = np.array([[0.0, -5.0], [-4.0, 0.0], [0.0, -9.0]])
    model = L.Model(["a", "b"], {"known": 0}, {"zz": 1, "z": 2}, matrix, np.log([0.5, 0.5]))
    assert next(L.classify(model, ["Known"]))[0] == "a"
    lang, score = next(L.classify(model, ["zzy"]))  # two letters known: one letter is not looked at
    assert lang == "b" and math.isclose(score, 1 / (1 + math.exp(-4.0)))
    assert next(L.classify(model, ["zy"]))[0] == "a"
    assert next(L.classify(model, ["qq"]))[1] == 0.5
    for text in ("z² q²", "zzy½", "²z"):  # letters beside numeric signs
        assert next(L.classify(model, [text]))[0] != "und"
    assert [f[0] for f in L.classify(model, ["²½ 12 _", None, ""])] == ["und"] * 3 and L.letters("ab²cd_É") == ["ab", "cd", "é"]
