import random

import numpy as np

from quillmesh.llm import toxicity as X


def make(n=400, seed=1):
    rng = random.Random(seed)
    base = [f"{a}{b}" for a in ("an", "be", "co", "du", "el") for b in ("ra", "to", "mi", "su")]
    rows = []
    for i in range(n):
        words = [rng.choice(base) + rng.choice(base) for _ in range(rng.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilgron", "snarkel", "gromp" + rng.choice(["a", "o", "is", "ent", "ul", "ix"])]))
        rows.append((" ".join(words) + ".", int(toxic)))
    return rows


def test_learns_words_and_stems():
    grammar = X.learn(make() + [("a very hot copy of vilgron text here", 1)] * 300)
    assert "vilgron" in grammar.words and "snarkel" in grammar.words and "hot" not in grammar.words
    assert any("gromp".startswith(s) or s == "gromp" for s in grammar.stems)
    fresh = make(200, 9)
    hits = [(grammar.score(grammar.features(t)) >= 0.7) == bool(y) for t, y in fresh]
    assert np.mean(hits) > 0.97
    assert grammar.score(grammar.features("anra grompzzz")) >= 0.7  # a form never seen


def test_clauses():
    g = X.Grammar({"idiot": 3.0}, {"grom": 2.0})
    f = lambda t: {k: v for k, v in zip(X.KINDS, g.features(t)) if v}
    assert f("what an idiot") == {"plain": 3}
    assert f("you are an idiot") == f("an idiot you are") == {"targeted": 3}
    assert f("he is not an idiot") == f("idiot he is not") == {"targeted/negated": 3}
    assert f("not once in all these years an idiot") == {"plain": 3}
    assert f("she said the idiot left") == f("the idiot left she said") == {"targeted/reported": 3}
    assert f("I will kill you") == {"direct": 1} and f("kill all of you") == {"near": 1} and f("to kill time") == f("they kill time") == {"loose": 1}
    assert f("I will not kill you") == {"direct/negated": 1} and f("he said kill you") == {"direct/reported": 1}
    assert f("He said so. An idiot.") == {"plain": 3}
    assert f("GROMMET idiot\nidiot") == {"plain": 8}
    assert f("idiot kill you") == {"targeted": 3, "direct": 1}
    assert f("") == {} and not g.features(None).any()
    same = [g.score(g.features(t)) for t in ("you idiot", "an idiot", "not an idiot")]
    assert same == sorted(same, reverse=True)


def naive(symbols):
    """What a clause writes, from the places of its words."""
    n, out = len(symbols), []
    for k, s in enumerate(symbols):
        if s == "threat":
            ahead = [j - k for j in range(k + 1, min(n, k + 4)) if symbols[j] == "target"]
            s = "loose" if not ahead else "direct" if ahead[0] == 1 else "near"
        elif s == "insult":
            s = "targeted" if "target" in symbols else "plain"
        else:
            out.append(s)
            continue
        s += "/negated" if any(symbols[j] == "negation" for j in range(max(0, k - 3), min(n, k + 4))) else ""
        out.append(s + ("/reported" if "report" in symbols else ""))
    return out


def enumerated(machines, symbols):
    """All paths of the cascade, machine by machine."""
    texts = [list(symbols)]
    for m in machines:
        after = []
        for text in texts:
            paths = [(s, []) for s in m.starts]
            for symbol in text:
                paths = [(q, [*w, out]) for s, w in paths for out, q in m.arcs(s, symbol)]
            after += [w for s, w in paths if m.final(s)]
        texts = after
    return texts


def test_composition_against_path_enumeration():
    rng, grammar = random.Random(5), X.clause_grammar()
    parts = []

    class Recorded(X.Transducer):
        def __rshift__(self, other):
            parts.append(other)
            return self

    first, made = X.foresight, []
    X.foresight = lambda *a: made.append(Recorded(*(lambda t: (t.starts, t.arcs, t.final))(first(*a)))) or made[-1]
    try:
        X.clause_grammar()
    finally:
        X.foresight = first
    machines = [made[0], *parts]
    assert len(machines) == 4
    for _ in range(1500):
        symbols = [rng.choice(X.SYMBOLS) for _ in range(rng.randrange(0, 9))]
        assert grammar.paths(symbols) == enumerated(machines, symbols) == [naive(symbols)], symbols


def test_spark(spark):
    rows = [(i, t, "en") for i, (t, _) in enumerate(make())] + [(None, "vilgron", None), (900, None, None), (901, "", "en"), (902, "anra " * 50000 + "vilgron snarkel", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    labels = spark.createDataFrame([(i, y, 1) for i, (_, y) in enumerate(make())] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    grammar = X.train(docs, labels)
    got = X.score_documents(docs, grammar).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    at = {r.doc_id: r for r in got}
    assert at[902].predicted == 1 and at[900].score == at[901].score < 0.7 and at[None].predicted == 1
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in at.items() if i is not None)
    again = X.train(docs.unionByName(docs.where("doc_id = 3").withColumn("text", X.F.lit("same id, other text"))).repartition(7), labels)
    assert again.words == X.train(docs.unionByName(docs.where("doc_id = 3").withColumn("text", X.F.lit("same id, other text"))), labels).words
    left = X.drop_toxic(docs, grammar)
    assert left.columns == docs.columns and left.count() == sum(1 - r.predicted for r in got)
    nobody = X.train(docs, labels.limit(0))
    assert {r.predicted for r in X.score_documents(docs, nobody).collect()} == {0}
    assert X.score_documents(docs.limit(0), grammar).count() == 0
