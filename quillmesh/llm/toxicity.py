"""Toxicity by a weighted finite-state pattern grammar.

A clause is read by a cascade of transducers, each a table of arcs (state, symbol) to (symbol, state):

* insult: the lexicon, which turns words into symbols; insults come from a learned list of words and
  open stems, with weights, the other classes from short fixed lists;
* threat: a threat word becomes a direct, a near or a loose threat, as a target follows;
* target: insults of a clause that names a target are targeted;
* negation: what a negation stands a few words before or after is negated;
* reported speech: what stands in a clause that reports speech is reported.

What depends on words still to come is guessed, one path for each guess, and a wrong guess dies, so a
clause has exactly one accepting path. The machines are composed by the product of their states. An
output symbol such as ``direct/negated`` is an arc of the grammar with a learned weight; a clause is
worth the weights of the arcs on its path, an insult's times its lexical weight, and a document's
score is the logistic of what its clauses add up to.
"""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fit_in_task, id_bucket, small_batches

# Closed classes of the grammar in English, German, French and Spanish.
TARGET = frozenset("you your yours u he him she her they them du dich dir dein ihr euch tu toi ton vous votre usted ustedes tú ti".split())
NEGATION = frozenset("not never no neither nor nicht kein keine nie ne pas jamais nunca jamás ni tampoco".split())
REPORT = frozenset("said says say claimed claims wrote quoted called sagte sagt schrieb dit disait écrit dijo dice escribió".split())
THREAT = frozenset("kill hurt destroy beat stab shoot töten schlagen umbringen tuer frapper détruire matar golpear destruir".split())
REACH = 3  # words that a negation reaches, and within which a threat's target is near

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
STOPS = frozenset(".!?;\n")
SYMBOLS = ("insult", "threat", "target", "negation", "report", "other")
MARKS = ("plain", "targeted", "direct", "near", "loose")
#: Output symbols, and what an arc is worth before anything is learned.
KINDS = tuple("/".join((m, *n, *r)) for m, n, r in product(MARKS, ((), ("negated",)), ((), ("reported",))))
PRIOR = np.array([{"plain": 1.0, "targeted": 1.2, "direct": 1.0, "near": 0.5, "loose": 0.0}[k.split("/")[0]] * 0.5 ** k.count("/") for k in KINDS])


AT = {k: n for n, k in enumerate(KINDS)}


class Transducer:
    """Arcs made on demand: ``arcs(state, symbol)`` gives [(symbol, state)], none where a path dies."""

    def __init__(self, starts, arcs, final):
        self.starts, self.arcs, self.final = starts, arcs, final

    def __rshift__(self, other: "Transducer") -> "Transducer":
        """The composition: what this one writes, the other reads."""
        known: dict = {}

        def arcs(state, symbol):
            found = known.get((state, symbol))
            if found is None:
                (p, q), found = state, []
                for middle, p_next in self.arcs(p, symbol):
                    found += [(out, (p_next, q_next)) for out, q_next in other.arcs(q, middle)]
                known[state, symbol] = found
            return found

        return Transducer([(p, q) for p in self.starts for q in other.starts], arcs, lambda state: self.final(state[0]) and other.final(state[1]))

    def paths(self, symbols) -> list[list[str]]:
        """What the accepting paths write."""
        front = [(state, ()) for state in self.starts]
        for symbol in symbols:
            front = [(after, (wrote, out)) for state, wrote in front for out, after in self.arcs(state, symbol)]
        found = []
        for state, wrote in front:
            if self.final(state):
                out = []
                while wrote:
                    wrote, symbol = wrote
                    out.append(symbol)
                found.append(out[::-1])
        return found


def foresight(cue: str, options: dict, back: int = 0, behind: str = "") -> Transducer:
    """Marks by when ``cue`` follows. options: symbol to [(output, must, ban)]: the cue has to come
    within ``must`` words (0: need not) and not within the next ``ban``. A symbol that the cue stands
    up to ``back`` words before gets ``behind`` at its end, without a guess. States: words that the
    last cue still reaches, words within which one must come, words in which none may."""

    def arcs(state, symbol):
        reach, must, ban = state
        if symbol == cue:
            return [] if ban else [(symbol, (back, 0, 0))]
        if must == 1:
            return []
        reach_next, must, ban = max(0, reach - 1), max(0, must - 1), max(0, ban - 1)
        if symbol not in options:
            return [(symbol, (reach_next, must, ban))]
        if reach:
            return [(symbol + behind, (reach_next, must, ban))]
        return [(out, (reach_next, min(m for m in (must, new) if m) if must or new else 0, max(ban, none))) for out, new, none in options[symbol]]

    return Transducer([(0, 0, 0)], arcs, lambda state: not state[1])


def anywhere(cue: str, options: dict) -> Transducer:
    """options: symbol to (output in a clause without ``cue``, output in one with it)."""

    def arcs(state, symbol):
        if symbol == cue:
            return [] if state == "absent" else [(symbol, "seen")]
        return [(options[symbol][state != "absent"] if symbol in options else symbol, state)]

    return Transducer(["absent", "awaited"], arcs, lambda state: state != "awaited")


def clause_grammar() -> Transducer:
    """threat, target, negation and report, composed; the lexicon feeds it."""
    threat = foresight("target", {"threat": [("direct", 1, 0), ("near", REACH, 1), ("loose", 0, REACH)]})
    target = anywhere("target", {"insult": ("plain", "targeted")})
    negation = foresight("negation", {m: [(m + "/negated", REACH, 0), (m, 0, REACH)] for m in MARKS}, REACH, "/negated")
    report = anywhere("report", {m + n: (m + n, m + n + "/reported") for m in MARKS for n in ("", "/negated")})
    return threat >> target >> negation >> report


class Grammar:
    """words: weight by whole word; stems: weight by the beginning of a word; arcs: weight by kind."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], arcs=PRIOR, bias: float = -2.0):
        self.words, self.stems, self.arcs, self.bias = words, stems, np.asarray(arcs, float), bias
        self.lengths = sorted({len(s) for s in stems})
        self.machine = None

    def __getstate__(self):
        return self.__dict__ | {"machine": None}  # made where it runs

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            weight = max(weight, self.stems.get(word[:n], 0.0))
        return weight

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexicon's arc: symbol and weight. An insult is an insult whatever else it is."""
        weight = self.insult(word)
        if weight:
            return "insult", weight
        for name, words in (("threat", THREAT), ("target", TARGET), ("negation", NEGATION), ("report", REPORT)):
            if word in words:
                return name, 1.0
        return "other", 0.0

    def clause(self, words: list[str], out: np.ndarray) -> None:
        """Add the output weights of one clause by kind."""
        if self.machine is None:
            self.machine = clause_grammar()
        read = [self.symbol(w) for w in words]
        (wrote,) = self.machine.paths([s for s, _ in read])
        for kind, (symbol, weight) in zip(wrote, read):
            if symbol in ("insult", "threat"):
                out[AT[kind]] += weight

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(KINDS))
        tokens = TOKEN.findall((text or "").lower())
        if not tokens:
            return out
        words, stems, lengths = self.words, self.stems, self.lengths
        hits = {k for k, w in enumerate(tokens) if w in words or w in THREAT}
        for n in lengths:
            hits.update(k for k, w in enumerate(tokens) if w[:n] in stems)
        done = -1
        for k in sorted(hits):
            if k <= done:
                continue
            a = b = k
            while a and tokens[a - 1] not in STOPS:
                a -= 1
            while b < len(tokens) and tokens[b] not in STOPS:
                b += 1
            self.clause(tokens[a:b], out)
            done = b
        return out

    def score(self, features: np.ndarray) -> float:
        x = self.bias + float(self.arcs @ np.log1p(features))
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Without exact and most near copies, by the smallest and the largest hash of word 5-grams."""
    low, high, kept = set(), set(), []
    for text, label in rows:
        words = text.split()
        grams = {zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(max(1, len(words) - 4))}
        a, b = min(grams), max(grams)
        if a not in low and b not in high:
            kept.append((text, label))
        low.add(a)
        high.add(b)
    return kept


def learn(rows: list[tuple[str, int]], least: int = 4, precision: float = 0.8, forms: int = 3) -> Grammar:
    """Insult words: in ``least`` toxic texts or more and with ``precision``. Stems: of four letters
    or more, with ``forms`` different forms; the shortest that is as precise stands for the rest.
    Arc weights: logistic regression with a Gaussian prior around ``PRIOR``."""
    rows = sorted(distinct_texts([(t or "", int(y)) for t, y in rows]))
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in rows:
        seen[label].update(set(TOKEN.findall(text.lower())) - STOPS)
    toxic = sum(y for _, y in rows)
    clean = len(rows) - toxic

    def weight(t: float, c: float) -> float:
        return math.log((t + 0.5) / (toxic + 1) / ((c + 0.5) / (clean + 1)))

    words = {w: weight(t, seen[0][w]) for w, t in seen[1].items() if t >= least and t >= precision * (t + seen[0][w])}
    words = {w: x for w, x in words.items() if x > 2}
    # Stems are sought among beginnings of words that toxic texts alone hold.
    common, forms_of = Counter(), Counter()
    for w, n in seen[1].items():
        if w not in seen[0]:
            for k in range(4, min(len(w), 12) + 1):
                common[w[:k]] += n
                forms_of[w[:k]] += 1
    likely = {p for p, n in common.items() if n >= 3 * least and forms_of[p] >= forms}
    at: dict[str, list[float]] = defaultdict(lambda: [0, 0, 0])
    for label in (0, 1):
        for w, n in seen[label].items():
            for k in range(4, min(len(w), 12) + 1):
                if w[:k] in likely:
                    entry = at[w[:k]]
                    entry[label] += n
                    entry[2] += label
    good = {p for p, (c, t, f) in at.items() if f >= forms and t >= 3 * least and t >= max(precision, 0.9) * (t + c)}
    stems = {p: weight(at[p][1], at[p][0]) for p in good if p[:-1] not in good}
    grammar = Grammar(words, stems)
    if not rows:
        return grammar
    x = np.log1p(np.array([grammar.features(t) for t, _ in rows]))
    y = np.array([label for _, label in rows], float)
    theta = np.r_[-2.0, PRIOR]
    mean, pull = theta.copy(), np.r_[0.05, np.full(len(KINDS), 2.0)]
    full = np.c_[np.ones(len(x)), x]
    for _ in range(60):  # damped Newton steps on a convex loss
        p = 0.5 * (1 + np.tanh(0.5 * (full @ theta)))
        gradient = full.T @ (p - y) + pull * (theta - mean)
        hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        theta -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    grammar.bias, grammar.arcs = float(theta[0]), np.maximum(theta[1:], 0.0)
    return grammar


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_bytes: int = 96 << 20, split: int | None = 3, held: int = 1) -> Grammar:
    """Fit on at most ``max_rows`` labelled rows and ``max_bytes`` of text, those of the smallest hash of
    id, without those of crc32(id) mod ``split`` = ``held``. An id with contrary labels counts as
    toxic; rows that share an id and differ in text each count."""
    usable = labels.where("doc_id is not null and toxic is not null")
    if split:
        usable = usable.where(id_bucket(F.col("doc_id"), split) != held)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(max_rows)
    # Bounded by max_rows, so safe to send to every task.
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sample = bounded_sample(rows.select("doc_id", "text", "toxic"), max_rows, max_bytes, 42)
    return fit_in_task(sample.select("text", "toxic"), lambda t: learn(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))))


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, split: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted and the clause weights of each kind.

    Null and empty texts get the score of a text without matches; a text of any length is read
    whole, clause by clause. One row per row of ``docs``; other columns are ignored."""

    names = [k.replace("/", "_") for k in KINDS]

    def run(batches):
        for batch in batches:
            x = [grammar.features(t.as_py()) for t in batch.column(2)]
            scores = [grammar.score(f) for f in x]
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    *[pa.array([float(f[k]) for f in x], pa.float64()) for k in range(len(KINDS))],
                ],
                names=["doc_id", "held_out", "score", "predicted", *names],
            )

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", (id_bucket(F.col("doc_id"), split) == held).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, " + ", ".join(f"{k} double" for k in names))


def drop_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.7) -> DataFrame:
    """The rows and columns of ``docs`` that score below the threshold."""
    from pyspark.sql.functions import pandas_udf

    small_batches(docs.sparkSession)

    @pandas_udf("boolean")
    def toxic(texts):
        return texts.map(lambda t: grammar.score(grammar.features(t)) >= threshold)

    return docs.where(~toxic(F.coalesce("text", F.lit(""))))
