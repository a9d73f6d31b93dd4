"""Language identification by words first, character n-grams for the rest.

A word that the training texts hold scores its per-language log frequency. An unseen word backs
off: its character n-grams of the greatest length of which any is known score their mean, from
``LONGEST`` letters down to one; a word of unknown letters says nothing.
"""

import re
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, id_bucket, settle, small_batches, worker_store

LONGEST = 5
WORDS = re.compile(r"[^\W\d_]+")


class Model:
    """langs; words and grams: {string: row of matrix}; matrix: log frequencies by language; prior:
    log shares."""

    def __init__(self, langs, words, grams, matrix, prior):
        self.langs, self.words, self.grams, self.matrix, self.prior = langs, words, grams, matrix, prior
        self.name = uuid.uuid4().hex  # of the rows that a worker keeps

    def vector(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return self.matrix[known]
        marked = f"<{word}>"
        for n in range(LONGEST, 0, -1):
            found = [g for k in range(len(marked) - n + 1) if (g := self.grams.get(marked[k : k + n])) is not None]
            if found:
                return self.matrix[found].mean(axis=0)
        return np.zeros(len(self.langs))


class _Rows(dict):
    """Row of each word in a growing matrix of score vectors."""

    def __init__(self, model: Model):
        self.model, self.matrix = model, np.empty((1024, len(model.langs)))

    def __missing__(self, word):
        n = len(self)
        if n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[n] = self.model.vector(word)
        self[word] = n
        return n


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case, as training takes them: signs such as a raised two divide."""
    words = WORDS.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return list(chain.from_iterable([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split() for w in words))


def classify(model: Model, texts, keep: int = 200_000, piece: int = 1 << 20):
    """(language or 'und', posterior) of each whole text; equal scores go to the first language. Score
    vectors of ``keep`` words or so stay with the worker."""
    store = worker_store().setdefault("langid", {})
    rows = store.get(model.name) or _Rows(model)
    for text in texts:
        words = letters(text)
        if not model.langs or not words:
            yield "und", 0.0
            continue
        total = model.prior.copy()
        for k in range(0, len(words), piece):
            part = words[k : k + piece]
            at = list(map(rows.__getitem__, part))
            total += rows.matrix[at].sum(axis=0)
        best = int(np.argmax(total))
        yield model.langs[best], float(1 / np.exp(total - total[best]).sum())
        if len(rows) > keep:
            rows = _Rows(model)
    store.clear()
    store[model.name] = rows


def train(docs: DataFrame, per_language: int = 2000, least: int = 3, split: int | None = 5, held: int = 0, smooth: float = 0.5) -> Model:
    """Fit on about ``per_language`` documents of each language, picked by hash of id, without those
    of crc32(id) mod ``split`` = ``held``. Words and n-grams are counted by Spark. Those met ``least``
    times or more are known; rarer words back off to n-grams, rarer n-grams to shorter ones."""
    usable = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    if split:
        usable = usable.where(id_bucket(F.col("doc_id"), split) != held)
    totals = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], {}, {}, np.zeros((0, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, per_language / totals[lang]))]), F.col("lang"))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) < share * 1_000_000)
    counted = settle(
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
    )
    marked = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
    pieces = F.flatten(
        F.transform(
            F.array(*[F.lit(n) for n in range(1, LONGEST + 1)]),
            lambda n: F.transform(
                F.filter(F.sequence(F.lit(1), F.length("w") + 2), lambda k: k + n - 1 <= F.length("w") + 2), lambda k: marked.substr(k, n)
            ),
        )
    )
    grams = counted.select("lang", "n", F.explode(pieces).alias("w")).groupBy("lang", "w").agg(F.sum("n").alias("n"))

    def wide(frame, kind):
        sums = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("double").alias(f"c{k}") for k, lang in enumerate(langs)]
        return frame.groupBy("w").agg(F.sum("n").alias("t"), *sums).where(F.col("t") >= least).select(F.lit(kind).alias("kind"), "w", *[f"c{k}" for k in range(len(langs))])

    def logs(counts, groups):
        out = np.empty_like(counts)
        for g in np.unique(groups):
            rows = groups == g
            sums = counts[rows].sum(axis=0)
            out[rows] = np.log((counts[rows] + smooth) / (sums + smooth * rows.sum()))
        # Only differences between languages matter.
        return out - out.max(axis=1, keepdims=True) if len(out) else out

    n = np.array([totals[lang] for lang in langs], float)

    def learn(table):
        kind, names = table.column("kind").to_numpy(), np.array(table.column("w").to_pylist(), object)
        counts = np.stack([table.column(f"c{k}").to_numpy() for k in range(len(langs))], 1).reshape(-1, len(langs))
        order = np.lexsort((names, kind)) if len(names) else np.empty(0, np.int64)
        kind, names, counts = kind[order], names[order].tolist(), counts[order]
        words = int((kind == 0).sum())
        matrix = logs(counts, np.array([0 if k == 0 else len(w) for k, w in zip(kind, names)], int))
        return Model(langs, dict(zip(names[:words], range(words))), dict(zip(names[words:], range(words, len(names)))), matrix, np.log(n / n.sum()))

    return fit_in_task(wide(counted, 0).unionByName(wide(grams, 1)), learn)


def predict(docs: DataFrame, model: Model, split: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the posterior; 0 for 'und').

    Null texts and texts without a letter are 'und'; texts of any length are read whole. One row per
    row of ``docs``; other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        for batch in batches:
            found = list(classify(sent.value, (t.as_py() for t in batch.column(2))))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (id_bucket(F.col("doc_id"), split) == held).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
