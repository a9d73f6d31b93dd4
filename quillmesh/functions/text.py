"""Text scoring: everything but the sequence ratio is a column expression."""

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

TEXT_KEYS = ("name", "text", "file", "language", "path", "kind")


def normalize(column):
    """Lower case, white space collapsed. Full case folding needs ``normalize_exact``."""
    return F.trim(F.regexp_replace(F.lower(column), r"\s+", " "))


@pandas_udf(T.StringType())
def normalize_exact(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(v.casefold().split()))


def tokens(column):
    """Distinct runs of a-z, 0-9 and _."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9_]+"), F.lit(0)))


def search_text(columns):
    """Id, type and the text-like metadata that are not blank."""
    parts = [F.col("id"), F.col("type")]
    parts += [F.when(F.trim(F.col(k)) != "", F.col(k)) for k in TEXT_KEYS if k in columns]
    return normalize(F.concat_ws(" ", *parts))


def overlap(query, have):
    """Share of the query's tokens that are there."""
    return F.size(F.array_intersect(query, have)) / F.greatest(F.size(query), F.lit(1))


def contained(part, whole):
    return F.size(F.array_except(part, whole)) == 0


def token_score(query, have):
    """Overlap; 0.85 at least when either set lies inside the other."""

    def score(s):
        share = s["common"] / F.greatest(F.size(query), F.lit(1))
        inside = (s["common"] == F.size(query)) | (s["common"] == s["n"])
        return F.when((F.size(query) > 0) & (s["n"] > 0), F.when(inside, F.greatest(share, F.lit(0.85))).otherwise(share)).otherwise(F.lit(0.0))

    # Lambdas hold ``have``, and what is counted of it, once: the optimizer would write out its expression at each use.
    counted = F.transform(F.array(have), lambda t: F.struct(F.size(F.array_intersect(query, t)).alias("common"), F.size(t).alias("n")))
    return F.transform(counted, score)[0]


def substring_score(query, text, name, node_id):
    name = F.coalesce(name, F.lit(""))
    forward = F.contains(text, query) | ((name != "") & F.contains(name, query)) | F.contains(node_id, query)
    backward = (text != "") & (F.contains(query, text) | ((name != "") & F.contains(query, name)))
    return F.when(forward, F.lit(0.9)).when(backward, F.lit(0.8)).otherwise(F.lit(0.0))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


NEAR = 0.8  # fixed: least ratio of a near-miss token


def _most(a: str, b: str) -> float:
    """What the ratio cannot exceed, by the lengths alone."""
    return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a and b else 0.0


def _shared(counts: dict[str, int], size: int, other: str) -> float:
    """What the ratio cannot exceed, by the characters that both hold; ``counts`` and ``size`` are one's."""
    return 2.0 * sum([min(n, other.count(c)) for c, n in counts.items()]) / (size + len(other)) if size and other else 0.0


def _best(query: str, counts: dict[str, int], others, best: float = 0.0) -> float:
    for other in others:
        if _most(query, other) > best and _shared(counts, len(query), other) > best:
            best = max(best, ratio(query, other))
    return best


def ratio_scores(query: str):
    """Best sequence ratio of ``query`` against text, name and id, and of near-miss tokens. Ratios that
    lengths or characters rule out are not computed, those of a token or a name once a batch."""
    asked = {word: Counter(word) for word in sorted(set(_words(query)))}
    counts = Counter(query)

    @pandas_udf("double")
    def score(text: pd.Series, name: pd.Series, node_id: pd.Series) -> pd.Series:
        near: dict[str, float] = {}
        named: dict[str, float] = {}

        def nearness(token):
            if token not in near:
                like = (a for a, held in asked.items() if _most(a, token) >= NEAR and _shared(held, len(a), token) >= NEAR)
                near[token] = max((ratio(a, token) for a in like), default=0.0)
            return near[token]

        out = []
        for t, n, i in zip(text, name, node_id):
            n = n or ""
            if n not in named:
                named[n] = ratio(query, n)
            best = _best(query, counts, (t or "", i or ""), named[n])
            close = max(map(nearness, _words(t or "")), default=0.0)
            out.append(max(best, close * 0.95 if close >= NEAR else 0.0))
        return pd.Series(out, dtype="float64")

    return score


def _words(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9_]+", text.lower())


def fuzzy_score(query: str, columns):
    """Score of nodes (id, type, name, ...) in [0, 1]: 1 for the id or name itself, else the best of
    ratios, tokens and substrings."""
    asked = " ".join(query.casefold().split())
    if not asked:
        return F.lit(0.0)
    q = F.lit(asked)
    text, name, node_id = search_text(columns), normalize(F.coalesce("name", F.lit(""))), normalize(F.col("id"))
    parts = F.greatest(
        ratio_scores(asked)(text, name, node_id),
        token_score(tokens(q), tokens(text)),
        substring_score(q, text, name, node_id),
    )
    return F.when((node_id == q) | ((name != "") & (name == q)), F.lit(1.0)).otherwise(parts)


def chunk_score(query: str, columns):
    """Node score, or the body's: ratio, overlap, or 0.85 when the body holds every query token."""
    asked = " ".join(query.casefold().split())
    body, q = normalize("chunk_text"), F.lit(asked)

    @pandas_udf("double")
    def body_ratio(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ratio(asked, t or ""))

    have, want = tokens(body), tokens(q)
    share = F.when(F.size(want) > 0, overlap(want, have)).otherwise(0.0)
    whole = F.when((F.size(want) > 0) & contained(want, have), F.lit(0.85)).otherwise(0.0)
    return F.greatest(fuzzy_score(query, columns), body_ratio(body), share, whole)


def cosine(a, b):
    """In doubles, clamped to [0, 1]; 0 for empty, unequal or zero vectors."""
    zero = F.lit(0.0)
    double = lambda v: v.cast("array<double>")
    dot = F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), zero, lambda s, x: s + x)
    norm = lambda v: F.aggregate(double(v), zero, lambda s, x: s + x * x)
    na, nb = norm(a), norm(b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, F.greatest(zero, F.least(F.lit(1.0), dot / (F.sqrt(na) * F.sqrt(nb))))).otherwise(zero)
