"""Similarity and distance measures of value pairs, as columns where Spark has them and in Python where not."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Over distinct white-space tokens."""
    x, y = (F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def equality(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)


def lcs_length(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def lcs_similarity_of(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return lcs_length(a, b) / longest if longest else 1.0


#: Scores of a local alignment: match, mismatch, gap.
ALIGN = (1.0, -2.0, -0.5)


def alignment_similarity(a: str, b: str) -> float:
    """Best local alignment with linear gaps, over the shorter length."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    match, miss, gap = ALIGN
    best, above = 0.0, [0.0] * (len(b) + 1)
    for x in a:
        row = [0.0]
        for j, y in enumerate(b, 1):
            row.append(max(0.0, above[j - 1] + (match if x == y else miss), above[j] + gap, row[-1] + gap))
        best = max(best, max(row))
        above = row
    return best / min(len(a), len(b))


def monge_elkan_of(a: str, b: str) -> float:
    """Geometric mean over both directions of each token's best alignment."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 1.0 if x == y else 0.0
    one = sum(max(alignment_similarity(s, t) for t in y) for s in x) / len(x)
    two = sum(max(alignment_similarity(s, t) for s in x) for t in y) / len(y)
    return (one * two) ** 0.5


def qgram_cosine_distance(a: str, b: str, q: int = 2) -> float:
    x, y = (Counter(s[i : i + q] for i in range(max(1, len(s) - q + 1))) for s in (a, b))
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return 1 - sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def pairwise(function: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A Python function of two strings as a vectorised column function; each distinct pair of a batch is computed once."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else float(function(*pair))
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


def number_distance(a: Column, b: Column) -> Column:
    return F.abs(a.cast("double") - b.cast("double"))


def date_distance(a: Column, b: Column) -> Column:
    """In whole days."""
    return F.abs(F.datediff(a, b)).cast("double")


MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "levenshtein": levenshtein_similarity, "jaccard": jaccard, "equality": equality,
}


def measure(name: str | Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A similarity by name, or a Python function of two strings."""
    if callable(name):
        return pairwise(name)
    if name in MEASURES:
        return MEASURES[name]
    python = {"lcs": lcs_similarity_of, "monge_elkan": monge_elkan_of}
    if name not in python:
        from ..plans.options import ConfigError

        raise ConfigError(f"no similarity measure {name}")
    return pairwise(python[name])
