"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are the words and word pairs of a whole text, hashed into one vector
of fixed size. As classifiers of this kind have it, runs of punctuation are
words of their own, and a word that repeats the one before it becomes a ditto
mark. Weights are learnt from a bounded sample of labelled rows; scores are
sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import byte_hash, mix, slices, text_bytes, windows

BITS = 18
_U = np.uint64
_DITTO = _U(0x5D1770)
# Kinds of bytes: white space, letters and digits (and all beyond ASCII), punctuation.
_KIND = np.full(256, 2, np.uint8)
_KIND[128:] = 1
for _first, _last in ("az", "AZ", "09"):
    _KIND[ord(_first) : ord(_last) + 1] = 1
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and the bounds of each text's run."""
    data, bounds = text_bytes(texts.fill_null("") if texts.null_count else texts)
    kind = _KIND[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    edges = bounds[:-1]
    new[edges[edges < len(kind)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    words, first = byte_hash(data, start, end), np.searchsorted(start, bounds)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    starts = first[:-1]
    again[starts[starts < len(words)]] = False
    return np.where(again, _DITTO, words), first


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: feature indexes and their weights, a unit vector of dampened counts."""
    words, first = _words(texts)
    grams = [mix(words + _U(1)), windows(words, 2, 1)]
    for a, b in zip(first[:-1], first[1:], strict=True):
        own = np.concatenate([g[a : b - k] if b - a > k else g[:0] for k, g in enumerate(grams)])
        at, many = np.unique(own >> _U(64 - bits), return_counts=True)
        value = np.log1p(many)
        norm = np.sqrt((value**2).sum())
        yield at.astype(np.int64), value / norm if norm else value


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.set_column(2, "text", batch.column(2).fill_null("")), "text"):
                found = list(features(some.column(2), bits))
                at, value = [x.astype(np.int32).tobytes() for x, _ in found], [x.astype(np.float32).tobytes() for _, x in found]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "quality", "at", "value"])

    return run


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.1) -> np.ndarray:
    """Weights (the bias last) after passes of per-coordinate FTRL-proximal updates over (indexes, values, label)."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, size), np.append(value, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, bits: int = BITS) -> np.ndarray:
    """Weights from `labels(doc_id, quality)` joined to `docs(doc_id, text)`.

    At most `most_rows` labelled ids that have a document are used, those first
    by a hash of the doc_id; all of their texts are read whole, and of rows that
    repeat a doc_id one. Null labels and ids are left out and repeated labels of
    a doc_id count once, as the larger. Without labels all weights are zero.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).collect()
    # Bounded by most_rows, so it goes to every task instead of sending all texts to meet it.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in picked], known.schema))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text")
    found = rows.mapInArrow(_feature_rows(bits), "doc_id long, quality int, at binary, value binary").toArrow()
    order = {r["doc_id"]: i for i, r in enumerate(picked)}
    data = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32).astype(float), int(q), order[d]) for d, q, a, v in zip(*(found[c].to_pylist() for c in ("doc_id", "quality", "at", "value")), strict=True)]
    data.sort(key=lambda r: (r[3], r[0].tobytes(), r[1].tobytes()))
    once = {r[3]: r[:3] for r in reversed(data)}
    return ftrl([once[k] for k in sorted(once)], 1 << bits)


def _scorer(weights: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch.set_column(1, "text", batch.column(1).fill_null("")), "text"):
                raw = np.array([weights[at] @ value for at, value in features(some.column(1), bits)]) + weights[-1]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for each row of `docs(doc_id, text)`.

    Null and empty texts score the bias alone; null and repeated doc_ids are
    scored like others; an empty table gives no rows; extra columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(weights.astype(np.float64), bits), "doc_id long, score double")


def _keeper(weights: np.ndarray, cut: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for some in slices(batch.set_column(at, batch.schema.field(at), batch.column(at)), "text"):
                raw = np.array([weights[i] @ value for i, value in features(some.column(at), bits)]) + weights[-1]
                yield some.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -35, 35))) >= cut))

    return run


def keep(docs: DataFrame, weights: np.ndarray, cut: float = 0.7, bits: int = BITS) -> DataFrame:
    """The rows of `docs` that score `cut` or more, with all their columns; cases are as in score()."""
    return docs.mapInArrow(_keeper(weights.astype(np.float64), cut, bits), docs.schema)


def held_out(doc_id, parts: int = 4, part: int = 2):
    """Rows whose labels are never learnt from: crc32 of the id's text leaves `part`. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
