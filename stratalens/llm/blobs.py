"""Moving packed arrays of fingerprints between groups of documents and hash buckets.

Documents are dealt into groups by a hash of their content. A group sends each
bucket one binary row holding what it has of that bucket, already reduced to
one entry per fingerprint, so a fingerprint that a third of all documents
share arrives once per group and not once per document. Buckets answer the
same way, and the group meets its documents again through the same exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, slices

_U = np.uint64


def dealt(docs: DataFrame, groups: int) -> DataFrame:
    """`docs` with a column pid, laid out by it."""
    return docs.withColumn("pid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(groups, "pid")


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash; never decreasing in the hash."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def cuts(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in sorted hashes, and the bounds of their runs."""
    b = bucket_of(sorted_hashes, buckets)
    new = np.flatnonzero(np.diff(b)) + 1
    bounds = np.concatenate([[0], new, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    return b[bounds[:-1]], bounds


_KINDS = [np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i8", "f4", "f8")]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays and their types to bytes."""
    head = [len(arrays), *(len(a) << 4 | _KINDS.index(a.dtype) for a in arrays)]
    return np.array(head, np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes) -> list[np.ndarray]:
    """What pack() was given."""
    many = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8 * (many + 1), []
    for code in np.frombuffer(blob, np.int64, many, 8).tolist():
        out.append(np.frombuffer(blob, _KINDS[code & 15], code >> 4, at))
        at += out[-1].nbytes
    return out


def narrow(codes: np.ndarray, below: int) -> np.ndarray:
    """Numbers under `below` in the smallest of the types for them."""
    return codes.astype(np.uint8 if below <= 1 << 8 else np.uint16 if below <= 1 << 16 else np.uint32)


def rows(schema: dict[str, pa.DataType], **columns) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in schema.items()})


def hashed(texts: pa.ChunkedArray, lower: bool = False, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts, and the bounds of each text's run; scratch memory of a slice at a time."""
    parts, counts = [], []
    batch_of = pa.table({"t": texts}).to_batches()
    for batch in batch_of:
        for piece in slices(batch, "t"):
            words = Words(piece.column(0))
            parts.append(words.hashes(kind, lower))
            counts.append(words.counts)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(n)])


def runs(*sorted_values: np.ndarray) -> np.ndarray:
    """First index of each run of rows equal in all arrays."""
    if not len(sorted_values[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_values])]))


def ordered(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of numbers in their order, and the pairs (high above low, 32 bits each) so ordered.

    Pairs and positions are sorted as one number where they fit: plain sorts
    are many times faster than those that return positions.
    """
    above, below, place = (int(x).bit_length() for x in (high.max(initial=0), low.max(initial=0), max(len(high) - 1, 0)))
    if above + below + place > 64:
        pair = (high.astype(np.int64) << 32) | low
        at = np.argsort(pair, kind="stable")
        return at, pair[at]
    key = (high.astype(_U) << _U(below + place)) | (low.astype(_U) << _U(place)) | np.arange(len(high), dtype=_U)
    key.sort()
    at = (key & _U((1 << place) - 1)).astype(np.int64)
    key >>= _U(place)
    return at, (((key >> _U(below)) << _U(32)) | (key & _U((1 << below) - 1))).astype(np.int64)


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(hashes, return_inverse=True), sorting upper bits and positions as one number."""
    mask = _U((1 << max(len(hashes) - 1, 0).bit_length()) - 1)
    key = (hashes & ~mask) | np.arange(len(hashes), dtype=_U)
    key.sort()
    at = (key & mask).astype(np.int64)
    found = hashes[at]
    if (found[1:] < found[:-1]).any():  # different hashes have the same upper bits
        return np.unique(hashes, return_inverse=True)
    start = runs(found)
    code = np.empty(len(at), np.int64)
    code[at] = np.repeat(np.arange(len(start)), run_lengths(start, len(at)))
    return found[start], code


def numbered_within(part: np.ndarray, value: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each part one after another, the parts' bounds among them, and each value's place in its part."""
    at, pair = ordered(part, value)
    start = runs(pair)
    code = np.empty(len(at), np.int64)
    code[at] = np.repeat(np.arange(len(start)), run_lengths(start, len(at)))
    bounds = np.searchsorted(pair[start], np.arange(parts + 1) << 32)
    return pair[start] & 0xFFFFFFFF, bounds, code - bounds[part]


def run_lengths(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.concatenate([starts, [total]]))
