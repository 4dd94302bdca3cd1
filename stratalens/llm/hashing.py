"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A text is
never decoded or looped over word by word: byte masks give word bounds, and
each word is hashed eight bytes at a time, every step a bijective mix of what
came before. Words of up to eight bytes and equal length therefore never share
a hash. Windows of words are joined by doubling. Null texts count as empty.
All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# One seed and one odd multiplier per independent hash.
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_TIMES = (_U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
# Longer ranges of bytes are hashed one by one.
_STEPPED = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of the byte ranges data[start:end]; `kind` 0 and 1 are independent."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(mix(size.astype(_U) + _SEEDS[kind]) ^ (eight[start] & _MASKS[np.minimum(size, 8)]))
    live = np.flatnonzero((size > 8) & (size <= _STEPPED))
    done = 8
    while len(live):
        out[live] = mix(out[live] ^ eight[start[live] + done] & _MASKS[np.minimum(size[live] - done, 8)])
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > _STEPPED).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]], int(_SEEDS[kind]))
    return out


def _join(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Hash of what `a` stands for followed by what `b` stands for."""
    x = a * _TIMES[kind] + b
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def windows(words: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hash of each run of `size` consecutive values; len(words) - size + 1 of them."""
    n = len(words)
    if n < size:
        return np.zeros(0, _U)
    power, span, out, covered = words, 1, None, 0
    while True:
        if size & span:
            many = n - covered - span + 1
            out = power if out is None else _join(out[:many], power[covered : covered + many], kind)
            covered += span
        if covered == size:
            return out
        power = _join(power[: n - 2 * span + 1], power[span:], kind)
        span *= 2


class Words:
    """Word bounds and hashes of a block of texts.

    data: the bytes; start, end: bounds of each word in data; first: index of
    each document's first word, with the total at the end; bounds: byte bounds
    of the documents.
    """

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        texts = texts.fill_null("") if texts.null_count else texts
        self.data, self.bounds = text_bytes(texts)
        inside = ~_SPACE[self.data]
        n = len(inside)
        begin, stop = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            edges = self.bounds[:-1][self.bounds[:-1] < n]
            begin[edges] = inside[edges]
            last = self.bounds[1:] - 1
            last = last[last >= 0]
            stop[last] = inside[last]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.counts = np.diff(self.first)

    def hashes(self, kind: int = 0, lower: bool = False) -> np.ndarray:
        return byte_hash(_LOWER[self.data] if lower else self.data, self.start, self.end, kind)


def _offsets(col: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(1, np.int64)
    return np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the bounds of each text in them."""
    off = _offsets(col)
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with at most `limit` bytes of text.

    A single longer text forms a run of its own.
    """
    col = batch.column(batch.schema.get_field_index(text))
    if not len(col):
        return
    off = _offsets(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
