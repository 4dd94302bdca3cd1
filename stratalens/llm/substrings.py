"""Removal of word passages that an earlier document also has.

Fixed-block anchors: every document is cut into non-overlapping blocks of half
a window, which form the index; every rolling window of that length probes it.
Any window shared by two documents holds a whole block of each, so blocks that
turn up elsewhere are hits, and extending hits by every full window around
them, confirmed by fingerprint against the smallest document that has it,
yields exactly the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import bucket_of, cuts, dealt, hashed, pack, run_lengths, rows, runs, unpack
from .hashing import windows
from .storage import width

_U, _LOW = np.uint64, np.uint64(0xFFFFFFFF)
_NONE = np.iinfo(np.int64).max
_SENT = {"bucket": pa.int32(), "pid": pa.int32(), "blob": pa.binary()}
_SENT_DDL = "bucket int, pid int, blob binary"
_OWN_PID = "pid of the input"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _rolling(texts: pa.ChunkedArray, size: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows inside documents, their word positions and owners, and the documents' bounds."""
    words, first = hashed(texts, kind=kind)
    all_windows = windows(words, size, kind)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(all_windows)]
    inside = np.arange(len(all_windows)) + size <= first[owner + 1]
    at = np.flatnonzero(inside)
    return all_windows[at], at, owner[at], first


def _second(texts: pa.ChunkedArray, size: int, first: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Independent hashes of the windows at word positions `at`; only documents that have any are hashed again."""
    some = np.unique(owner)
    words, own = hashed(texts.take(pa.array(some)), kind=1)
    spot = np.searchsorted(some, owner)
    return windows(words, size, 1)[at - first[owner] + own[spot]] if len(at) else np.zeros(0, _U)


def _probes(block: int, buckets: int):
    """Each group's rolling windows by bucket: 32 bits each, with two flags."""

    def run(table: pa.Table) -> pa.Table:
        h, at, owner, first = _rolling(table["text"], block, 0)
        order = np.argsort(h, kind="stable")
        h, at, owner = h[order], at[order], owner[order]
        start = runs(h)
        if not len(start):
            return rows(_SENT, bucket=[], pid=[], blob=[])
        indexed = np.logical_or.reduceat((at - first[owner]) % block == 0, start)
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        h, flags = h[start], indexed.astype(np.uint8) | (several.astype(np.uint8) << 1)
        names, bounds = cuts(h, buckets)
        blobs = [pack((h[a:b] & _LOW).astype(np.uint32), np.packbits(flags[a:b] & 1), np.packbits(flags[a:b] >> 1)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return rows(_SENT, bucket=names, pid=[table["pid"][0].as_py()] * len(names), blob=blobs)

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Of one bucket: windows equal to an index block and found in several documents, for each group that has them."""
    keys, indexed, several, source = [], [], [], []
    pids = table["pid"].to_pylist()
    for i, blob in enumerate(table["blob"].to_pylist()):
        k, a, b = unpack(blob)
        keys.append(k)
        indexed.append(np.unpackbits(a, count=len(k)))
        several.append(np.unpackbits(b, count=len(k)))
        source.append(np.full(len(k), i, np.int32))
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k = k[order]
    start = runs(k)
    size = run_lengths(start, len(k))
    hot = (np.maximum.reduceat(np.concatenate(indexed)[order], start) > 0) & ((size > 1) | (np.maximum.reduceat(np.concatenate(several)[order], start) > 0))
    keep = np.repeat(hot, size)
    k, source = k[keep], np.concatenate(source)[order][keep]
    order = np.argsort(source, kind="stable")
    k, source = k[order], source[order]
    start = runs(source)
    bucket = table["bucket"][0].as_py()
    ends = np.append(start, len(k))[1:]
    return rows(_SENT, bucket=[bucket] * len(start), pid=[pids[source[a]] for a in start], blob=[k[a:b].tobytes() for a, b in zip(start, ends, strict=True)])


def _candidates(window: int, block: int, buckets: int):
    """Each group's full windows around hits, one entry per fingerprint with its smallest document."""

    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        empty = rows(_SENT, bucket=[], pid=[], blob=[])
        if not docs.num_rows or not hits.num_rows:
            return empty
        h, at, _, first = _rolling(docs["text"], block, 0)
        known = np.concatenate([(_U(b) << _U(32)) | np.frombuffer(x, np.uint32).astype(_U) for b, x in zip(hits["bucket"].to_pylist(), hits["blob"].to_pylist(), strict=True)])
        known.sort()
        mine = (bucket_of(h, buckets).astype(_U) << _U(32)) | (h & _LOW)
        spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        hit = at[known[spot] == mine]
        near = np.zeros(int(first[-1]) + 2, np.int32)
        np.add.at(near, np.maximum(hit - (window - block), 0), 1)
        np.add.at(near, hit + 1, -1)
        near = np.cumsum(near) > 0
        full, at, owner, _ = _rolling(docs["text"], window, 0)
        keep = near[at]
        full, at, owner = full[keep], at[keep], owner[keep]
        if not len(full):
            return empty
        more = _second(docs["text"], window, first, at, owner)
        ids = docs["doc_id"].fill_null(_NONE).to_numpy().astype(np.int64)[owner]
        order = np.lexsort((ids, more, full))
        full, more, ids = full[order], more[order], ids[order]
        start = runs(full, more)
        several = np.maximum.reduceat(ids, start) != ids[start]
        full, more, ids = full[start], more[start], ids[start]
        names, bounds = cuts(full, buckets)
        blobs = [pack(full[a:b], more[a:b], ids[a:b], np.packbits(several[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return rows(_SENT, bucket=names, pid=[docs["pid"][0].as_py()] * len(names), blob=blobs)

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Of one bucket: the smallest document of each full window, for each group where a larger one has it too."""
    pids, told = table["pid"].to_pylist(), [unpack(x) for x in table["blob"].to_pylist()]
    f, g, d = (np.concatenate([x[k] for x in told]) for k in range(3))
    s = np.concatenate([np.unpackbits(x[3], count=len(x[0])).astype(bool) for x in told])
    source = np.repeat(np.arange(len(told)), [len(x[0]) for x in told])
    order = np.lexsort((d, g, f))
    f, g, d, s, source = f[order], g[order], d[order], s[order], source[order]
    start = runs(f, g)
    least = np.repeat(d[start], run_lengths(start, len(f)))
    keep = s | (least < d)
    f, g, least, source = f[keep], g[keep], least[keep], source[keep]
    order = np.argsort(source, kind="stable")
    f, g, least, source = f[order], g[order], least[order], source[order]
    start = runs(source)
    ends = np.append(start, len(f))[1:]
    bucket = table["bucket"][0].as_py()
    return rows(_SENT, bucket=[bucket] * len(start), pid=[pids[source[a]] for a in start], blob=[pack(f[a:b], g[a:b], least[a:b]) for a, b in zip(start, ends, strict=True)])


def _remover(window: int, schema: pa.Schema):
    """Documents with the words of confirmed windows taken out."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        removed = np.zeros(0, bool)
        if answers.num_rows:
            full, at, owner, first = _rolling(docs["text"], window, 0)
            known, other, least = (np.concatenate(x) for x in zip(*(unpack(x) for x in answers["blob"].to_pylist()), strict=True))
            order = np.lexsort((other, known))
            known, other, least = known[order], other[order], least[order]
            # Windows that share the first hash follow one another in `known`; the second one tells them apart.
            low, high = np.searchsorted(known, full), np.searchsorted(known, full, "right")
            met = high > low
            at, owner, low, high = at[met], owner[met], low[met], high[met]
            more = _second(docs["text"], window, first, at, owner)
            ids = docs["doc_id"].fill_null(-_NONE).to_numpy().astype(np.int64)[owner]
            hit = np.zeros(len(at), bool)
            for k in range(int((high - low).max(initial=0))):
                spot = np.minimum(low + k, high - 1)
                hit |= (other[spot] == more) & (least[spot] < ids)
            gone = np.zeros(int(first[-1]) + 1, np.int32)
            np.add.at(gone, at[hit], 1)
            np.add.at(gone, at[hit] + window, -1)
            removed = np.cumsum(gone[:-1]) > 0
        kept, spans, counts, done = [], [], [], 0
        for text in docs["text"].to_pylist():
            words = (text or "").encode().split()
            mask = removed[done : done + len(words)]
            done += len(words)
            counts.append(len(words))
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                words = [words[j] for j in np.flatnonzero(~mask)]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode())
        lost = np.array([sum(s["end"] - s["start"] for s in x) for x in spans], np.int64)
        own = {"kept_text": kept, "n_words": counts, "n_removed": lost, "removed": spans}
        return pa.table([docs[f.name].cast(f.type) if f.name not in own else pa.array(own[f.name], f.type) for f in schema], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """Take out words that lie in a `window`-word passage of a document with a smaller doc_id.

    Returns the input columns with kept_text (kept words joined by one space),
    n_words, n_removed and removed (half-open spans of word positions). Input
    columns of those names are replaced; other extra columns pass through.
    Words are runs other than 0x20 and 0x09-0x0D, compared unchanged. Windows
    are judged on the input, so chains of copies all yield to the smallest.

    Null texts and texts of fewer than `window` words lose nothing. Rows with a
    null doc_id lose nothing and make nobody lose anything. Rows that repeat a
    doc_id don't affect one another, as neither is smaller. Very long texts are
    handled like others, whole. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    block = (window + 1) // 2
    docs = docs.drop("kept_text", "n_words", "n_removed", "removed").withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.withColumnRenamed("pid", _OWN_PID)
    n = width(docs)
    laid = dealt(docs, n)
    sent = laid.groupBy("pid").applyInArrow(_probes(block, n), _SENT_DDL)
    hits = sent.groupBy("bucket").applyInArrow(_hits, _SENT_DDL)
    found = laid.groupBy("pid").cogroup(hits.groupBy("pid")).applyInArrow(_candidates(window, block, n), _SENT_DDL)
    answers = found.groupBy("bucket").applyInArrow(_smallest, _SENT_DDL)
    ddl = docs.schema.add("kept_text", "string").add("n_words", "long").add("n_removed", "long").add("removed", SPANS)
    out = laid.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(_remover(window, to_arrow_schema(ddl)), ddl)
    return out.withColumnRenamed(_OWN_PID, "pid")
