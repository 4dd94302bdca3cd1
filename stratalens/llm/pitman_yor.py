"""Hierarchical Pitman-Yor language model over word pairs.

Every context (the 64-bit hash of the previous word, or of the text's start) is
a restaurant, as many as the corpus has; all share one parent, the restaurant
of single words, whose base is uniform over the training vocabulary and one
unknown word. A customer is an occurrence of a word after a context; a table
sends one customer to the parent.

The seating is sampled by Gibbs steps in blocks that don't depend on one
another, so that all of a block may be drawn at once, wherever it lies:

1. Each restaurant draws a gamma variate of strength / discount + its tables.
   Given it, a table weighs the same whatever else the restaurant seats.
2. The parent's own distribution is drawn given its seating: a gamma variate of
   customers - discount * tables for each word, and a share of what the parent
   left to its base, which is a Pitman-Yor process again.
3. Given both, the tables of each (context, word) are drawn, then those of each
   word in the parent.

Counts live in buckets by word, so a word's tables in all contexts, and with
them its customers in the parent, lie in one place. What a sweep needs from
other buckets are the contexts' variates: bucket of contexts add up tables and
answer every bucket of words. Contexts are told by name once; from then on both
sides know their order, and only numbers travel. A pair seen once has one table
in every seating, so sweeps carry pairs seen more often alone, with what the
others add to their words and contexts; and of words that have no such pair only
the sum of their shares of the parent counts, which is one draw. Predictive
probabilities are averaged over the kept sweeps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import cuts, dealt, hashed, narrow, numbered, numbered_within, ordered, pack, rows, run_lengths, runs, unpack
from .hashing import slices
from .seating import draw_tables, rest_mass, rest_masses, stirling, tables_at  # noqa: F401
from .storage import stage, unstage, width

_U = np.uint64
_LOW = (1 << 32) - 1
_stirling = stirling
# Megabytes of input a bucket, and bytes of input a message, at least: a bucket's tables are held a few times over.
_BUCKETS = (5, 1024)
_END, _START = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts, each text's followed by its end; the contexts they stand in; tokens per text."""
    words, first = hashed(texts, lower=True)
    return *_laid(words, first, _END, _START), np.diff(first) + 1


def _laid(words: np.ndarray, first: np.ndarray, end, start) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(first)
    at = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
    token, before = np.full(len(words) + len(counts), end, words.dtype), np.full(len(words) + len(counts), start, words.dtype)
    token[at] = words
    before[at + 1] = words
    return token, before


def _pairs(texts: pa.ChunkedArray, extra: str | None = None) -> tuple[np.ndarray, ...]:
    """Distinct words and contexts, the distinct pairs of their numbers (word above context), tokens per text, and by `extra` each token's pair ("which") or tokens of each pair ("many").

    Every word is a context too, of the next word or the end, so that one sort numbers both.
    """
    hashes, first = hashed(texts, lower=True)
    every, code = numbered(np.append(hashes, [_END, _START]))
    end, start = code[-2:].tolist()
    word, spot = _laid(code[:-2].astype(np.int64), first, end, start)
    words, contexts = every, every
    if len(first) > 1 and not (code[:-2] == end).any() and not (code[:-2] == start).any():
        word, words = word - (word > start), np.delete(every, start)
        spot, contexts = spot - (spot > end), np.delete(every, end)
    else:  # no text at all, or a word with the hash of a text's start or end
        (words, word), (contexts, spot) = np.unique(every[word], return_inverse=True), np.unique(every[spot], return_inverse=True)
    if extra == "which":
        at, pair = ordered(word, spot)
    else:  # sorted in place: np.unique alone would hash, which takes longer
        pair = (word << 32) | spot
        pair.sort()
    start = runs(pair)
    more = run_lengths(start, len(pair)) if extra else None
    if extra == "which":
        which = np.empty(len(pair), np.int64)
        which[at] = np.repeat(np.arange(len(start)), more)
        more = which
    return words, contexts, pair[start], np.diff(first) + 1, more


def _parted(pair: np.ndarray, words: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Pairs by their words' bucket: buckets, bounds of words and of pairs, pairs per word, contexts of each bucket, their bounds, and each pair's among them."""
    at = np.searchsorted(pair, np.arange(len(words) + 1) << 32)
    names, bounds = cuts(words, buckets)
    edges, per = at[bounds], np.diff(at)
    contexts, starts, place = numbered_within(np.repeat(np.arange(len(names)), np.diff(edges)), pair & _LOW, len(names))
    return names, bounds, edges, per, contexts, starts, place


def _counter(buckets: int, text_bytes: int):
    """Counts of runs of texts by bucket of words: words, contexts per word, contexts, each pair's context among them, customers."""

    def counted(texts: list[pa.Array]) -> pa.RecordBatch:
        words, contexts, pair, _, many = _pairs(pa.chunked_array(texts), "many")
        names, bounds, edges, per, own, starts, place = _parted(pair, words, buckets)
        blobs = []
        for k in range(len(names)):
            (a, b), (c, d), (e, f) = bounds[k : k + 2], edges[k : k + 2], starts[k : k + 2]
            blobs.append(pack(words[a:b], per[a:b].astype(np.uint32), contexts[own[e:f]], narrow(place[c:d], f - e), _least(many[c:d])))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            for some in slices(batch, "text"):
                held.append(some.column(0))
                size += some.column(0).nbytes
                if size >= text_bytes:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


_ROWS = {"bucket": pa.int32(), "pid": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
_ROWS_DDL = "bucket int, pid int, kind int, blob binary"
# A bucket of words also has, per word, customers and tables in the parent, and their sums.
# In sweeps these are words after several contexts, those with repeated pairs first, and how many of those there are.
_STATE = {**_ROWS, "parents": pa.binary(), "customers": pa.int64(), "tables": pa.int64()}
_STATE_DDL = _ROWS_DDL + ", parents binary, customers long, tables long"
_COUNTS, _SEATS, _TOLD, _ROOMS, _HOME, _PARENTS, _ASKED, _SHAPE, _NAMES, _INDEX = range(10)
# Of an index: where what is told belongs, and the contexts' names and customers.
_SPOTS, _NAMED = -2, -1


def _least(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return narrow(values, top + 1) if top < 1 << 32 else values.astype(np.int64)


def _seated(bucket: int, homes: np.ndarray, blobs: list[bytes], tables: np.ndarray, customers: np.ndarray, parent: np.ndarray, sums: np.ndarray, drawn: int | None = None, once: int = 0) -> dict[str, list]:
    """Rows of a seated bucket of words: its seating, and what it tells each bucket of contexts. drawn: how many of the words have repeated pairs; once: words seen in one pair once, which are left out."""
    n = len(blobs)
    return {
        "bucket": [bucket, *homes], "pid": [0, *[bucket] * n], "kind": [_SEATS, *[_TOLD] * n], "blob": [pack(_least(tables), _least(sums)), *blobs],
        "parents": [pack(_least(customers), _least(parent), *([] if drawn is None else [np.array([drawn])])), *[None] * n],
        "customers": [int(customers.sum()) + once, *[None] * n], "tables": [int(parent.sum()) + once, *[None] * n],
    }


def _told(bucket: int, counts: list[np.ndarray], tables: np.ndarray, customers: np.ndarray, parent: np.ndarray, sums: np.ndarray, buckets: int) -> dict[str, list]:
    """_seated() rows that tell contexts by name, with their customers and tables."""
    _, _, contexts, place, many = counts
    homes, bounds = cuts(contexts, buckets)
    own = [_least(np.bincount(place, x, len(contexts)).astype(np.int64)) for x in (many, tables)]
    blobs = [pack(contexts[a:b], *(x[a:b] for x in own)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return _seated(bucket, homes, blobs, tables, customers, parent, sums)


def _retold(bucket: int, shape: list[np.ndarray], tables: np.ndarray, customers: np.ndarray, parent: np.ndarray, sums: np.ndarray) -> dict[str, list]:
    """_seated() rows that tell the tables of contexts, in the order in which they were named."""
    per, place, _, homes, sizes, *more = shape
    sizes = sizes.astype(np.int64)
    own = _least(np.bincount(place, tables, sizes.sum()).astype(np.int64))
    blobs = [pack(own[b - n : b]) for b, n in zip(np.cumsum(sizes), sizes, strict=True)]
    return _seated(bucket, homes, blobs, tables, customers, parent, sums, *((len(per), int(more[1][0])) if more else ()))


def _shape(counts: list[np.ndarray], buckets: int) -> list[np.ndarray]:
    """What sweeps need of a bucket's counts: contexts per word, each pair's context, customers, and how many contexts lie in which bucket."""
    _, per, contexts, place, many = counts
    homes, bounds = cuts(contexts, buckets)
    return [per, place, many, homes, _least(np.diff(bounds))]


def _word_of(per: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(per)), per)


def _moving(per: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with repeated pairs, and others after several contexts; the rest has one customer and one table in the parent for good."""
    repeated = np.bincount(_word_of(per)[many > 1], minlength=len(per)) > 0
    return np.flatnonzero(repeated), np.flatnonzero(~repeated & (per > 1))


def _opened(bucket: int, counts: list[np.ndarray], buckets: int) -> dict[str, list]:
    """Rows of a bucket of words with one table for each pair: its counts; what sweeps need of them; its seating; and what it tells contexts.

    The shape is that of repeated pairs, with the pairs seen once of each word
    that sweeps carry, and the bucket's sums: words left out, tokens, words,
    pairs seen once and twice, words after one context and two. Contexts are
    told with their customers and tables of pairs seen once, then which of them
    have repeated pairs here, and how many: these will be told again.
    """
    words, per, contexts, place, many = counts
    again, (drawn, others) = many > 1, _moving(per, many)
    each = np.bincount(_word_of(per)[again], minlength=len(per))
    moving = np.append(drawn, others)
    own, spot = np.unique(place[again], return_inverse=True)
    facts = [len(words) - len(moving), int(many.sum(dtype=np.int64)), len(words), *(int((x == k).sum()) for x in (many, per) for k in (1, 2))]
    shape = [*_shape([None, each[drawn].astype(np.uint32), contexts[own], narrow(spot, len(own)), many[again]], buckets), _least((per - each)[moving]), np.array(facts)]

    homes, bounds = cuts(contexts, buckets)
    customers, once, tables = (np.bincount(place, x, len(contexts)).astype(np.int64) for x in (many, ~again, again))
    edges = np.searchsorted(own, bounds)
    told = [
        pack(contexts[a:b], _least(customers[a:b]), _least(once[a:b]), narrow(own[c:d] - a, b - a), _least(tables[own[c:d]]))
        for a, b, c, d in zip(bounds[:-1], bounds[1:], edges[:-1], edges[1:], strict=True)
    ]
    pairs = int(again.sum())
    out = _seated(bucket, homes, told, np.ones(pairs, np.int64), per[moving].astype(np.int64), np.ones(len(moving), np.int64), np.zeros(pairs, np.int64), len(drawn), facts[0])
    named = {"bucket": [bucket] * 2, "pid": [0] * 2, "kind": [_SHAPE, _NAMES], "blob": [pack(*shape), pack(*counts)]}
    return {k: [*named.get(k, [None] * 2), *v] for k, v in out.items()}


def _merged(buckets: int):
    """A bucket's counts from all parts, and a seating with one table for every (word, context)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table["blob"].to_pylist()]
        # Words repeat once a part, pairs far more often: only the words are sorted at full width.
        words, code = numbered(np.concatenate([p[0] for p in parts]))
        contexts, spot = numbered(np.concatenate([p[2] for p in parts]))
        first = np.cumsum([0, *(len(p[2]) for p in parts)])
        order, pair = ordered(np.repeat(code, np.concatenate([p[1] for p in parts])), np.concatenate([spot[a : a + len(p[2])][p[3]] for a, p in zip(first, parts, strict=False)]))
        start = runs(pair)
        many = np.add.reduceat(np.concatenate([p[4].astype(np.int64) for p in parts])[order], start)
        pair = pair[start]
        per = np.diff(np.searchsorted(pair, np.arange(len(words) + 1) << 32))
        counts = [words, per.astype(np.uint32), contexts, narrow(pair & _LOW, len(contexts)), _least(many)]
        return rows(_STATE, **_opened(table["bucket"][0].as_py(), counts, buckets))

    return run


@dataclass
class _Totals:
    """Sums over all buckets; its size does not depend on the corpus."""

    tables: int  # in all contexts: the customers of the parent
    parent_tables: int
    tokens: int = 0
    vocabulary: int = 0


@dataclass
class Model:
    """A fitted model: staged buckets of words and contexts, and what all of them share."""

    counts: DataFrame
    buckets: int
    now: _Totals
    discount: tuple[float, float] = (0.8, 0.5)  # contexts, parent
    strength: tuple[float, float] = (1.0, 1.0)
    index: DataFrame | None = None  # contexts by bucket, and where what is told of them belongs
    seats: DataFrame | None = None  # the last sweep's, with tables added up over kept sweeps
    samples: list[_Totals] = field(default_factory=list)
    parents: list[DataFrame] = field(default_factory=list)  # a kept sweep's customers and tables of words in the parent
    homes: list[DataFrame] = field(default_factory=list)  # and its tables of contexts
    settled: list[int] = field(default_factory=list)  # tables in all contexts after each sweep

    @property
    def train_tokens(self) -> int:
        return self.now.tokens


def _summed(df: DataFrame, column: str, each, width_: int) -> np.ndarray:
    """Sums over the rows of `df` of the `width_` numbers that each(bucket, arrays of the column) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width_)
        for batch in batches:
            for row in batch.to_pylist():
                total += each(row["bucket"], unpack(row[column]))
        yield pa.RecordBatch.from_arrays([pa.array(range(width_), pa.int64()), pa.array(total)], ["at", "total"])

    got = df.select("bucket", column).mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(width_)
    out[got["at"].to_numpy()] = got["total"].to_numpy()
    return out


def _added(discount: float, strength: float, seed: int):
    """A bucket of contexts: its tables, and for each bucket of words the variates of the contexts it told of; where those were told by name, the index too."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        home, kinds, blobs = table["bucket"][0].as_py(), table["kind"].to_pylist(), table["blob"].to_pylist()
        pids = [p for p, k in zip(table["pid"].to_pylist(), kinds, strict=True) if k == _TOLD]
        told = [unpack(x) for x, k in zip(blobs, kinds, strict=True) if k == _TOLD]
        own, own_kinds, own_pids = [], [_HOME], [-1]
        if _INDEX in kinds:
            once, spot = unpack(blobs[kinds.index(_INDEX)])
        else:
            contexts, spot = numbered(np.concatenate([x[0] for x in told]))
            customers, once = (np.bincount(spot, np.concatenate(x), len(contexts)).astype(np.int64) for x in ([x[1] for x in told], [x[2] if len(x) > 3 else np.zeros(len(x[0])) for x in told]))
            # Which are told again: all, or those that have repeated pairs where they are told.
            starts = np.cumsum([0, *(len(x[0]) for x in told)])
            spot = np.concatenate([spot[a : a + len(x[0])][x[3] if len(x) > 3 else slice(None)] for a, x in zip(starts, told, strict=False)])
            own, own_kinds, own_pids = [pack(_least(once), narrow(spot, len(contexts))), pack(contexts, _least(customers))], [_HOME, _INDEX, _INDEX], [-1, _SPOTS, _NAMED]
        tables = once + np.bincount(spot, np.concatenate([x[-1] for x in told] or [np.zeros(0)]), len(once)).astype(np.int64)
        gamma = np.random.default_rng([seed, 1, home]).gamma(strength / discount + tables).astype(np.float32)
        stops = np.cumsum([len(x[-1]) for x in told])
        # Parts of a bucket of words follow one another by home, as its contexts do.
        out = [pack(gamma[spot[b - len(x[-1]) : b]]) for x, b in zip(told, stops, strict=True)]
        own = [pack(_least(tables)), *own]
        return rows(_ROWS, bucket=[*[home] * len(own), *pids], pid=[*own_pids, *[home] * len(pids)], kind=[*own_kinds, *[_ROOMS] * len(pids)], blob=[*own, *out])

    return run


def _masses(bucket: int, customers: np.ndarray, tables: np.ndarray, rest: float, vocabulary: int, discount: float, seed: int) -> np.ndarray:
    """The parent's distribution given its seating, by word and not yet divided by its sum; the same whenever it is asked for."""
    rng = np.random.default_rng([seed, 2, bucket])
    return rng.gamma(customers - discount * tables) + rest_masses(len(customers), rest / (vocabulary + 1), discount, rng)


def _weigher(rest: float, vocabulary: int, discount: float, seed: int):
    """Sums over a bucket's words with repeated pairs: their masses, customers and tables, and how many they are."""

    def sums(bucket: int, parents: list[np.ndarray]) -> list[float]:
        customers, tables = (x[: int(parents[2][0])] for x in parents[:2])
        return [_masses(bucket, customers, tables, rest, vocabulary, discount, seed).sum(), customers.sum(dtype=np.int64), tables.sum(dtype=np.int64), len(customers)]

    return sums


def _sweeper(now: _Totals, discount: tuple, strength: tuple, rest: float, mass: float, own: float, seed: int, keep: bool, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pid")
        kinds, blobs, bucket = table["kind"].to_pylist(), table["blob"].to_pylist(), table["bucket"][0].as_py()
        by_name = _COUNTS in kinds
        counts = unpack(blobs[kinds.index(_COUNTS if by_name else _SHAPE)])
        per, place, many = (counts[1], *counts[3:]) if by_name else counts[:3]
        _, sums = unpack(blobs[kinds.index(_SEATS)])
        customers, parent = unpack(table["parents"][kinds.index(_SEATS)].as_py())[:2]
        gamma = np.concatenate([unpack(x)[0] for k, x in zip(kinds, blobs, strict=True) if k == _ROOMS] or [np.zeros(0)])
        rng, word, n = np.random.default_rng([seed, 3, bucket]), _word_of(per), len(per)
        base = np.maximum(_masses(bucket, customers[:n], parent[:n], rest, now.vocabulary, discount[1], seed) / mass, 1e-300)
        tables = tables_at(many.astype(np.int64), gamma[place] * base[word], discount[0], rng, stirling(discount[0]))
        customers = np.zeros(n, np.int64) if by_name else counts[5].astype(np.int64)
        customers[:n] += np.bincount(word, tables, n).astype(np.int64)
        parent = tables_at(customers, np.full(len(customers), own / (now.vocabulary + 1)), discount[1], rng, stirling(discount[1]))
        sums = sums.astype(np.int64) + tables * keep
        return rows(_STATE, **(_told(bucket, counts, tables, customers, parent, sums, buckets) if by_name else _retold(bucket, counts, tables, customers, parent, sums)))

    return run


def train(docs: DataFrame, burn_in: int = 3, keep: int = 3, seed: int = 11, settle: float = 0.01, most: int = 20) -> Model:
    """Fit to all of `docs(doc_id, text)`: sweeps until tables settle, then `keep` sweeps whose seatings are kept.

    Sweeps count as settled once the number of tables changes by less than a
    share of `settle` and two of its square roots (at least `burn_in` sweeps,
    `most` at most). Texts are
    lower-cased (A-Z) and end in an end token. Null and empty texts count as
    one end token. Discounts follow from the numbers of pairs and words seen
    once and twice. An empty table gives the uniform model.
    """
    n = width(docs, *_BUCKETS)
    counted = docs.select("text").mapInArrow(_counter(n, 4 << 20), "bucket int, blob binary")
    first = stage(counted.groupBy("bucket").applyInArrow(_merged(n), _STATE_DDL), "counts", "kind")
    shapes = first.where(F.col("kind") == _SHAPE)
    tokens, vocabulary, a1, a2, b1, b2 = _summed(shapes, "blob", lambda _, x: x[-1][1:], 6)
    model = Model(first.where(F.col("kind") == _NAMES), n, _Totals(0, 0, int(tokens), int(vocabulary)))
    model.discount = tuple(min(0.95, max(0.05, x / (x + 2 * y))) if x else d for x, y, d in zip((a1, b1), (a2, b2), model.discount, strict=True))
    if not vocabulary:
        return model
    (da, d0), (sa, s0) = model.discount, model.strength
    pick = np.random.default_rng([seed, 0])
    totals = lambda state: _Totals(*state.agg(F.sum("customers"), F.sum("tables")).first(), int(tokens), int(vocabulary))
    kind = lambda df, k: df.where(F.col("kind") == k)
    state, now, sweep = first, totals(first), 0
    while True:
        salt = seed + 1000 * sweep
        told = kind(state, _TOLD).select(*_ROWS)
        if model.index is not None:
            told = told.unionByName(model.index.where(F.col("pid") == _SPOTS))
        rooms = stage(told.groupBy("bucket").applyInArrow(_added(da, sa, salt), _ROWS_DDL), "rooms")
        if model.index is None:
            model.index = stage(kind(rooms, _INDEX), "index", "pid").select(*_ROWS)
        if len(model.homes) < len(model.samples):
            model.homes.append(stage(kind(rooms, _HOME), "homes"))
        if len(model.samples) == keep:
            unstage(rooms)
            break
        model.settled.append(now.tables)
        far = sweep < burn_in or abs(now.tables - model.settled[-2]) > settle * now.tables + 2 * math.sqrt(now.tables)
        held = not far or sweep >= most or bool(model.samples)
        # Two draws of the parent's variate: one for what it leaves to its base, one for its next tables.
        rest, own = pick.gamma(s0 / d0 + now.parent_tables), pick.gamma(s0 / d0 + now.parent_tables)
        mass, many, seated, words = _summed(kind(state, _SEATS), "parents", _weigher(rest, int(vocabulary), d0, salt), 4)
        # Words without repeated pairs, and the unknown word: independent masses of one kind add up to a mass of that kind.
        mass += pick.gamma(now.tables - many - d0 * (now.parent_tables - seated)) + rest_mass((vocabulary + 1 - words) * rest / (vocabulary + 1), d0, pick)
        sweeper = _sweeper(now, model.discount, model.strength, rest, mass, own, salt, held, n)
        whole = kind(rooms, _ROOMS).select(*_ROWS, F.lit(None).cast("binary").alias("parents"))
        for part in (shapes, kind(state, _SEATS)):
            whole = whole.unionByName(part.select(*_ROWS, "parents"))
        following = stage(whole.groupBy("bucket").applyInArrow(sweeper, _STATE_DDL), "seats")
        unstage(rooms)
        if state is not first:
            unstage(state)
        state, now, sweep = following, totals(following), sweep + 1
        if held:
            model.parents.append(stage(kind(state, _SEATS).select("bucket", "pid", F.lit(_PARENTS).alias("kind"), F.col("parents").alias("blob")), "parents"))
            model.samples.append(now)
    model.seats = stage(kind(state, _SEATS).select(*_ROWS), "seats")
    unstage(state)
    model.now = now
    return model


def _asker(buckets: int):
    """A group of documents asks buckets of words for its words and pairs, and buckets of contexts, numbered after them, for its contexts."""

    def run(table: pa.Table) -> pa.Table:
        words, contexts, pair, _, _ = _pairs(table["text"])
        names, bounds, edges, per, own, starts, place = _parted(pair, words, buckets)
        blobs = []
        for k in range(len(names)):
            (a, b), (c, d), (e, f) = bounds[k : k + 2], edges[k : k + 2], starts[k : k + 2]
            blobs.append(pack(words[a:b], _least(per[a:b]), contexts[own[e:f]], narrow(place[c:d], f - e)))
        homes, bounds = cuts(contexts, buckets)
        blobs += [pack(contexts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return rows(_ROWS, bucket=[*names, *(homes + buckets)], pid=[table["pid"][0].as_py()] * len(blobs), kind=[_ASKED] * len(blobs), blob=blobs)

    return run


def _found(sorted_values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where asked values are, and whether they are there at all."""
    if not len(sorted_values):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_values, asked), len(sorted_values) - 1)
    return at, sorted_values[at] == asked


def _answerer(buckets: int):
    """Buckets of words answer with occurrences, then customers and tables of each sample, by word, and customers and summed tables by pair; those of contexts with customers and tables of each sample."""

    def words_of(counts: list[np.ndarray], sums: np.ndarray, parents: list[list[np.ndarray]]):
        words, per, contexts, place, many = counts
        word, moving = _word_of(per), np.concatenate(_moving(per, many))
        pair = (word << 32) | place
        seen = np.append(np.bincount(word, many, len(words)).astype(np.int64), 0)
        by_word = [np.append(np.ones(len(words), np.int64), 0) for _ in range(2 * len(parents))]
        for every, x in zip(by_word, (x for sample in parents for x in sample[:2]), strict=True):
            every[moving] = x
        repeated, sums = sums, np.full(len(many), len(parents))
        sums[many > 1] = repeated

        def answer(blob: bytes) -> bytes:
            asked, each, context, own = unpack(blob)
            spot, known = _found(words, asked)
            code = np.where(known, spot, len(words))
            room, met = _found(contexts, context)
            at, found = _found(pair, (np.repeat(code, each) << 32) | room[own])
            found &= met[own]
            return pack(*(_least(x[code]) for x in (seen, *by_word)), *(_least(np.where(found, x[at], 0)) for x in (many, sums)))

        return answer

    def contexts_of(index: list[np.ndarray], tables: list[np.ndarray]):
        def answer(blob: bytes) -> bytes:
            at, known = _found(index[0], unpack(blob)[0])
            return pack(*(_least(np.where(known, x[at], 0)) for x in (index[1], *tables)))

        return answer

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return rows(_ROWS, bucket=[], pid=[], kind=[], blob=[])
        bucket = asked["bucket"][0].as_py()
        held = held.sort_by("pid")
        parts = [(k, unpack(x)) for k, x in zip(held["kind"].to_pylist(), held["blob"].to_pylist(), strict=True)]
        if bucket < buckets:
            one = dict(parts)
            answer = words_of(one[_NAMES], next(x[1] for k, x in parts if k == _SEATS), [x for k, x in parts if k == _PARENTS])
        else:
            answer = contexts_of(next(x for k, x in parts if k == _INDEX), [x[0] for k, x in parts if k == _HOME])
        n = asked.num_rows
        return rows(_ROWS, bucket=[bucket] * n, pid=asked["pid"].to_pylist(), kind=[_ASKED] * n, blob=[answer(x) for x in asked["blob"].to_pylist()])

    return run


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _gatherer(now: _Totals, samples: list[_Totals], discount: tuple, strength: tuple, buckets: int, end: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        words, contexts, pair, n, which = _pairs(docs["text"], "which")
        word, place = pair >> 32, pair & _LOW
        told = {b: unpack(x) for b, x in zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True)}
        many = 3 + 2 * len(samples)

        def joined(values: np.ndarray, first: int, wide: int, take: slice) -> list[np.ndarray]:
            """The answers' arrays one after another, zeros from buckets that hold nothing."""
            names, bounds = cuts(values, buckets)
            sizes = np.diff(np.searchsorted(word, bounds)) if take.start else np.diff(bounds)
            parts = [told.get(first + b, [None] * (take.stop or 0))[take] for b in names.tolist()]
            return [np.concatenate([np.zeros(size, np.int64) if p[k] is None else p[k].astype(np.int64) for p, size in zip(parts, sizes, strict=True)] or [np.zeros(0, np.int64)]) for k in range(wide)]

        seen, *by_word = joined(words, 0, many - 2, slice(0, many - 2))
        own, sums = joined(words, 0, 2, slice(many - 2, many))
        customers, *tables = joined(contexts, buckets, 1 + len(samples), slice(0, 1 + len(samples)))
        (da, d0), (sa, s0) = discount, strength
        p = len(samples) * own - da * sums
        for k, s in enumerate(samples):
            parent = (by_word[2 * k] - d0 * by_word[2 * k + 1] + (s0 + d0 * s.parent_tables) / (s.vocabulary + 1)) / (s0 + s.tables)
            p = p + (sa + da * tables[k][place]) * parent[word]
        p = p / (sa + customers[place]) / len(samples) if samples else np.full(len(pair), 1.0)
        owner = np.repeat(np.arange(len(n)), n)
        total = lambda x: np.bincount(owner, x[which], len(n))
        base = total(np.log10((seen + 1) / (now.tokens + now.vocabulary + 1))[word])
        logs = np.log10(p)
        score = total(logs) if end else total(logs) - logs[which][np.cumsum(n) - 1]
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n_tokens": n, "n_known": total(seen[word] > 0).astype(np.int64), "base_score": base, "score": score})

    return run


def score(model: Model, docs: DataFrame, end: bool = True, passes: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probability) for each row of `docs(doc_id, text)`.

    Tokens are words and one end; null and empty texts are the end alone.
    n_known counts tokens of the training texts; base_score is the add-one
    unigram score. Perplexity is 10 ** (-score / n_tokens). Without `end`, score
    is that of all texts which begin with the text's words. Null doc_ids and
    repeated rows are scored like others; empty tables give no rows; extra
    columns are ignored; texts of any length are scored whole.

    Documents are scored in `passes` parts, one after another, so that no more
    than one part's questions and answers take disk at a time.
    """
    n = model.buckets
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    groups = max(1, math.ceil(width(docs, *_BUCKETS) / passes))
    held = model.counts.select(*_ROWS)
    if model.seats is not None:
        held = held.unionByName(model.seats)
    if model.index is not None:
        held = held.unionByName(model.index.where(F.col("pid") == _NAMED).select((F.col("bucket") + n).alias("bucket"), "pid", "kind", "blob"))
    for k, (parents, home) in enumerate(zip(model.parents, model.homes, strict=True)):
        order = F.lit(k).cast("int").alias("pid")
        held = held.unionByName(parents.select("bucket", order, "kind", "blob"))
        held = held.unionByName(home.select((F.col("bucket") + n).alias("bucket"), order, "kind", "blob"))
    gather = _gatherer(model.now, model.samples, model.discount, model.strength, n, end)
    out = None
    for k in range(passes):
        laid = dealt(docs.where(F.pmod(F.hash("doc_id", "text"), F.lit(passes)) == k), groups)
        asked = laid.groupBy("pid").applyInArrow(_asker(n), _ROWS_DDL)
        answers = held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_answerer(n), _ROWS_DDL)
        part = stage(laid.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(gather, _SCORES), "scores")
        out = part if out is None else out.unionByName(part)
    return out


def held_out(doc_id, parts: int = 7, part: int = 2):
    """Rows kept from training: crc32 of the id's text leaves `part`. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def perplexity(scores: DataFrame) -> float:
    """Per-token perplexity of all rows of a score() result; NaN for none."""
    total, n = scores.agg(F.sum("score"), F.sum("n_tokens")).first()
    return 10 ** (-total / n) if n else math.nan
