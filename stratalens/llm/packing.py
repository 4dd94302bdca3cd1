"""Packing of token pieces into sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver, at most one count per
length up to the capacity. The covering program over all configurations
(multisets of lengths that fit) is solved fractionally by multiplicative
weights: a length loses weight as its demand is covered, a knapsack dynamic
program prices configurations, and its optimum gives a dual bound. The
fractional solution is rounded down, single configurations that still have all
their pieces are rounded up, and what is left is solved again, until less than
a hundredth remains for best fit. Pieces then look up their place by their
rank among pieces of equal length.
"""

from __future__ import annotations

import logging
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import byte_hash, slices, text_bytes
from .storage import stage

_LOG = logging.getLogger(__name__)
_CACHE_ENTRIES = 1_500_000
# Bytes of text encoded at once, in which equal stretches are looked up once.
_SLICE = 4 << 20
_SHARE, _BASE = "share of a length", "pieces before a share"
# Kinds of ASCII bytes. Apostrophes and the characters of special tokens are cut at neither side.
_LETTER, _PUNCT, _OTHER = 1, 2, 3
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = _PUNCT
_KINDS[np.frombuffer(b"0123456789'<|>", np.uint8)] = _OTHER
_KINDS[ord("A") : ord("Z") + 1] = _KINDS[ord("a") : ord("z") + 1] = _LETTER


class Encoder:
    """Byte-level BPE ids by the `tokenizers` library, with repeated stretches of text encoded once.

    Texts are cut where the pre-tokenizer always cuts; equal stretches then have
    equal ids. Stretches count as equal if two independent 64-bit hashes agree.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Kept stretches by their first hash, in order: second hash, and where their ids are.
        self.names, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts data[bounds[i]:bounds[i+1]], and the bounds of each text's ids."""
        begins = self._cut(data, bounds)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(begins[1:], len(data))
        names, at, code = np.unique(byte_hash(data, begins, ends), return_index=True, return_inverse=True)
        second = byte_hash(data, begins, ends, 1)
        # A stretch that only shares the first hash with the one kept under it becomes an entry of its own.
        odd = np.flatnonzero(second != second[at][code])
        code[odd] = len(at) + np.arange(len(odd))
        at = np.append(at, odd)
        checks, kept = second[at], len(names)
        spot = np.searchsorted(self.names, names)
        there = np.zeros(kept, bool)
        inside = np.flatnonzero(spot < len(self.names))
        there[inside] = self.names[spot[inside]] == names[inside]
        begin, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        hit = np.zeros(len(at), bool)
        hit[np.flatnonzero(there)] = self.checks[spot[there]] == checks[:kept][there]
        place = spot[hit[:kept]]
        begin[hit], sizes[hit], flat = self.begin[place], self.size[place], self.flat
        missing = np.flatnonzero(~hit)
        if len(missing):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(begins[at[missing]].tolist(), ends[at[missing]].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            many = np.fromiter(map(len, found), np.int64, len(found))
            stops = np.cumsum(many)
            begin[missing], sizes[missing] = len(flat) + stops - many, many
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.uint32, int(stops[-1]))])
            # What comes first is what comes often: a full cache is kept as it is.
            new = np.flatnonzero(~there)[: max(0, _CACHE_ENTRIES - len(self.names))]
            if len(new):
                self._keep(spot[new], names[new], checks[new], sizes[new], begin[new], flat)
        each = sizes[code]
        stop = np.cumsum(each)
        ids = flat[np.repeat(begin[code] - (stop - each), each) + np.arange(int(stop[-1]))]
        return ids, np.concatenate([[0], stop])[np.searchsorted(begins, bounds)]

    def _keep(self, spot: np.ndarray, names: np.ndarray, checks: np.ndarray, sizes: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> None:
        """Add new stretches before places `spot`, their ids being in `flat`."""
        stops = np.cumsum(sizes)
        ids = flat[np.repeat(begin - (stops - sizes), sizes) + np.arange(int(stops[-1]))]
        self.names, self.checks = np.insert(self.names, spot, names), np.insert(self.checks, spot, checks)
        self.begin, self.size = np.insert(self.begin, spot, len(self.flat) + stops - sizes), np.insert(self.size, spot, sizes)
        self.flat = np.concatenate([self.flat, ids])

    @staticmethod
    def _cut(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where stretches begin: places at which the pre-tokenizer cuts whatever stands around them.

        Before a single space or a newline after a visible character, after a
        single newline, and between letters and most punctuation.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = _KINDS[data]
        # A two-byte Latin letter counts as a letter at its lead and, for what follows, at its end.
        latin = np.zeros(n, bool)
        latin[:-1] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        ends = np.zeros(n, bool)
        ends[1:] = latin[:-1]
        starts_letter, ends_letter = (kind == _LETTER) | latin, (kind == _LETTER) | ends
        seen = (kind == _LETTER) | (kind == _PUNCT) | (kind == _OTHER)
        starts_seen, ends_seen = seen | latin, seen | ends
        cut = np.zeros(n, bool)
        newline = data == 0x0A
        cut[1:-1] = (data[1:-1] == 0x20) & ends_seen[:-2] & starts_seen[2:]
        cut[1:] |= newline[1:] & ends_seen[:-1]
        cut[2:] |= newline[1:-1] & ends_seen[:-2] & starts_seen[2:]
        cut[1:] |= ends_letter[:-1] & (kind[1:] == _PUNCT)
        cut[1:] |= (kind[:-1] == _PUNCT) & starts_letter[1:]
        # What a neighbouring text holds must not matter: it could at a text's second byte and its last.
        inner = bounds[:-1][np.diff(bounds) > 0]
        cut[np.minimum(inner + 1, n - 1)] &= (data[inner] != 0x0A)
        last = bounds[1:] - 1
        last = last[last >= 0]
        cut[last[data[last] == 0x20]] = False
        cut[inner] = True
        return np.flatnonzero(cut)


_ENCODERS: dict[str, Encoder] = {}
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piecer(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            batch = batch.set_column(1, "text", batch.column(1).fill_null(""))
            for some in slices(batch, "text", _SLICE):
                ids, first = encoder.encode(*text_bytes(some.column(1)))
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, doc in enumerate(some.column(0).to_pylist()):
                    raw = ids[first[i] : first[i + 1]].tobytes() + end
                    n = len(raw) // 4
                    begin, stop = 0, n - capacity * ((n - 1) // capacity)
                    for k in range((n - 1) // capacity + 1):
                        for column, x in zip(out, (doc, k, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])), strict=True):
                            column.append(x)
                        begin, stop = stop, stop + capacity
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of `docs(doc_id, text)`.

    A document is its ids and `end_id`; one longer than `capacity` is cut into
    pieces of that length, the first taking the remainder. Null texts are empty:
    one piece holding only the end. Rows with null or repeated doc_ids give
    their pieces like others.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piecer(tokenizer, capacity, end_id), _PIECE)


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Unbounded knapsack by dynamic programming: most value within each room, and the length (by place) taken there; -1: none."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        reach = best[c - lengths[:k]] + values[:k]
        j = int(reach.argmax())
        if reach[j] > best[c - 1]:
            best[c], choice[c] = reach[j], j
        else:
            best[c] = best[c - 1]
    return best, choice.tolist()


def _filling(choice: list[int], size: list[int], room: int) -> Iterator[int]:
    """The lengths (by place) that the knapsack takes within some room."""
    while room > 0:
        j = choice[room]
        if j < 0:
            room -= 1
        else:
            yield j
            room -= size[j]


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> Counter:
    """The multiset of lengths within capacity of most value."""
    size = lengths.tolist()
    return Counter(size[j] for j in _filling(_knapsack(values, lengths, capacity)[1], size, capacity))


def linear_program(demand: dict[int, int], capacity: int, rounds: int = 40, rate: float = 0.5, slack: float = 0.6) -> tuple[dict[tuple, float], float]:
    """Configurations and fractional numbers of sequences that cover `demand` by length, and a lower bound on any packing.

    In each round every length is to be covered by a growing share of its
    demand. A length's value is its share of the capacity times exp(rate * what
    it lags behind); a configuration of a lagging length is that length and the
    best filling of the rest. No length is covered by more than `slack` beyond
    the round's share, so some stay behind: rounding leaves them to the next
    solution. Values over the best configuration's value are feasible for the
    dual, whose largest objective is the bound.
    """
    lengths = np.array(sorted(demand))
    wanted = np.array([demand[n] for n in lengths.tolist()], float)
    size, need = lengths.tolist(), wanted.tolist()
    covered, uses, bound = [0.0] * len(size), Counter(), 0.0
    for k in range(1, rounds + 1):
        goal = min(1.0, k / (0.8 * rounds))
        lag = goal - np.array(covered)
        if lag.max() <= 1e-9:
            continue
        values = lengths / capacity * np.exp(rate * lag)
        best, choice = _knapsack(values, lengths, capacity)
        bound = max(bound, float(wanted @ values) / best[capacity])
        for i in np.argsort(-lag, kind="stable").tolist():
            if goal - covered[i] <= 1e-9:
                continue
            content = {i: 1}
            for j in _filling(choice, size, capacity - size[i]):
                content[j] = content.get(j, 0) + 1
            many = min((goal + slack * (j != i) - covered[j]) * need[j] / a for j, a in content.items())
            if many > 1e-6:
                for j, a in content.items():
                    covered[j] += many * a / need[j]
                uses[tuple(sorted(((size[j], a) for j, a in content.items()), reverse=True))] += many
    return uses, bound


def _best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit decreasing over a histogram; bins of equal content are one entry."""
    open_: dict[int, Counter] = {}  # room left -> content -> bins
    for length in sorted(left, reverse=True):
        many = left[length]
        while many:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(many, each)
                for k, n in ((each, full), (rest, 1 if rest else 0)):
                    if n:
                        open_.setdefault(capacity - k * length, Counter())[(length,) * k] += n
                many = 0
                continue
            content, bins = next(iter(open_[room].items()))
            each = min(room // length, many)
            take = min(bins, many // each)
            open_[room][content] -= take
            if not open_[room][content]:
                del open_[room][content]
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - each * length, Counter())[(*content, *(length,) * each)] += take
            many -= take * each
    out: Counter = Counter()
    for by in open_.values():
        out.update(by)
    return out


@dataclass
class Plan:
    """A packing of a histogram of lengths."""

    uses: Counter  # configuration (descending tuple of lengths) -> sequences
    bound: float  # no packing has fewer sequences
    pieces: int
    rounded: int  # pieces that the linear program's configurations place; best fit places the rest


def planned(histogram: dict[int, int], capacity: int, rounds: int = 40, most_left: float = 0.01) -> Plan:
    """Pack a histogram of lengths exactly: the linear program, rounded and solved again for what is left, then best fit."""
    out: Counter = Counter({(capacity,): histogram[capacity]}) if histogram.get(capacity) else Counter()
    left = {n: m for n, m in histogram.items() if m > 0 and n < capacity}
    total, bound = sum(histogram.values()), None
    before = math.inf
    while left and most_left * total < sum(left.values()) < before:
        before = sum(left.values())
        uses, least = linear_program(left, capacity, rounds)
        bound = least if bound is None else bound

        def place(content: tuple, times: int) -> int:
            times = min(times, *(left.get(n, 0) // a for n, a in content))
            if times:
                out[tuple(n for n, a in content for _ in range(a))] += times
                for n, a in content:
                    left[n] -= a * times
            return times

        order = sorted(uses.items(), key=lambda u: (-u[1], u[0]))
        rest = [(many - place(content, int(many)), content) for content, many in order]
        for _, content in sorted(rest, key=lambda r: (-r[0], r[1])):
            place(content, 1)
        left = {n: m for n, m in left.items() if m}
    plan = Plan(out, out.get((capacity,), 0) + (bound or 0.0), total, total - sum(left.values()))
    plan.uses.update(_best_fit(left, capacity))
    _LOG.info("%d pieces in %d sequences, at least %.1f; %d pieces placed by the linear program", total, sum(plan.uses.values()), plan.bound, plan.rounded)
    return plan


def configurations(histogram: dict[int, int], capacity: int, rounds: int = 40) -> Counter:
    """Configurations (descending tuples of lengths) and how many sequences use each; covers the histogram exactly."""
    return planned(histogram, capacity, rounds).uses


def _places(plan: Counter) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of that length per sequence, offset), by length and rank."""
    rank: Counter = Counter()
    table, sequence = [], 0
    for content, many in sorted(plan.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(content).items(), reverse=True):
            table.append((length, rank[length], sequence, each, offset))
            rank[length] += each * many
            offset += each * length
        sequence += many
    return np.array(sorted(table), np.int64).reshape(-1, 5)


def _placer(places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (places[:, 0] << 44) | places[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = places[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            slot = rank - row[:, 1]
            sequence, offset = row[:, 2] + slot // row[:, 3], row[:, 4] + (slot % row[:, 3]) * length
            batch = batch.drop_columns(["rank"])
            yield batch.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """`parts` (doc_id, piece, length and others) with sequence_id and offset.

    Each row gets a place in a sequence of at most `capacity` tokens, places of
    a sequence following one another from 0. `parts` should be a written table,
    as it is read twice. Lengths are from 1 to capacity; others raise. Null and
    repeated doc_ids are placed like others; an empty table gives no rows;
    columns named sequence_id, offset or rank are replaced, others kept.
    """
    parts = parts.drop("sequence_id", "offset", "rank")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).limit(capacity + 2).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError("piece lengths must lie between 1 and the capacity")
    places = _places(configurations(counts, capacity))
    # Rank among equal lengths in two levels: within a share of them, and shares before it.
    shares = max(1, math.ceil(sum(counts.values()) / 5_000))
    dealt = parts.withColumn(_SHARE, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    before = dealt.groupBy("length", _SHARE).agg(F.count("*").alias("n"))
    before = before.select("length", _SHARE, (F.sum("n").over(Window.partitionBy("length").orderBy(_SHARE)) - F.col("n")).alias(_BASE))
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns]
    inner = F.row_number().over(Window.partitionBy("length", _SHARE).orderBy(*order))
    ranked = dealt.join(before, ["length", _SHARE]).withColumn("rank", F.col(_BASE) + inner - 1)
    ranked = ranked.select(*parts.columns, F.col("rank").cast("long"))
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(_placer(places), schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenize, cut and pack `docs(doc_id, text)`: the columns of pieces() with sequence_id and offset."""
    return pack(stage(pieces(docs, tokenizer, capacity), "pieces"), capacity)
