"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers and kept as postings by component in blocks
of candidates, in the narrowest type that holds them. A block of queries adds
its weights up term by term in a dense score array of the block; terms that
name most rows are added together, as one product that is exact. What reaches
a query's fifth best score so far is merged into its best.

Work is a grid of lanes of candidates and groups of queries. A lane's blocks
pass by one block of queries after another, so a task yields a few rows a query
whatever it read. The grid has as many cells as keep the copies of both sides
at a few times the candidates; neither side is ever broadcast or held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage

_TILE = 64
_BLOB = "ids binary, width int, item int, data binary"


def _quantise(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer rows of the usable vectors, padded with zeros to a common width."""
    ids, vectors = batch.column(0), batch.column(1)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(ids)), lengths)
    good = np.ones(len(ids), bool)
    good[owner[~np.isfinite(values)]] = False
    good &= vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(ids), wide))
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(invalid="ignore"):
        out[owner, np.arange(len(owner)) - first] = np.floor(scale * np.where(np.isfinite(values), values, 0))
    out = out[good]
    if out.size and np.abs(out).max() >= 2.0**62:
        raise ValueError("a quantised component does not fit in 62 bits")
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[good].astype(np.int64), out.astype(np.int64)


def _packer(scale: float, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids, data = _quantise(batch.slice(at, rows), scale)
                if len(ids):
                    item = next(n for n in (1, 2, 4, 8) if n == 8 or np.abs(data).max(initial=0) < 1 << (8 * n - 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.tobytes()]), pa.array([data.shape[1]], pa.int32()), pa.array([item], pa.int32()), pa.array([np.ascontiguousarray(data.T, f"i{item}").tobytes()])],
                        ["ids", "width", "item", "data"],
                    )

    return run


class _Block:
    """A block of candidates as postings by term."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.peak, self.width = ids, float(np.abs(data.astype(float)).max(initial=0)), len(data)
        often = 2 * np.count_nonzero(data, axis=1) > len(ids)
        self.dense, self.sparse = np.flatnonzero(often), [(t, rows, data[t][rows]) for t in np.flatnonzero(~often) if len(rows := np.flatnonzero(data[t]))]
        self.weights, self.kind = data[self.dense], None

    def scores(self, queries: np.ndarray, kind) -> np.ndarray:
        """Scores of a few queries, by term."""
        if self.kind is not kind:
            self.kind, self.weights = kind, self.weights.astype(kind)
        out = queries[:, self.dense].astype(kind) @ self.weights if len(self.dense) else np.zeros((len(queries), len(self.ids)), kind)
        for t, rows, weights in self.sparse:
            out[:, rows] += queries[:, t, None].astype(kind) * weights.astype(kind)
        return out


class _Best:
    """The best k of a block of queries among the candidates seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.peak = float(np.abs(queries.astype(float)).max(initial=0))
        self.order = np.argsort(ids)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def see(self, block: _Block) -> None:
        """Sums of `terms` products stay exact in floats up to their mantissa, then in 64-bit integers, then in Python's."""
        terms = max(1, min(block.width, self.queries.shape[1]))
        peak = block.peak * self.peak * terms
        kind = np.float32 if peak < 2**23 else np.float64 if peak < 2**52 else np.int64 if peak < 2**62 else object
        low = -int(peak) - 1
        queries = self.queries[:, : block.width]
        if queries.shape[1] < block.width:
            queries = np.pad(queries, ((0, 0), (0, block.width - queries.shape[1])))
        spot = np.minimum(np.searchsorted(self.ids, block.ids, sorter=self.order), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[self.order[spot]] == block.ids)
        row = self.order[spot[own]]
        for at in range(0, len(self.ids), _TILE):
            scores = block.scores(queries[at : at + _TILE], kind)
            here = (row >= at) & (row < at + _TILE)
            scores[row[here] - at, own[here]] = low
            for i, line in enumerate(scores, at):
                self._merge(i, line, block.ids, low)

    def _merge(self, i: int, scores: np.ndarray, ids: np.ndarray, low: int) -> None:
        """`low` marks the query itself."""
        had, names = self.held[i]
        if len(had) < self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k] if len(scores) > self.k else low
        else:
            least = min(max(int(had[-1]), low), -low)
        # A Python number keeps the comparison in the type of the scores.
        keep = np.flatnonzero(scores >= (float(least) if scores.dtype.kind == "f" else least))
        keep = keep[scores[keep] > low]
        if not len(keep):
            return
        found = scores[keep] if scores.dtype == object else scores[keep].astype(np.int64)
        had, names = np.concatenate([had, found]), np.concatenate([names, ids[keep]])
        best = np.lexsort((names, -had))[: self.k] if had.dtype != object else np.array(sorted(range(len(names)), key=lambda j: (-had[j], names[j]))[: self.k], int)
        self.held[i] = had[best], names[best]

    def rows(self) -> pa.RecordBatch:
        scores = [np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in x], np.int64) if x.dtype == object else x for x, _ in self.held]
        columns = np.repeat(self.ids, [len(x) for x in scores]), np.concatenate([n for _, n in self.held]), np.concatenate(scores)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])


def _unpacked(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Ids and integers by term of a packed block."""
    cell = lambda name: batch.column(prefix + name)[i]
    ids = np.frombuffer(cell("ids").as_buffer(), np.int64)
    return ids, np.frombuffer(cell("data").as_buffer(), f"i{cell('item').as_py()}").reshape(cell("width").as_py(), len(ids))


def _scorer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                this = batch.column("q_ids")[i].as_py()
                if this != name:
                    if best is not None:
                        yield best.rows()
                    ids, queries = _unpacked(batch, i, "q_")
                    name, best = this, _Best(ids.copy(), np.ascontiguousarray(queries.T), k)
                best.see(_Block(*_unpacked(batch, i)))
        if best is not None:
            yield best.rows()

    return run


def grid(candidates: int, queries: int, partitions: int, most_rows: int = 1 << 20) -> tuple[int, int]:
    """Lanes of candidates and groups of queries.

    Queries travel once a lane and candidates once a group, so that cells are
    limited by how many candidates there are for a query; a lane holds
    `most_rows` candidates at most.
    """
    ratio = candidates / max(1, queries)
    cells = min(partitions, max(8, math.ceil(1.5 * ratio)))
    lanes = max(1, min(cells, round(math.sqrt(cells * ratio))), math.ceil(candidates / most_rows))
    return lanes, max(1, cells // lanes)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = 10_000, query_block: int = 2048) -> DataFrame:
    """The k candidates of highest integer inner product for each query.

    `vectors` and `queries` have vec_id and embedding. Components become
    floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go
    to the smaller vec_id, and rows with the query's own vec_id are passed over.

    Null ids, null vectors and vectors with a null or non-finite component take
    no part, as query or candidate. Missing trailing components count as zero;
    an empty vector scores 0. Repeated candidate rows each count; a repeated
    query id is answered once per distinct id (the smallest vector decides).
    Fewer than k candidates give fewer rows; empty tables give none. Scores
    beyond 64 bits are clipped to that range. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = pick(queries).where(F.col("vec_id").isNotNull() & usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stage(asked.mapInArrow(_packer(scale, query_block), _BLOB), "queries")
    many = int(asked.agg(F.sum(F.length("ids") / 8)).first()[0] or 0)
    lanes, groups = grid(vectors.count(), many, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    cand = pick(vectors).mapInArrow(_packer(scale, block), _BLOB).withColumn("lane", dealt(lanes)).withColumn("team", every(groups))
    asked = asked.withColumn("lane", every(lanes)).withColumn("team", dealt(groups)).select("lane", "team", *(F.col(x).alias(f"q_{x}") for x in ("ids", "width", "item", "data")))
    # Merged by sort: each block of queries meets all blocks of its lane in a row, and neither side goes through the driver.
    best = asked.join(cand.hint("merge"), ["lane", "team"]).drop("lane", "team").mapInArrow(_scorer(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
