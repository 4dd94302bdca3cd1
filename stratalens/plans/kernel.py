"""Group-count algebra: what a table's attribute sets say through the sizes of their groups.

Counts of many attribute sets come from one job each batch: rows are first
collapsed to distinct tuples with counts, then expanded by GROUPING SETS, so
the expansion works on what is left after the first aggregation. NULL groups
with NULL; grouping_id tells a NULL value from a column that isn't grouped.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 12
SAMPLE_ROWS = 20_000


@dataclass(frozen=True)
class GroupStats:
    """Sums over the groups of one attribute set; c is a group's size."""

    groups: int
    pairs: int  # sum of c (c - 1) / 2: unordered pairs of equal rows
    squares: float  # sum of c * c
    log_sum: float  # sum of c ln c
    largest: int


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where Spark groups values together: NULL with NULL, NaN with NaN, 0.0 with -0.0."""
    if pa.types.is_nested(values.type):
        seen: dict[str, int] = {}
        return np.array([seen.setdefault(repr(x), len(seen)) for x in values.to_pylist()], np.int64)
    if pa.types.is_floating(values.type):
        values = pc.add(values, pa.scalar(0.0, values.type))
    coded = pc.dictionary_encode(values, null_encoding="encode").combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(values) else np.zeros(0, np.int64)


class Lattice:
    """Group statistics of attribute sets of one table, kept once computed.

    Sets are bit masks over `columns`. A bounded sample of rows refutes exact
    dependencies without a job: what fails on some rows fails on all.
    """

    def __init__(self, df: DataFrame, columns: list[str], sample_rows: int = SAMPLE_ROWS):
        self.columns = columns
        self.df = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
        self.names = [f"c{i}" for i in range(len(columns))]
        self.known: dict[int, GroupStats] = {}
        self.rows = self.df.count()
        self.known[0] = GroupStats(1 if self.rows else 0, self.rows * (self.rows - 1) // 2, float(self.rows) ** 2, self.rows * np.log(max(1, self.rows)), self.rows)
        self._sample_rows = sample_rows
        self._codes: np.ndarray | None = None
        self._sample_groups: dict[int, np.ndarray] = {}

    def members(self, mask: int) -> list[int]:
        return [i for i in range(len(self.names)) if mask >> i & 1]

    def named(self, mask: int) -> list[str]:
        return [self.columns[i] for i in self.members(mask)]

    def stats(self, masks: Iterable[int]) -> dict[int, GroupStats]:
        masks = list(dict.fromkeys(masks))
        missing = [m for m in masks if m not in self.known]
        for at in range(0, len(missing), BATCH):
            self._count(missing[at : at + BATCH])
        return {m: self.known[m] for m in masks}

    def _count(self, masks: list[int]) -> None:
        used = [self.names[i] for i in sorted({i for m in masks for i in self.members(m)})]
        tuples = self.df.groupBy(*used).agg(F.count(F.lit(1)).alias("c"))
        if len(masks) == 1:
            groups = tuples.withColumn("gid", F.lit(0).cast("long"))
        else:
            sets = [[F.col(self.names[i]) for i in self.members(m)] for m in masks]
            groups = tuples.groupingSets(sets, *[F.col(c) for c in used]).agg(F.sum("c").alias("c"), F.grouping_id().alias("gid"))
        c = F.col("c").cast("double")
        rows = groups.groupBy("gid").agg(
            F.count("*").alias("groups"), F.sum(F.expr("c * (c - 1) div 2")).alias("pairs"), F.sum(c * c).alias("squares"), F.sum(c * F.log(c)).alias("log_sum"), F.max("c").alias("largest"),
        ).collect()
        by = {r["gid"]: r for r in rows}
        for m in masks:
            own = {self.names[i] for i in self.members(m)}
            gid = 0 if len(masks) == 1 else sum(1 << (len(used) - 1 - k) for k, name in enumerate(used) if name not in own)
            r = by.get(gid)
            self.known[m] = GroupStats(r["groups"], int(r["pairs"]), r["squares"], r["log_sum"], r["largest"]) if r else GroupStats(0, 0, 0.0, 0.0, 0)

    # The sample: value codes of a bounded number of rows.

    def _group_codes(self, mask: int) -> np.ndarray:
        if self._codes is None:
            share = min(1.0, 1.5 * self._sample_rows / max(1, self.rows))
            some = (self.df if share >= 1 else self.df.sample(share, seed=7)).limit(self._sample_rows).toArrow()
            self._codes = np.array([_codes(some[c]) for c in self.names]).reshape(len(self.names), -1)
        found = self._sample_groups.get(mask)
        if found is None:
            if mask == 0:
                found = np.zeros(self._codes.shape[1], np.int64)
            else:
                low = mask & -mask
                rest, code = self._group_codes(mask ^ low), self._codes[low.bit_length() - 1]
                found = np.unique(rest * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
            self._sample_groups[mask] = found
        return found

    def refuted(self, lhs: int, rhs: int) -> bool:
        """Whether sampled rows alone show that lhs does not determine rhs."""
        x, xa = self._group_codes(lhs), self._group_codes(lhs | rhs)
        return len(x) > 0 and int(xa.max()) > int(x.max())

    def repeated(self, mask: int) -> bool:
        """Whether sampled rows alone show that the set is not unique."""
        x = self._group_codes(mask)
        return len(x) > 0 and int(x.max()) + 1 < len(x)
