"""Pipelines built from dependencies: typo mining, deduplication and anomaly comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.options import pick
from . import fd, pairs


def near_dependencies(df: DataFrame, columns: Sequence[str] | None = None, error: float = 0.05, max_lhs: int = 1) -> list[tuple[tuple[str, ...], str, float]]:
    """Dependencies that hold but for few pairs and not exactly: candidates for typos."""
    names = pick(df, columns)
    exact = {f for f, _ in fd.mine(df, columns, max_lhs)}
    return [(tuple(names[i] for i in f.lhs), names[f.rhs], e) for f, e in fd.mine(df, columns, max_lhs, error) if f not in exact and e > 0]


def typos(df: DataFrame, lhs: Sequence[str], rhs: str, radius: int = 3, ratio: float = 0.1) -> DataFrame:
    """(lhs, value, n, likely, likely_n): rare right values within `radius` edits of their group's most frequent one."""
    x = F.struct(*[F.col(f"`{c}`") for c in lhs])
    cells = df.groupBy(x.alias("lhs"), F.col(f"`{rhs}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = cells.groupBy("lhs").agg(F.max(F.struct("n", "value")).alias("m")).select(F.col("lhs").alias("k"), F.col("m.value").alias("likely"), F.col("m.n").alias("likely_n"))
    both = cells.join(top, F.col("lhs") == F.col("k"))
    near = (F.col("value") != F.col("likely")) & (F.levenshtein("value", "likely") <= radius) & (F.col("n") <= ratio * F.col("likely_n"))
    return both.where(near).select("lhs", "value", "n", "likely", "likely_n")


def duplicate_pairs(df: DataFrame, row_id: str, keys: Sequence[str], columns: Sequence[str], window: int = 4, min_equal: int = 2) -> DataFrame:
    """(first, second, equal): rows at most window - 1 apart in key order that agree on min_equal columns or more.

    Neighbourhoods run inside blocks of the first key, so no task orders the table.
    """
    block, *rest = keys
    w = Window.partitionBy(F.col(f"`{block}`")).orderBy(*[F.col(f"`{c}`") for c in [*rest, row_id]])
    rows = df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{block}`"), *[F.col(f"`{c}`") for c in dict.fromkeys([*rest, row_id, *columns]) if c != block])
    cells = F.struct(*[F.col(f"`{c}`") for c in columns])
    out = rows.select("id", cells.alias("mine"), *[F.struct(F.lag("id", k).over(w).alias("id"), F.lag(cells, k).over(w).alias("cells")).alias(f"p{k}") for k in range(1, window)])
    near = out.select("id", "mine", F.explode(F.array(*[f"p{k}" for k in range(1, window)])).alias("p")).where("p.id is not null")
    equal = sum((F.col(f"mine.`{c}`").eqNullSafe(F.col(f"p.cells.`{c}`")).cast("int") for c in columns), F.lit(0))
    return near.select(F.col("p.id").alias("first"), F.col("id").alias("second"), equal.alias("equal")).where(F.col("equal") >= min_equal)


def lost_dependencies(before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None, max_lhs: int = 1) -> DataFrame:
    """(lhs, rhs, error): minimal dependencies of `before` that no longer hold in `after`, with their error there."""
    names = pick(before, columns)
    rows = []
    for f, _ in fd.mine(before, columns, max_lhs):
        lhs = [names[i] for i in f.lhs]
        r = fd.verify(after, lhs, [names[f.rhs]]).summary.first()
        if not r["holds"]:
            rows.append((lhs, names[f.rhs], float(r["error"])))
    return before.sparkSession.createDataFrame(rows, "lhs array<string>, rhs string, error double")


def rows_breaking(df: DataFrame, constraint: str, row_id: str) -> DataFrame:
    """(id, n): rows by how many violating pairs of a denial constraint they take part in."""
    found = pairs.violations(df, constraint, row_id)
    return found.select(F.explode(F.array("first", "second")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
