"""Conditional functional dependencies."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import pick, require
from .fd import Verdict

WILDCARD = "_"
Item = tuple[str, str]


def verify(df: DataFrame, left: Sequence[Item], right: Item, min_support: int = 1, min_confidence: float = 1.0) -> Verdict:
    """Whether rows that match the left pattern determine the right one.

    Items are (column, constant or '_'). Support is the number of rows matching
    the left constants; with a wildcard on the right, each left group's most
    frequent value is right. violations: a row per left group with wrong rows.
    """
    x = pick(df, [c for c, _ in left], "left")
    (a,) = pick(df, [right[0]], "right")
    match = F.lit(True)
    for c, v in left:
        if v != WILDCARD:
            match = match & F.coalesce(F.col(f"`{c}`").cast("string") == v, F.lit(False))
    key = F.struct(*[F.col(f"`{c}`") for c in x]) if x else F.struct(F.lit(0).alias("all"))
    cells = df.where(match).groupBy(key.alias("lhs"), F.col(f"`{a}`").cast("string").alias("value")).agg(F.count("*").alias("c"))
    good = F.max("c") if right[1] == WILDCARD else F.coalesce(F.sum(F.when(F.col("value") == right[1], F.col("c"))), F.lit(0))
    groups = cells.groupBy("lhs").agg(F.sum("c").alias("size"), good.alias("good"))
    summary = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("support"), F.coalesce(F.sum("good") / F.sum("size"), F.lit(0.0)).alias("confidence"))
    holds = (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
    bad = groups.where("good < size").select("lhs", "size", (F.col("size") - F.col("good")).alias("violating_rows"))
    return Verdict(summary.select(holds.alias("holds"), "support", "confidence"), bad)


def mine(df: DataFrame, columns: Sequence[str] | None = None, min_support: int = 2, min_confidence: float = 1.0, max_lhs: int = 1) -> DataFrame:
    """Conditional dependencies with enough support and confidence: rows (lhs map, rhs_column, rhs_value, support, confidence).

    Left sides mix constants and wildcards over up to `max_lhs` columns. A rule
    is left out if a more general exact rule, with fewer items or wildcards in
    place of constants, already covers it.
    """
    require(min_support >= 1, "min_support must be positive")
    cols = pick(df, columns)
    narrow = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).persist()
    out: list[tuple[dict, str, str, int, float]] = []

    def covered(lhs: dict, a: str, value: str) -> bool:
        for other, b, v, _, conf in out:
            if b == a and conf == 1.0 and v in (value, WILDCARD) and all(c in lhs and w in (lhs[c], WILDCARD) for c, w in other.items()):
                if other != lhs or v != value:
                    return True
        return False

    try:
        for size in range(max_lhs + 1):
            for xs in combinations(cols, size):
                for a in cols:
                    if a in xs:
                        continue
                    cells = narrow.groupBy(*xs, a).agg(F.count("*").alias("c"))
                    key = F.struct(*xs) if xs else F.struct(F.lit(0).alias("all"))
                    groups = cells.groupBy(key.alias("x")).agg(F.sum("c").alias("s"), F.max("c").alias("top"), F.max_by(a, "c").alias("best"))
                    for k in range(size, -1, -1):  # more wildcards first: more general
                        for wild in combinations(xs, k):
                            fixed = [c for c in xs if c not in wild]
                            if not fixed:
                                r = groups.agg(F.sum("s").alias("s"), F.sum("top").alias("t")).collect()
                            else:
                                by = groups.groupBy(*[F.col(f"x.`{c}`").alias(c) for c in fixed]).agg(F.sum("s").alias("s"), F.sum("top").alias("t"))
                                r = by.where((F.col("s") >= min_support) & (F.col("t") >= min_confidence * F.col("s"))).collect()
                            for g in r:
                                if not g["s"] or g["s"] < min_support or g["t"] < min_confidence * g["s"] or any(g[c] is None for c in fixed):
                                    continue
                                lhs = {c: WILDCARD for c in wild} | {c: g[c] for c in fixed}
                                if k and not covered(lhs, a, WILDCARD):
                                    out.append((lhs, a, WILDCARD, g["s"], g["t"] / g["s"]))
                    const = groups.where((F.col("s") >= min_support) & (F.col("top") >= min_confidence * F.col("s")) & F.col("best").isNotNull()).collect()
                    for g in const:
                        lhs = {c: g["x"][c] for c in xs}
                        if all(v is not None for v in lhs.values()) and not covered(lhs, a, g["best"]):
                            out.append((lhs, a, g["best"], g["s"], g["top"] / g["s"]))
    finally:
        narrow.unpersist()
    return df.sparkSession.createDataFrame(out, "lhs map<string,string>, rhs_column string, rhs_value string, support long, confidence double")
