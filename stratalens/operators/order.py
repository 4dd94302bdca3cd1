"""Order dependencies (set-based and list-based) and sequential dependencies."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.options import pick, require, share
from .fd import Verdict


#: Right lists judged by one job.
_AT_ONCE = 50


def _ctx(context: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in context]) if context else F.struct(F.lit(0).alias("all"))


def swaps(df: DataFrame, context: Sequence[str], left: str, right: str, descending: bool = False) -> DataFrame:
    """Values of context and left whose smallest right lies below the largest right of a smaller left.

    Rows are first collapsed to the right extremes of each (context, left).
    Empty if the order compatibility context: left ~ right holds. Nulls equal
    one another and are smaller than any value.
    """
    k = pick(df, context, "context") if context else []
    r = F.struct(F.col(f"`{right}`").isNotNull().alias("some"), F.col(f"`{right}`").alias("v"))
    ext = df.groupBy(_ctx(k).alias("context"), F.col(f"`{left}`").alias("left")).agg(F.min(r).alias("lo"), F.max(r).alias("hi"))
    w = Window.partitionBy("context").orderBy(F.col("left").desc() if descending else F.col("left").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return ext.withColumn("before", F.max("hi").over(w)).where("before > lo").select("context", "left", F.col("lo.v").alias("lo"), F.col("before.v").alias("before"))


def _varying(df: DataFrame, context: Sequence[str], columns: Sequence[str]) -> set[str]:
    """Columns that have several values in some group of the context, in one job; a null is a value."""
    cell = lambda c: F.struct(F.col(f"`{c}`").isNotNull().alias("some"), F.col(f"`{c}`").alias("v"))
    groups = df.groupBy(_ctx(list(context)).alias("context")).agg(*[(F.min(cell(c)) != F.max(cell(c))).alias(f"d{i}") for i, c in enumerate(columns)])
    found = groups.agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(columns))]).first()
    return {c for i, c in enumerate(columns) if found[f"d{i}"]}


def _swapping(df: DataFrame, context: Sequence[str], left: str, rights: Sequence[str]) -> set[tuple[str, bool]]:
    """(right, descending) for which swaps() has a row, in one job for all of them."""
    cell = lambda c: F.struct(F.col(f"`{c}`").isNotNull().alias("some"), F.col(f"`{c}`").alias("v"))
    ends = [x for i, c in enumerate(rights) for x in (F.min(cell(c)).alias(f"lo{i}"), F.max(cell(c)).alias(f"hi{i}"))]
    ext = df.groupBy(_ctx(list(context)).alias("context"), F.col(f"`{left}`").alias("left")).agg(*ends)
    over = lambda by: Window.partitionBy("context").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    seen = {False: over(F.col("left").asc()), True: over(F.col("left").desc())}
    flags = {(c, down): f"s{i}{int(down)}" for i, c in enumerate(rights) for down in seen}
    rows = ext.select(*[(F.max(f"hi{i}").over(seen[down]) > F.col(f"lo{i}")).alias(flags[c, down]) for i, c in enumerate(rights) for down in seen])
    found = rows.agg(*[F.max(name).alias(name) for name in flags.values()]).first()
    return {key for key, name in flags.items() if found[name]}


def longest_kept(values: np.ndarray) -> np.ndarray:
    """Positions of a longest non-decreasing subsequence, by patience sorting."""
    tails: list[int] = []
    keys: list = []
    back = np.full(len(values), -1)
    from bisect import bisect_right

    for i, v in enumerate(values.tolist()):
        at = bisect_right(keys, v)
        back[i] = tails[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            keys.append(v)
        else:
            tails[at], keys[at] = i, v
    out = []
    i = tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return np.array(out[::-1], int)


def _removals(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["l", "r", "id"], kind="stable")
    keep = longest_kept(pdf["r"].to_numpy())
    return pdf.drop(pdf.index[keep])[["id"]]


def oc_removal_set(df: DataFrame, row_id: str, context: Sequence[str], left: str, right: str, descending: bool = False) -> DataFrame:
    """Ids of fewest rows without which context: left ~ right holds.

    Each context group is one task's: removal sets need its whole order. Groups
    without a swap are left out before. Columns of any orderable type become
    ranks within the context; nulls rank below any value.
    """
    k = pick(df, context, "context") if context else []
    bad = swaps(df, k, left, right, descending).select("context").distinct()
    rows = df.select(F.col(f"`{row_id}`").alias("id"), _ctx(k).alias("context"), F.col(f"`{left}`").alias("l"), F.col(f"`{right}`").alias("r")).join(bad, "context", "left_semi")
    rank = lambda by: F.dense_rank().over(Window.partitionBy("context").orderBy(by))
    codes = rows.select("id", "context", rank(F.col("l").desc() if descending else F.col("l").asc()).alias("l"), rank(F.col("r").asc()).alias("r"))
    return codes.withColumn("context", F.to_json("context")).groupBy("context").applyInPandas(_removals, f"id {df.schema[row_id].dataType.simpleString()}")


def ofd_removal_set(df: DataFrame, row_id: str, context: Sequence[str], right: str) -> DataFrame:
    """Ids of rows that don't have their context group's most frequent value (ties to the larger one)."""
    k = pick(df, context, "context") if context else []
    rows = df.select(F.col(f"`{row_id}`").alias("id"), _ctx(k).alias("context"), F.col(f"`{right}`").alias("r"))
    best = rows.groupBy("context", "r").count().groupBy("context").agg(F.max(F.struct("count", "r")).alias("m")).select(F.col("context").alias("c"), F.col("m.r").alias("top"))
    return rows.join(best, F.col("context") == F.col("c")).where(~F.col("r").eqNullSafe(F.col("top"))).select("id")


def verify_set_based(df: DataFrame, row_id: str, oc: tuple | None = None, ofd: tuple | None = None, error: float = 0.0, descending: bool = False) -> Verdict:
    """oc = (context, left, right) and/or ofd = (context, right): holds, error (removed rows over all), removed rows."""
    require(bool(oc or ofd), "give an oc or an ofd")
    parts = []
    if oc:
        parts.append(oc_removal_set(df, row_id, *oc, descending))
    if ofd:
        parts.append(ofd_removal_set(df, row_id, *ofd))
    gone = parts[0] if len(parts) == 1 else parts[0].union(parts[1]).distinct()
    n = df.agg(F.count("*").alias("n"))
    e = F.when(F.col("n") > 0, F.col("removed") / F.col("n")).otherwise(0.0)
    summary = gone.agg(F.count("*").alias("removed")).join(n).select((e <= error).alias("holds"), e.alias("error"), "removed")  # single rows
    return Verdict(summary, gone)


def mine_set_based(df: DataFrame, columns: Sequence[str] | None = None, max_context: int = 1, error: float = 0.0) -> DataFrame:
    """Canonical order dependencies: rows (kind, context, left, right, descending).

    kind 'ofd': context determines right. kind 'oc': within the context, left
    and right order rows alike (or oppositely). Contexts are minimal: none of a
    found one's supersets is reported, nor compatibilities of a column that the
    context already determines.
    """
    share(error, "error")
    cols = pick(df, columns)
    n = df.count()
    cached = df.select(*cols).withColumn("_id", F.monotonically_increasing_id()).persist()
    out: list[tuple] = []
    constant: dict[str, list[frozenset]] = {c: [] for c in cols}
    compatible: dict[tuple, list[frozenset]] = {}
    try:
        for size in range(max_context + 1):
            for ctx in map(frozenset, combinations(cols, size)):
                open_ = [a for a in cols if a not in ctx and not any(k <= ctx for k in constant[a])]
                if error == 0:
                    varying = _varying(cached, sorted(ctx), open_) if open_ else set()
                    held = [a for a in open_ if a not in varying]
                else:
                    held = [a for a in open_ if ofd_removal_set(cached, "_id", sorted(ctx), a).count() <= error * n]
                for a in held:
                    constant[a].append(ctx)
                    out.append(("ofd", sorted(ctx), None, a, False))
            for ctx in map(frozenset, combinations(cols, size)):
                pairs = [(a, b) for a, b in combinations(cols, 2) if not {a, b} & ctx and not any(k <= ctx for c in (a, b) for k in constant[c])]
                todo = [(a, b, down) for a, b in pairs for down in (False, True) if not any(k <= ctx for k in compatible.get((a, b, down), []))]
                if error == 0:
                    by: dict[str, list[str]] = {}
                    for a, b, _ in todo:
                        by.setdefault(a, []).append(b)
                    swapped = {(a, *key) for a, rights in by.items() for key in _swapping(cached, sorted(ctx), a, list(dict.fromkeys(rights)))}
                    fine = [t for t in todo if t not in swapped]
                else:
                    fine = [t for t in todo if oc_removal_set(cached, "_id", sorted(ctx), *t).count() <= error * n]
                for t in fine:
                    compatible.setdefault(t, []).append(ctx)
                    out.append(("oc", sorted(ctx), *t))
    finally:
        cached.unpersist()
    return df.sparkSession.createDataFrame(out, "kind string, context array<string>, left string, right string, descending boolean")


def orders(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """One row (valid, swap, merge): whether left lists order right lists strictly.

    s before t on the left must put s before t on the right: a merge (left
    differs, right equal) or a swap breaks it, a split doesn't. Rows with nulls
    in the lists are left out.
    """
    x, y = pick(df, left, "left"), pick(df, right, "right")
    whole = F.lit(True)
    for c in {*x, *y}:
        whole = whole & F.col(f"`{c}`").isNotNull()
    found = _ordered(df.where(whole), x, [y])
    a, b = F.col("swaps0"), F.col("merges0")
    return found.select(((a == 0) & (b == 0)).alias("valid"), (a > 0).alias("swap"), (b > 0).alias("merge"))


def _ordered(df: DataFrame, left: Sequence[str], rights: Sequence[Sequence[str]]) -> DataFrame:
    """One row of swaps<i> and merges<i>: values of the left list that break its order of the i-th right list."""
    s = lambda cols: F.struct(*[F.col(f"`{c}`") for c in cols])
    ends = [x for i, y in enumerate(rights) for x in (F.min(s(y)).alias(f"lo{i}"), F.max(s(y)).alias(f"hi{i}"))]
    ext = df.groupBy(s(left).alias("x")).agg(*ends)
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    seen = ext.select(*[x for i in range(len(rights)) for x in (F.col(f"lo{i}"), F.max(f"hi{i}").over(w).alias(f"before{i}"))])
    before, lo = (lambda i: F.col(f"before{i}")), (lambda i: F.col(f"lo{i}"))
    return seen.agg(*[x for i in range(len(rights)) for x in (F.count_if(before(i) > lo(i)).alias(f"swaps{i}"), F.count_if(before(i) == lo(i)).alias(f"merges{i}"))])


def mine_list_based(df: DataFrame, columns: Sequence[str] | None = None, max_size: int = 2) -> DataFrame:
    """Minimal list-based order dependencies: rows (lhs, rhs) of disjoint column lists.

    A right side is dropped if a prefix of it is already ordered by the same
    left side, or if a swap was seen for one of its prefixes; a longer left side
    is tried only where the shorter failed by merges alone.
    """
    cols = pick(df, columns)
    whole = df.dropna(subset=cols).select(*cols).persist()
    out, state = [], {}
    try:
        for total in range(2, max_size + 2):
            for ln in range(1, total):
                rn = total - ln
                if ln > max_size or rn > max_size:
                    continue
                for x in permutations(cols, ln):
                    open_ = []
                    for y in permutations([c for c in cols if c not in x], rn):
                        prefixes = [state.get((x, y[:i])) for i in range(1, rn)]
                        shorter = [state.get((x[:i], y)) for i in range(1, ln)]
                        if not any(p in ("valid", "swap") for p in (*prefixes, *shorter)):
                            open_.append(y)
                    for at in range(0, len(open_), _AT_ONCE):
                        some = open_[at : at + _AT_ONCE]
                        r = _ordered(whole, x, some).first()
                        for i, y in enumerate(some):
                            state[x, y] = "swap" if r[f"swaps{i}"] else "merge" if r[f"merges{i}"] else "valid"
                            if state[x, y] == "valid":
                                out.append((list(x), list(y)))
    finally:
        whole.unpersist()
    return df.sparkSession.createDataFrame(out, "lhs array<string>, rhs array<string>")


def gap_cost(gap: float, low: float, high: float) -> float:
    """Insertions (at least) that split a gap into parts within [low, high]; infinite if none do."""
    if gap < 0:
        return math.inf
    if low <= gap <= high:
        return 0
    if high == math.inf or gap < low:
        return math.inf
    parts = math.ceil(gap / high) if high > 0 else math.inf
    return parts - 1 if parts != math.inf and parts * low <= gap else math.inf


def sequence_edits(y: Sequence[float], low: float, high: float) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Fewest deletions and insertions so that neighbours' gaps lie within [low, high]: (ops, deleted, insertion places)."""
    n = len(y)
    best, back = [0.0] * n, [-1] * n
    for j in range(n):
        best[j] = j  # all before deleted
        for i in range(j):
            c = best[i] + (j - i - 1) + gap_cost(y[j] - y[i], low, high)
            if c < best[j]:
                best[j], back[j] = c, i
    ops, end = min(((best[j] + n - 1 - j, -j) for j in range(n)), default=(0, 0))
    j, kept = -end, []
    while n and j >= 0:
        kept.append(j)
        j = back[j]
    kept.reverse()
    inserted = [(a, b) for a, b in zip(kept[:-1], kept[1:], strict=True) if gap_cost(y[b] - y[a], low, high) > 0]
    return int(ops), [i for i in range(n) if i not in set(kept)], inserted


def verify_sequential(df: DataFrame, order_by: str, value: str, low: float, high: float, group: Sequence[str] = ()) -> DataFrame:
    """Per group (all rows as one without `group`): n, ops, confidence and the rows to delete, in order of order_by.

    high = -1 means no upper bound. A sequence whose gaps all fit is answered
    by a window alone; only others are edited, each in one task.
    """
    g2 = math.inf if high == -1 else float(high)
    require(0 <= low <= g2 and g2 > 0, "need 0 <= low <= high and a positive high")
    k = pick(df, list(group), "group") if group else []
    rows = df.select(_ctx(k).alias("g"), F.col(f"`{order_by}`").alias("x"), F.col(f"`{value}`").cast("double").alias("y"))
    gap = F.col("y") - F.lag("y").over(Window.partitionBy("g").orderBy("x", "y"))
    fits = rows.withColumn("gap", gap).groupBy("g").agg(F.count("*").alias("n"), F.count_if((F.col("gap") < low) | (F.col("gap") > g2)).alias("bad"))
    fine = fits.where("bad = 0").select("g", "n", F.lit(0).cast("long").alias("ops"), F.lit(1.0).alias("confidence"), F.array().cast("array<long>").alias("deleted"))

    def edit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(["x", "y"], kind="stable")["y"].tolist()
        ops, gone, _ = sequence_edits(y, low, g2)
        return pd.DataFrame({"gj": [pdf["gj"].iloc[0]], "n": [len(y)], "ops": [ops], "confidence": [(len(y) - ops) / len(y)], "deleted": [gone]})

    bad = rows.join(fits.where("bad > 0").select("g"), "g", "left_semi").withColumn("gj", F.to_json("g")).select("gj", "x", "y")
    edited = bad.groupBy("gj").applyInPandas(edit, "gj string, n long, ops long, confidence double, deleted array<long>")
    return fine.select(F.to_json("g").alias("group"), "n", "ops", "confidence", "deleted").unionByName(edited.withColumnRenamed("gj", "group"))
