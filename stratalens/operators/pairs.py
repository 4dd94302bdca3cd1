"""Patterns over pairs of rows: denial, differential, matching and metric dependencies.

Equalities become join keys and single inequalities grouped extremes wherever
the pattern allows; general theta conditions pair rows, which is quadratic in
the size of a join group by nature.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import similarity
from ..plans.options import pick, require
from .fd import Verdict

_OPS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}
_NEGATED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_FLIPPED = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Term:
    """One side of a predicate: a tuple's column, or a constant where `tuple` is empty."""

    tuple: str
    value: str


@dataclass(frozen=True)
class Predicate:
    left: Term
    op: str
    right: Term


def parse_dc(text: str, columns: Sequence[str]) -> list[Predicate]:
    """Predicates of a denial constraint like `!(t.A == s.A and t.B < s.B)`; columns by name or position."""
    body = re.fullmatch(r"\s*!\s*\((.*)\)\s*", text, re.S)
    require(body is not None, "a denial constraint has the form !(... and ...)")

    def term(s: str) -> Term:
        m = re.fullmatch(r"([ts])\.(.+)", s.strip())
        if not m:
            return Term("", s.strip().strip("'\""))
        name = m[2].strip()
        if name not in columns and name.isdigit():
            require(int(name) < len(columns), f"no column {name}")
            name = columns[int(name)]
        require(name in columns, f"no column {name}")
        return Term(m[1], name)

    out = []
    for part in re.split(r"\s+and\s+|&", body[1], flags=re.I):
        m = re.fullmatch(r"\s*(.+?)\s*(==|!=|<=|>=|<|>)\s*(.+?)\s*", part, re.S)
        require(m is not None, f"not a predicate: {part}")
        out.append(Predicate(term(m[1]), m[2], term(m[3])))
    require(bool(out), "no predicates")
    return out


def _condition(p: Predicate, t: Callable[[str], Column], s: Callable[[str], Column]) -> Column:
    side = lambda x: F.lit(x.value) if not x.tuple else (t if x.tuple == "t" else s)(x.value)
    return _OPS[p.op](side(p.left), side(p.right))


def violations(df: DataFrame, constraint: str, row_id: str) -> DataFrame:
    """Pairs (first, second) of row ids that satisfy all predicates of the constraint; single rows appear as (id, id).

    Rows with a null or empty cell in a used column are skipped.
    """
    preds = parse_dc(constraint, df.columns)
    used = list(dict.fromkeys(x.value for p in preds for x in (p.left, p.right) if x.tuple))
    tuples = {x.tuple for p in preds for x in (p.left, p.right) if x.tuple}
    rows = df
    for c in used:
        cell = F.col(f"`{c}`")
        rows = rows.where(cell.isNotNull() & (cell.cast("string") != ""))
    if len(tuples) <= 1:
        col = lambda c: F.col(f"`{c}`")
        for p in preds:
            rows = rows.where(_condition(p, col, col))
        return rows.select(F.col(f"`{row_id}`").alias("first"), F.col(f"`{row_id}`").alias("second"))
    a = rows.select(F.col(f"`{row_id}`").alias("t_id"), *[F.col(f"`{c}`").alias(f"t_{i}") for i, c in enumerate(used)])
    b = rows.select(F.col(f"`{row_id}`").alias("s_id"), *[F.col(f"`{c}`").alias(f"s_{i}") for i, c in enumerate(used)])
    on = F.col("t_id") != F.col("s_id")
    for p in preds:
        on = on & _condition(p, lambda c: F.col(f"t_{used.index(c)}"), lambda c: F.col(f"s_{used.index(c)}"))
    return a.join(b, on).select(F.col("t_id").alias("first"), F.col("s_id").alias("second"))


def verify_dc(df: DataFrame, constraint: str, row_id: str | None = None) -> DataFrame:
    """One row (holds). The plan follows the predicates' shape.

    Equalities alone: grouped counts. Equalities and one inequality of a column
    with itself: grouped extremes. Equalities and two such inequalities: a
    running extreme per group. Single-tuple constraints: a filter. Else pairs.
    """
    preds = parse_dc(constraint, df.columns)
    two = {x.tuple for p in preds for x in (p.left, p.right) if x.tuple} == {"t", "s"}
    same = all(p.left.tuple and p.right.tuple and p.left.tuple != p.right.tuple and p.left.value == p.right.value for p in preds)
    keys = [p.left.value for p in preds if p.op == "=="]
    rest = [p if p.left.tuple == "t" else Predicate(p.right, _FLIPPED[p.op], p.left) for p in preds if p.op != "=="]
    if two and same and len(rest) <= 2 and all(p.op != "!=" for p in rest[1:]) and not (len(rest) == 2 and rest[0].op == "!="):
        rows = df
        for c in {p.left.value for p in preds}:
            cell = F.col(f"`{c}`")
            rows = rows.where(cell.isNotNull() & (cell.cast("string") != ""))
        group = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)] or [F.lit(0).alias("k0")]
        if not rest:
            bad = rows.groupBy(*group).count().where("count > 1")
        elif len(rest) == 1:
            c = F.col(f"`{rest[0].left.value}`")
            strict = rest[0].op in ("<", ">", "!=")
            ext = rows.groupBy(*group).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("n"))
            bad = ext.where("lo < hi" if strict else "n > 1")
        else:
            from pyspark.sql import Window

            x, y = (F.col(f"`{p.left.value}`") for p in rest)
            up, strict = rest[0].op[0] == "<", [p.op in ("<", ">") for p in rest]
            want_low = rest[1].op[0] == ">"  # the t row, first by x, must have the larger (or smaller) y
            w = Window.partitionBy(*[f"k{i}" for i in range(max(1, len(keys)))]).orderBy(F.col("x").asc() if up else F.col("x").desc())
            cells = rows.groupBy(*group, x.alias("x")).agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.count("*").alias("n"))
            before = (F.max("hi") if want_low else F.min("lo")).over(w.rowsBetween(Window.unboundedPreceding, -1))
            mine = F.col("lo") if want_low else F.col("hi")
            beats = (lambda p, q: p > q) if want_low else (lambda p, q: p < q)
            test = beats(F.col("b"), F.col("m")) if strict[1] else beats(F.col("b"), F.col("m")) | (F.col("b") == F.col("m"))
            if not strict[0]:
                test = test | ((F.col("n") > 1) if not strict[1] else (F.col("lo") < F.col("hi")))
            bad = cells.withColumn("b", before).withColumn("m", mine).where(test)
        return bad.agg((F.count("*") == 0).alias("holds"))
    with_id = df if row_id else df.withColumn("_row", F.monotonically_increasing_id())
    return violations(with_id, constraint, row_id or "_row").agg((F.count("*") == 0).alias("holds"))


def _distance(df: DataFrame, column: str) -> Callable[[Column, Column], Column]:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return lambda a, b: F.levenshtein(a, b).cast("double")
    if isinstance(kind, T.DateType | T.TimestampType):
        return similarity.date_distance
    return similarity.number_distance


Limits = Mapping[str, tuple[float, float]]


_WORD = 62


def _flags(conditions: Sequence[Column]) -> list[Column]:
    """Conditions as bits of as many longs b0, b1, ... as they need."""
    out = []
    for at in range(0, max(1, len(conditions)), _WORD):
        bits = F.lit(0).cast("long")
        for i, c in enumerate(conditions[at : at + _WORD]):
            bits = bits + F.when(c, F.lit(1 << i)).otherwise(0).cast("long")
        out.append(bits.alias(f"b{at // _WORD}"))
    return out


def _by_flags(pairs: DataFrame, conditions: Sequence[Column], n: Column) -> list[tuple[int, int]]:
    """(bits, pairs) of all combinations of conditions that some pair has."""
    flags = _flags(conditions)
    names = [f"b{i}" for i in range(len(flags))]
    found = pairs.select(*flags, n.alias("n")).groupBy(*names).agg(F.sum("n").alias("n")).where("n > 0").collect()
    return [(sum(r[b] << _WORD * i for i, b in enumerate(names)), r["n"]) for r in found]


def _distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(v, n, k): distinct rows of some columns as a struct, how often each occurs, and a hash that orders them."""
    v = F.struct(*[F.col(f"`{c}`") for c in columns])
    return df.groupBy(v.alias("v")).agg(F.count("*").alias("n")).withColumn("k", F.xxhash64("v"))


def _near(rows: DataFrame, column: str, kind: T.DataType, width: float) -> DataFrame:
    """Pairs (a, b) of distinct rows whose values of a number or date column are at most `width` apart: bands of that width join their neighbours."""
    cell = F.col(f"v.`{column}`")
    cell = F.datediff(cell, F.lit("1970-01-01")) if isinstance(kind, (T.DateType, T.TimestampType)) else cell.cast("double")
    band = F.floor(cell / F.lit(float(width))) if width > 0 else cell
    whole = F.struct(*rows.columns)
    # Two bands to each side, as quotients are rounded.
    near = F.explode(F.sequence(band - 2, band + 2)) if width > 0 else band
    return rows.where(cell.isNotNull()).select(whole.alias("a"), near.alias("band")).join(rows.select(whole.alias("b"), band.alias("band")), "band").drop("band")


def _distance_pairs(df: DataFrame, limits: Mapping[str, Sequence[tuple[float, float]]], metrics: Mapping[str, Callable] | None = None, near: tuple[str, float] | None = None) -> tuple[DataFrame, list[Column], Column]:
    """Unordered pairs of rows, which of the intervals hold, and how often the pair occurs; equal rows are paired by their counts.

    near: only pairs whose values of that column lie within that distance, found without pairing all rows.
    """
    cols = list(limits)
    rows = _distinct_rows(df, cols)
    both = _near(rows, near[0], df.schema[near[0]].dataType, near[1]) if near else rows.select(F.struct(*rows.columns).alias("a")).join(rows.select(F.struct(*rows.columns).alias("b")))
    pairs = both.where(F.col("a.k") <= F.col("b.k"))
    n = F.when(F.col("a.k") == F.col("b.k"), F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
    held = []
    for c in cols:
        custom = (metrics or {}).get(c)
        d = (similarity.pairwise(custom) if custom else _distance(df, c))(F.col(f"a.v.`{c}`"), F.col(f"b.v.`{c}`"))
        held += [(d >= low) & (d <= high) for low, high in limits[c]]
    return pairs, held, n


def verify_dd(df: DataFrame, lhs: Limits, rhs: Limits, metrics: Mapping[str, Callable] | None = None) -> DataFrame:
    """One row (holds, error, lhs_pairs, violating_pairs): pairs within all left intervals must be within the right ones."""
    for low, high in [*lhs.values(), *rhs.values()]:
        require(0 <= low <= high, "intervals need 0 <= low <= high")
    limits: dict[str, list] = {}
    where: list[tuple[str, int, bool]] = []
    for side, left in ((lhs, True), (rhs, False)):
        for c, interval in side.items():
            pick(df, [c])
            limits.setdefault(c, []).append(interval)
            where.append((c, len(limits[c]) - 1, left))
    # Numbers and dates of the left side bound which rows can be near; without any, all pairs are compared.
    banded = [(c, high) for c, (_, high) in lhs.items() if c not in (metrics or {}) and not isinstance(df.schema[c].dataType, T.StringType) and math.isfinite(high)]
    pairs, held, n = _distance_pairs(df, limits, metrics, banded[0] if banded else None)
    place = {(c, i): k for k, (c, i) in enumerate((c, i) for c, intervals in limits.items() for i in range(len(intervals)))}
    side_holds = lambda left: reduce(lambda x, y: x & y, (F.coalesce(held[place[c, i]], F.lit(False)) for c, i, is_left in where if is_left == left), F.lit(True))
    found = pairs.select(side_holds(True).alias("on_left"), side_holds(False).alias("on_right"), n.alias("n"))
    bad = F.col("on_left") & ~F.col("on_right")
    got = found.agg(F.coalesce(F.sum(F.when(F.col("on_left"), F.col("n"))), F.lit(0)).alias("lhs_pairs"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("violating_pairs"))
    error = F.when(F.col("lhs_pairs") > 0, F.col("violating_pairs") / F.col("lhs_pairs")).otherwise(0.0)
    return got.select((F.col("violating_pairs") == 0).alias("holds"), error.alias("error"), "lhs_pairs", "violating_pairs")


def mine_dds(df: DataFrame, limits: Mapping[str, Sequence[tuple[float, float]]], max_lhs: int = 2) -> DataFrame:
    """Differential dependencies over a table of candidate intervals: rows (lhs map, rhs_column, rhs interval text).

    A left side must be met by some pair. Reported are left sides none of whose
    wider or smaller ones implies the same right side, and of right intervals
    the narrowest.
    """
    cols = list(limits)
    index = [(c, i) for c in cols for i in range(len(limits[c]))]
    bit = {ci: 1 << k for k, ci in enumerate(index)}
    classes = _by_flags(*_distance_pairs(df, limits))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    out: list[tuple[dict, str, tuple]] = []
    for size in range(1, max_lhs + 1):
        for group in combinations(cols, size):
            choices = [[]]
            for c in group:
                choices = [[*x, (c, i)] for x in choices for i in sorted(range(len(limits[c])), key=lambda i: limits[c][i][0] - limits[c][i][1])]
            for x in choices:
                mask = sum(bit[ci] for ci in x)
                met = [b for b, _ in classes if b & mask == mask]
                if not met:
                    continue
                lhs = {c: limits[c][i] for c, i in x}
                for c in cols:
                    if c in group:
                        continue
                    valid = [i for i in range(len(limits[c])) if all(b & bit[c, i] for b in met)]
                    for i in valid:
                        r = limits[c][i]
                        if any(j != i and inside(limits[c][j], r) for j in valid):
                            continue
                        general = any(oc == c and inside(orr, r) and all(k in lhs and inside(lhs[k], v) for k, v in ol.items()) for ol, oc, orr in out)
                        if not general:
                            out.append((lhs, c, r))
    show = lambda p: f"[{p[0]};{p[1]}]"
    rows = [({c: show(v) for c, v in lhs.items()}, c, show(r)) for lhs, c, r in out]
    return df.sparkSession.createDataFrame(rows, "lhs map<string,string>, rhs_column string, rhs_interval string")


@dataclass(frozen=True)
class Match:
    """A column match of a matching dependency: similarity of left and right column at least `bound`."""

    left: str
    right: str
    measure: str | Callable = "levenshtein"
    bound: float = 1.0


def _similarity_table(left: DataFrame, right: DataFrame, m: Match) -> DataFrame:
    """(l, r, sim) over distinct values; number and date differences are normalised by the largest seen by the left value."""
    a = left.select(F.col(f"`{m.left}`").alias("l")).distinct()
    b = right.select(F.col(f"`{m.right}`").alias("r")).distinct()
    if m.measure == "equality":
        return a.join(b, F.col("l") == F.col("r")).withColumn("sim", F.lit(1.0))
    pairs = a.join(b, F.col("l").isNotNull() & F.col("r").isNotNull())
    if m.measure in ("number", "date"):
        from pyspark.sql import Window

        d = (similarity.number_distance if m.measure == "number" else similarity.date_distance)(F.col("l"), F.col("r"))
        top = F.max("d").over(Window.partitionBy("l"))
        return pairs.withColumn("d", d).withColumn("sim", F.when(top == 0, 1.0).otherwise(1 - F.col("d") / top)).drop("d")
    return pairs.withColumn("sim", similarity.measure(m.measure)(F.col("l"), F.col("r")))


def _matched(left: DataFrame, right: DataFrame, lhs: Sequence[Match], rhs: Match) -> DataFrame:
    """Row pairs that meet all left matches, with the right similarity; rows are joined over value tables."""
    cols_l, cols_r = list(dict.fromkeys([*(m.left for m in lhs), rhs.left])), list(dict.fromkeys([*(m.right for m in lhs), rhs.right]))
    a = left.groupBy(*[F.col(f"`{c}`").alias(f"l_{c}") for c in cols_l]).agg(F.count("*").alias("ln"))
    b = right.groupBy(*[F.col(f"`{c}`").alias(f"r_{c}") for c in cols_r]).agg(F.count("*").alias("rn"))
    pairs = a
    for i, m in enumerate(lhs):
        table = _similarity_table(left, right, m).where(F.col("sim") >= m.bound).select(F.col("l").alias(f"x{i}"), F.col("r").alias(f"y{i}"))
        if i == 0:
            pairs = pairs.join(table, F.col(f"l_{m.left}") == F.col("x0")).join(b, F.col("y0") == F.col(f"r_{m.right}"))
        else:
            pairs = pairs.join(table, (F.col(f"l_{m.left}") == F.col(f"x{i}")) & (F.col(f"r_{m.right}") == F.col(f"y{i}")))
    right_table = _similarity_table(left, right, rhs).select(F.col("l").alias("xr"), F.col("r").alias("yr"), "sim")
    return pairs.join(right_table, (F.col(f"l_{rhs.left}") == F.col("xr")) & (F.col(f"r_{rhs.right}") == F.col("yr")), "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def verify_md(left: DataFrame, right: DataFrame | None, lhs: Sequence[Match], rhs: Match) -> Verdict:
    """Whether rows similar on the left side are similar on the right one.

    summary: holds, true_rhs_bound (least right similarity of matched pairs, 1
    without any), matched_pairs. violations: value pairs below the bound.
    """
    right = left if right is None else right
    require(bool(lhs), "the left side needs a match")
    pairs = _matched(left, right, lhs, rhs)
    least = F.coalesce(F.min("sim"), F.lit(1.0))
    summary = pairs.agg((least >= rhs.bound).alias("holds"), least.alias("true_rhs_bound"), F.coalesce(F.sum(F.col("ln") * F.col("rn")), F.lit(0)).alias("matched_pairs"))
    return Verdict(summary, pairs.where(F.col("sim") < rhs.bound).drop("ln", "rn"))


def mine_mds(left: DataFrame, right: DataFrame | None, matches: Sequence[Match], bounds: Sequence[float] = (0.5, 0.75, 1.0), min_support: int = 1, max_lhs: int = 2, prune_nondisjoint: bool = True, level_definition: str = "cardinality") -> DataFrame:
    """Matching dependencies over the column matches: rows (lhs map, rhs, bound, support).

    Pairs of distinct rows are reduced to the vector of bound levels reached;
    the search runs on those vectors. Kept are, per right side, the highest
    bound and the most general left side. Without prune_nondisjoint, a right
    match may stand on the left too, with a lower bound. level_definition is
    the order of the search: by number of left matches ('cardinality') or by
    their levels together ('lattice'); the rules kept are the same. Matches of
    the same columns by several measures are told apart by the measure's name.
    """
    require(level_definition in ("cardinality", "lattice"), "level_definition must be cardinality or lattice")
    right = left if right is None else right
    cols_l, cols_r = list(dict.fromkeys(m.left for m in matches)), list(dict.fromkeys(m.right for m in matches))
    a = left.groupBy(*[F.col(f"`{c}`").alias(f"l_{c}") for c in cols_l]).agg(F.count("*").alias("ln"))
    b = right.groupBy(*[F.col(f"`{c}`").alias(f"r_{c}") for c in cols_r]).agg(F.count("*").alias("rn"))
    pairs = a.join(b)  # all pairs of distinct rows: the evidence itself
    names = []
    for i, m in enumerate(matches):
        t = _similarity_table(left, right, m).select(F.col("l").alias(f"x{i}"), F.col("r").alias(f"y{i}"), F.col("sim").alias(f"s{i}"))
        pairs = pairs.join(t, F.col(f"l_{m.left}").eqNullSafe(F.col(f"x{i}")) & F.col(f"r_{m.right}").eqNullSafe(F.col(f"y{i}")), "left")
        level = sum(((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) >= v).cast("int") for v in sorted(bounds)), F.lit(0))
        pairs = pairs.withColumn(f"v{i}", level)
        names.append(f"v{i}")
    classes = [(tuple(r[n] for n in names), r["n"]) for r in pairs.groupBy(*names).agg(F.sum(F.col("ln") * F.col("rn")).alias("n")).collect()]
    levels = sorted(bounds)
    same = Counter((m.left, m.right) for m in matches)
    measure = lambda m: m.measure if isinstance(m.measure, str) else getattr(m.measure, "__name__", "custom")
    label = lambda i: f"{matches[i].left}~{matches[i].right}" + (f":{measure(matches[i])}" if same[matches[i].left, matches[i].right] > 1 else "")
    sides: list[dict] = []
    for size in range(max_lhs + 1):
        for group in combinations(range(len(matches)), size):
            choices: list[dict] = [{}]
            for i in group:
                choices = [{**c, i: v} for c in choices for v in range(1, len(levels) + 1)]
            sides += choices
    if level_definition == "lattice":
        sides.sort(key=lambda lhs: sum(lhs.values()))
    out: list[tuple[dict, int, int, int]] = []
    for lhs in sides:
        met = [(v, n) for v, n in classes if all(v[i] >= k for i, k in lhs.items())]
        support = sum(n for _, n in met)
        if support < min_support or not met:
            continue
        for r in range(len(matches)):
            if r in lhs and prune_nondisjoint:
                continue
            top = min(v[r] for v, _ in met)
            if top > lhs.get(r, 0) and not any(orr == r and ot >= top and all(lhs.get(i, 0) >= k for i, k in ol.items()) for ol, orr, ot, _ in out):
                out.append((lhs, r, top, support))
    rows = [({label(i): levels[k - 1] for i, k in lhs.items()}, label(r), levels[t - 1], n) for lhs, r, t, n in out]
    return left.sparkSession.createDataFrame(rows, "lhs map<string,double>, rhs string, bound double, support long")


def _diameter(points: np.ndarray) -> float:
    """Largest distance of points in the plane: convex hull, then all pairs of its corners."""
    pts = np.unique(points, axis=0)
    if len(pts) < 2:
        return 0.0

    def chain(seq: np.ndarray) -> list:
        hull: list = []
        for p in seq:
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (p[1] - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (p[0] - hull[-2][0]):
                hull.pop()
            hull.append(p)
        return hull

    corners = np.array(chain(pts) + chain(pts[::-1])) if pts.shape[1] == 2 else pts
    return max(float(np.sqrt(((corners - c) ** 2).sum(1)).max()) for c in corners)


def verify_metric(df: DataFrame, lhs: Sequence[str], rhs: Sequence[str], parameter: float, metric: str = "euclidean", q: int = 2, null_is_infinite: bool = False) -> Verdict:
    """X ->(delta) Y: within a group of X all Y lie pairwise within `parameter`.

    One numeric column compares group extremes. Strings (levenshtein or q-gram
    cosine) compare distinct values of a group; several numeric columns take
    the diameter of the group's distinct points. violations: lhs, diameter.
    A null counts as infinitely far from other values if null_is_infinite, else
    it is passed over.
    """
    require(metric in ("euclidean", "levenshtein", "cosine"), "metric must be euclidean, levenshtein or cosine")
    require(parameter >= 0, "parameter must not be negative")
    x, y = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    key = F.struct(*[F.col(f"`{c}`") for c in x])
    null_rule = (lambda g: F.when((F.col("nulls") > 0) & (F.col("n") > 1), float("inf")).otherwise(g)) if null_is_infinite else (lambda g: g)
    rows = df.select(key.alias("lhs"), *[F.col(f"`{c}`").alias(f"y{i}") for i, c in enumerate(y)])
    count = [F.count("*").alias("n"), F.count_if(F.col("y0").isNull()).alias("nulls")]
    if metric == "euclidean" and len(y) == 1:
        groups = rows.groupBy("lhs").agg(F.coalesce(F.max("y0") - F.min("y0"), F.lit(0)).cast("double").alias("d"), *count)
    elif metric == "euclidean":
        points = rows.groupBy("lhs").agg(F.collect_set(F.array(*[F.col(f"y{i}").cast("double") for i in range(len(y))])).alias("points"), *count)

        @F.pandas_udf("double")
        def diameter(col: pd.Series) -> pd.Series:
            return col.map(lambda p: _diameter(np.array([list(v) for v in p if not any(c is None for c in v)], float)) if len(p) > 1 else 0.0)

        groups = points.select("lhs", "n", "nulls", diameter("points").alias("d"))
    else:
        require(len(y) == 1, "string metrics take one column")
        dist = (lambda a, b: F.levenshtein(a, b).cast("double")) if metric == "levenshtein" else similarity.pairwise(lambda a, b: similarity.qgram_cosine_distance(a, b, q))
        values = rows.where("y0 is not null").groupBy("lhs", "y0").agg(F.count("*").alias("c"))
        a, b = values.select("lhs", F.col("y0").alias("a")), values.select(F.col("lhs").alias("other"), F.col("y0").alias("b"))
        far = a.join(b, (F.col("lhs") == F.col("other")) & (F.col("a") < F.col("b"))).groupBy("lhs").agg(F.max(dist(F.col("a"), F.col("b"))).alias("d"))
        groups = rows.groupBy("lhs").agg(*count).join(far.withColumnRenamed("lhs", "k"), F.col("lhs") == F.col("k"), "left").select("lhs", "n", "nulls", F.coalesce("d", F.lit(0.0)).alias("d"))
    groups = groups.withColumn("diameter", null_rule(F.col("d")))
    summary = groups.agg((F.count_if(F.col("diameter") > parameter) == 0).alias("holds"), F.max("diameter").alias("max_diameter"), F.count_if(F.col("diameter") > parameter).alias("violating_groups"))
    return Verdict(summary, groups.where(F.col("diameter") > parameter).select("lhs", "diameter", "n"))


def predicate_space(df: DataFrame, columns: Sequence[str], shared: float = 0.3, comparable: float = 0.1) -> list[tuple[str, str, str]]:
    """(left column, op, right column) of denial constraint candidates: joinable columns compare for equality, comparable numbers for order."""
    cols = pick(df, columns)
    numeric = {c for c in cols if not isinstance(df.schema[c].dataType, T.StringType)}
    out = []
    avg = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i or (a in numeric) != (b in numeric):
                continue
            if a != b:
                fa = df.groupBy(F.col(f"`{a}`").cast("string").alias("v")).agg(F.count("*").alias("x"))
                fb = df.groupBy(F.col(f"`{b}`").cast("string").alias("w")).agg(F.count("*").alias("y"))
                both = fa.join(fb, F.col("v") == F.col("w"), "left").agg((F.sum(F.least("x", F.coalesce("y", F.lit(0)))) / F.sum(F.greatest("x", F.coalesce("y", F.lit(0))))).alias("s")).first()["s"]
                if (both or 0) <= shared:
                    continue
            out += [(a, "==", b), (a, "!=", b)]
            means = avg[f"a{i}"], avg[f"a{j}"]
            if a in numeric and (a == b or (None not in means and max(means) and min(means) / max(means) > comparable)):
                out += [(a, op, b) for op in ("<", "<=", ">", ">=")]
    return out


def mine_dcs(df: DataFrame, columns: Sequence[str], threshold: float = 0.0, shared: float = 0.3, comparable: float = 0.1, max_predicates: int | None = 3) -> DataFrame:
    """Minimal denial constraints of up to `max_predicates` (None: any number of) two-tuple predicates: rows (constraint, violating_pairs).

    Ordered row pairs become bit sets of the predicates they satisfy; equal
    rows are paired by count. A constraint is reported if at most `threshold`
    of all pairs satisfy all its predicates; one predicate per operand pair, and
    of a constraint and its mirror image one.
    """
    preds = predicate_space(df, columns, shared, comparable)
    cols = pick(df, columns)
    rows = _distinct_rows(df, cols)
    a, b = rows.select(F.struct(*rows.columns).alias("t")), rows.select(F.struct(*rows.columns).alias("s"))
    n = F.when(F.col("t.k") == F.col("s.k"), F.expr("t.n * (t.n - 1)")).otherwise(F.col("t.n") * F.col("s.n"))
    evidence = _by_flags(a.join(b), [_OPS[op](F.col(f"t.v.`{x}`"), F.col(f"s.v.`{y}`")) for x, op, y in preds], n)
    total = sum(k for _, k in evidence)
    mirrored = {i: preds.index((y, _FLIPPED[op], x)) if (y, _FLIPPED[op], x) in preds else None for i, (x, op, y) in enumerate(preds)}
    found: list[frozenset] = []
    out = []
    operands = len({(x, y) for x, _, y in preds})
    for size in range(1, min(operands, max_predicates or operands) + 1):
        for group in combinations(range(len(preds)), size):
            chosen = frozenset(group)
            if len({(preds[i][0], preds[i][2]) for i in group}) < size or any(f <= chosen for f in found):
                continue
            mask = sum(1 << i for i in group)
            bad = sum(k for e, k in evidence if e & mask == mask)
            if bad <= threshold * total:
                found.append(chosen)
                twin = frozenset(mirrored[i] for i in group)
                if None not in twin and twin != chosen:
                    found.append(twin)
                out.append(("!(" + " and ".join(f"t.{preds[i][0]} {preds[i][1]} s.{preds[i][2]}" for i in group) + ")", int(bad)))
    return df.sparkSession.createDataFrame(out, "constraint string, violating_pairs long")
