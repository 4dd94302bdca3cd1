"""Functional dependencies: exact, approximate and probabilistic; discovery and validation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..plans.kernel import Lattice
from ..plans.options import pick, require, share

MEASURES = ("g1", "pdep", "tau", "mu_plus", "rho", "per_tuple", "per_value")
#: Every exact algorithm gives the same minimal dependencies, so all names run one engine.
EXACT_ALGORITHMS = ("hyfd", "tane", "fun", "dfd", "fdmine", "depminer", "fastfds", "fdep", "aid", "eulerfd")


@dataclass(frozen=True, order=True)
class FD:
    lhs: tuple[int, ...]
    rhs: int


def _grouped(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """One row per group of lhs: x (its values), s rows, nd distinct rhs, top (largest rhs group), q (sum of squares)."""
    x = F.struct(*[F.col(f"`{c}`") for c in lhs]) if lhs else F.struct(F.lit(0).alias("all"))
    a = F.struct(*[F.col(f"`{c}`") for c in rhs])
    cells = df.groupBy(x.alias("x"), a.alias("a")).agg(F.count("*").alias("c"))
    c = F.col("c")
    return cells.groupBy("x").agg(F.sum("c").alias("s"), F.count("*").alias("nd"), F.max("c").alias("top"), F.sum(c * c).alias("q"))


def pair_measures(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """One row of sums from which every measure of lhs -> rhs that needs joint counts follows."""
    g = _grouped(df, lhs, rhs)
    s, top, q = F.col("s").cast("double"), F.col("top").cast("double"), F.col("q").cast("double")
    return g.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("n"), F.count("*").alias("x_groups"), F.coalesce(F.sum("nd"), F.lit(0)).alias("xa_groups"),
        F.sum(q / s).alias("pdep_sum"), F.sum("top").alias("top_sum"), F.avg(top / s).alias("top_avg"),
        F.coalesce(F.sum(F.when(F.col("nd") > 1, F.col("s") * F.col("s") - F.col("q"))), F.lit(0)).alias("bad_pairs"),
        F.count(F.when(F.col("nd") > 1, 1)).alias("bad_groups"), F.coalesce(F.sum(F.when(F.col("nd") > 1, F.col("s"))), F.lit(0)).alias("bad_rows"),
        F.coalesce(F.sum(F.when(F.col("nd") > 1, F.col("s") - F.col("top"))), F.lit(0)).alias("minority_rows"),
    )


def _error(lat: Lattice, df: DataFrame, lhs: int, rhs: int, measure: str) -> float:
    n = lat.rows
    got = lat.stats([lhs, rhs, lhs | rhs])
    x, a, xa = got[lhs], got[rhs], got[lhs | rhs]
    if measure == "g1":
        return measures.g1(n, x, xa)
    if not lhs:  # nothing to condition on: a constant or the worst
        if measure == "per_tuple" or measure == "per_value":
            return 1 - a.largest / n if n else 0.0
        return 0.0 if a.groups <= 1 else 1.0
    if measure == "rho":
        return 1 - measures.rho(x, xa)
    r = pair_measures(lat.df, [lat.names[i] for i in lat.members(lhs)], [lat.names[i] for i in lat.members(rhs)]).first()
    if not n:
        return 0.0
    pdep, own = r["pdep_sum"] / n, measures.pdep_self(n, a)
    if measure == "pdep":
        return 1 - pdep
    if measure == "tau":
        return 1 - measures.tau(pdep, own)
    if measure == "mu_plus":
        return 1 - measures.mu_plus(n, pdep, own, x.groups)
    return 1 - (r["top_sum"] / n if measure == "per_tuple" else r["top_avg"])


def mine(df: DataFrame, columns: Sequence[str] | None = None, max_lhs: int | None = None, error: float = 0.0, measure: str = "g1") -> list[tuple[FD, float]]:
    """Minimal dependencies X -> A with error at most `error`, level by level over X.

    Supersets of a found left side are not looked at, whatever the measure. A
    constant column depends on the empty set. NULL equals NULL.
    """
    require(measure in MEASURES, f"measure must be one of {', '.join(MEASURES)}")
    share(error, "error")
    names = pick(df, columns)
    lat = Lattice(df, names)
    found: dict[int, list[int]] = {a: [] for a in range(len(names))}
    out: list[tuple[FD, float]] = []
    if not lat.rows:
        return out
    for level in range(min(len(names) - 1, len(names) if max_lhs is None else max_lhs) + 1):
        todo = [
            (sum(1 << i for i in xs), a)
            for a in range(len(names))
            for xs in combinations([i for i in range(len(names)) if i != a], level)
        ]
        todo = [(x, a) for x, a in todo if not any(x & y == y for y in found[a])]
        if error == 0:
            todo = [(x, a) for x, a in todo if not lat.refuted(x, 1 << a)]
        if not todo:
            continue
        lat.stats([m for x, a in todo for m in (x, 1 << a, x | 1 << a)])
        for x, a in todo:
            e = (0.0 if lat.known[x].groups == lat.known[x | 1 << a].groups else 1.0) if error == 0 else _error(lat, df, x, 1 << a, measure)
            if e <= error:
                found[a].append(x)
                out.append((FD(tuple(lat.members(x)), a), e))
    return sorted(out, key=lambda f: (len(f[0].lhs), f[0]))


def discover(df: DataFrame, columns: Sequence[str] | None = None, max_lhs: int | None = None, error: float = 0.0, measure: str = "g1", algorithm: str = "hyfd") -> DataFrame:
    """Minimal dependencies as rows (lhs, rhs, error); lhs is an array of column names."""
    require(algorithm in (*EXACT_ALGORITHMS, "pyro", "pfdtane"), f"unknown algorithm {algorithm}")
    names = pick(df, columns)
    rows = [([names[i] for i in f.lhs], names[f.rhs], float(e)) for f, e in mine(df, columns, max_lhs, error, measure)]
    return df.sparkSession.createDataFrame(rows, "lhs array<string>, rhs string, error double")


def to_json(fds: Sequence[FD]) -> str:
    """The dependencies as JSON over column positions, ordered by left side and right side."""
    items = [f'{{"lhs": [{",".join(map(str, f.lhs))}], "rhs": {f.rhs}}}' for f in sorted(fds, key=lambda f: (len(f.lhs), f.lhs, f.rhs))]
    return f'{{"fds": [{",".join(items)}]}}'


def fletcher16(text: str) -> int:
    """Checksum of a text: two running sums modulo 255."""
    low = high = 0
    for byte in text.encode():
        low = (low + byte) % 255
        high = (high + low) % 255
    return high << 8 | low


def from_json(text: str) -> list[FD]:
    return [FD(tuple(f["lhs"]), f["rhs"]) for f in json.loads(text)["fds"]]


@dataclass
class Verdict:
    """summary has one row; violations has one row per violating group."""

    summary: DataFrame
    violations: DataFrame


_ORDERS = {"proportion": "proportion", "num": "num_distinct_rhs", "size": "size", "lhs": "lhs"}


def verify(df: DataFrame, lhs: Sequence[str | int], rhs: Sequence[str | int], order: str = "proportion", descending: bool = True) -> Verdict:
    """Whether lhs -> rhs holds, its g1 error, and the groups that break it.

    summary: holds, error, num_error_clusters, num_error_rows. violations: lhs
    (struct), size, num_distinct_rhs, proportion of the most frequent rhs.
    """
    require(order in _ORDERS, f"order must be one of {', '.join(_ORDERS)}")
    x, a = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    require(bool(a), "rhs must name a column")
    m = pair_measures(df, x, a)
    n = F.col("n").cast("double")
    summary = m.select(
        (F.col("bad_groups") == 0).alias("holds"),
        F.when(n > 1, F.col("bad_pairs") / (n * (n - 1))).otherwise(0.0).alias("error"),
        F.col("bad_groups").alias("num_error_clusters"), F.col("bad_rows").alias("num_error_rows"),
    )
    bad = _grouped(df, x, a).where("nd > 1").select(F.col("x").alias("lhs"), F.col("s").alias("size"), F.col("nd").alias("num_distinct_rhs"), (F.col("top") / F.col("s")).alias("proportion"))
    key = F.col(_ORDERS[order])
    return Verdict(summary, bad.orderBy(key.desc() if descending else key.asc()))


def violating_rows(df: DataFrame, lhs: Sequence[str | int], rhs: Sequence[str | int]) -> DataFrame:
    """The rows of `df` in groups of lhs that have more than one rhs value."""
    x, a = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    bad = _grouped(df, x, a).where("nd > 1").select("x")
    keys = bad.select(*[F.col(f"x.`{c}`").alias(f"_k{i}") for i, c in enumerate(x)])
    on = [df[f"`{c}`"].eqNullSafe(keys[f"_k{i}"]) for i, c in enumerate(x)]
    return df.join(keys, on, "left_semi") if x else df.where(F.lit(bool(bad.take(1))))


def verify_pfd(df: DataFrame, lhs: Sequence[str | int], rhs: Sequence[str | int], measure: str = "per_tuple") -> Verdict:
    """Probabilistic dependency: the error is one minus the share of rows with their group's most frequent rhs."""
    require(measure in ("per_tuple", "per_value"), "measure must be per_tuple or per_value")
    x, a = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    kept = F.col("top_sum") / F.col("n") if measure == "per_tuple" else F.col("top_avg")
    summary = pair_measures(df, x, a).select((1 - F.coalesce(kept, F.lit(1.0))).alias("error"), F.col("bad_groups").alias("num_violating_clusters"), F.col("minority_rows").alias("num_violating_rows"))
    bad = _grouped(df, x, a).where("nd > 1").select(F.col("x").alias("lhs"), F.col("s").alias("size"), (F.col("s") - F.col("top")).alias("violating_rows"))
    return Verdict(summary, bad)


def metrics(df: DataFrame, lhs: Sequence[str | int], rhs: Sequence[str | int]) -> DataFrame:
    """One row: g1, g2, g3-style shares, pdep, tau, mu_plus, rho and fi of lhs -> rhs."""
    x, a = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    m = pair_measures(df, x, a)
    self_counts = df.groupBy(*[F.col(f"`{c}`") for c in a]).count()
    c = F.col("count").cast("double")
    own = self_counts.agg(F.sum(c * c).alias("a_squares"), F.sum(c * F.log(c)).alias("a_log"), F.count("*").alias("a_groups"))
    both = lambda cols, p: df.groupBy(*[F.col(f"`{c}`") for c in cols]).count().agg(F.sum(c * F.log(c)).alias(p))
    one = m.join(own).join(both(x, "x_log")).join(both([*x, *(k for k in a if k not in x)], "xa_log"))  # single rows
    n = F.col("n").cast("double")
    pdep, self_ = F.col("pdep_sum") / n, F.col("a_squares") / (n * n)
    h = lambda p: F.log(n) - F.col(p) / n
    mu = 1 - (1 - pdep) / (1 - self_) * (n - 1) / (n - F.col("x_groups"))
    return one.select(
        F.when(n > 1, F.col("bad_pairs") / (n * (n - 1))).otherwise(0.0).alias("g1"), (F.col("bad_rows") / n).alias("g2"),
        pdep.alias("pdep"), F.when(self_ == 1, 1.0).otherwise((pdep - self_) / (1 - self_)).alias("tau"),
        F.when((self_ == 1) | (F.col("x_groups") == n), 1.0).otherwise(F.greatest(F.lit(0.0), mu)).alias("mu_plus"),
        (F.col("x_groups") / F.col("xa_groups")).alias("rho"),
        F.when(F.col("a_groups") > 1, (h("x_log") + h("a_log") - h("xa_log")) / h("a_log")).otherwise(0.0).alias("fi"),
    )


def numerical_dependency(df: DataFrame, lhs: Sequence[str | int], rhs: Sequence[str | int], weight: int, null_equal_null: bool = True) -> Verdict:
    """X ->(<= weight) Y: how many distinct Y a value of X has at most.

    Unless null_equal_null, a row with a null on either side counts as a value
    of its own. The violations are the values of X that have the most Y.
    """
    require(weight >= 1, "weight must be positive")
    x, a = pick(df, lhs, "lhs"), pick(df, rhs, "rhs")
    if not null_equal_null:
        unique = F.monotonically_increasing_id()
        df = df.select(*[F.struct(F.col(f"`{c}`").alias("v"), F.when(F.col(f"`{c}`").isNull(), unique).alias("u")).alias(c) for c in dict.fromkeys([*x, *a])])
    g = _grouped(df, x, a).select(F.col("x").alias("lhs"), F.col("nd").alias("weight"), F.col("s").alias("size"))
    summary = g.agg(F.coalesce(F.max("weight") <= weight, F.lit(True)).alias("holds"), F.max("weight").alias("real_weight"), F.min("weight").alias("global_min_weight"))
    top = g.agg(F.max("weight").alias("most"))  # a single row
    return Verdict(summary, g.join(top).where("weight = most").drop("most"))


def unique_error(pairs: Column, n: Column) -> Column:
    return F.when(n > 1, pairs / (n * (n - 1))).otherwise(0.0)


def verify_ucc(df: DataFrame, columns: Sequence[str | int] | None = None) -> Verdict:
    """Whether a column combination is unique: holds, error (share of equal pairs), violating clusters and rows."""
    cols = pick(df, columns)
    g = df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count("*").alias("size"))
    big = F.col("size") > 1
    s = F.col("size")
    summary = g.agg(
        (F.count(F.when(big, 1)) == 0).alias("holds"),
        F.coalesce(unique_error(F.sum(s * (s - 1)).cast("double"), F.sum(s).cast("double")), F.lit(0.0)).alias("error"),
        F.count(F.when(big, 1)).alias("num_clusters_violating"), F.coalesce(F.sum(F.when(big, s)), F.lit(0)).alias("num_rows_violating"),
    )
    return Verdict(summary, g.where(big))


def mine_uccs(df: DataFrame, columns: Sequence[str] | None = None, max_size: int | None = None, error: float = 0.0) -> list[tuple[tuple[str, ...], float]]:
    """Minimal (approximately) unique column combinations: g1-style share of equal pairs at most `error`."""
    share(error, "error")
    names = pick(df, columns)
    lat = Lattice(df, names)
    found: list[int] = []
    out = []
    pairs = lat.rows * (lat.rows - 1) / 2
    for size in range(1, min(len(names), max_size or len(names)) + 1):
        todo = [sum(1 << i for i in xs) for xs in combinations(range(len(names)), size)]
        todo = [m for m in todo if not any(m & f == f for f in found)]
        if error == 0:
            todo = [m for m in todo if not lat.repeated(m)]
        got = lat.stats(todo)
        for m in todo:
            e = got[m].pairs / pairs if pairs else 0.0
            if e <= error:
                found.append(m)
                out.append((tuple(lat.named(m)), e))
    return out


#: As with dependencies, all names run one engine.
UCC_ALGORITHMS = ("hyucc", "pyroucc", "hpivalid")


def discover_uccs(df: DataFrame, columns: Sequence[str] | None = None, max_size: int | None = None, error: float = 0.0, algorithm: str = "pyroucc") -> DataFrame:
    """Minimal (approximately) unique column combinations as rows (ucc, error); only pyroucc takes an error."""
    require(algorithm in UCC_ALGORITHMS, f"unknown algorithm {algorithm}")
    require(error == 0 or algorithm == "pyroucc", f"{algorithm} finds exact keys only")
    rows = [(list(c), float(e)) for c, e in mine_uccs(df, columns, max_size, error)]
    return df.sparkSession.createDataFrame(rows, "ucc array<string>, error double")


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi_squared_quantile(p: float, df: int) -> float:
    """Wilson-Hilferty approximation of the chi-squared quantile."""
    z = _normal_quantile(p)
    return df * (1 - 2 / (9 * df) + z * (2 / (9 * df)) ** 0.5) ** 3


def soft_dependencies(
    df: DataFrame, columns: Sequence[str] | None = None, min_cardinality: float = 0.02, max_diff: float = 0.05, min_strength: float = 0.1,
    p_value: float = 0.05, sample_rows: int = 10_000, buckets: int = 40, seed: int = 5,
) -> DataFrame:
    """Soft dependencies and correlations of column pairs, judged on a sample.

    Rows (lhs, rhs, kind): 'soft_key', 'trivial' (rhs null), 'sfd' or
    'correlation'. Soft keys have almost as many values as rows; a soft
    dependency has few value pairs and about one right value each; otherwise
    a chi-squared test on hashed buckets decides on correlation.
    """
    names = pick(df, columns)
    lat = Lattice(df, names)
    n = lat.rows
    out: list[tuple[str, str | None, str]] = []
    single = lat.stats([1 << i for i in range(len(names))])
    live = []
    for i, c in enumerate(names):
        groups = single[1 << i].groups
        if groups >= (1 - min_cardinality) * n:
            out.append((c, None, "soft_key"))
        elif groups <= 1:
            out.append((c, None, "trivial"))
        else:
            live.append(i)
    some = df.select(*names)
    if n > sample_rows:
        some = some.sample(min(1.0, 1.2 * sample_rows / n), seed=seed).limit(sample_rows)
    some = some.persist()
    try:
        slat = Lattice(some, names)
        s = slat.rows
        slat.stats([1 << i for i in live] + [1 << i | 1 << j for i, j in combinations(live, 2)])
        for i, j in combinations(live, 2):
            both = slat.known[1 << i | 1 << j].groups
            order = sorted((i, j), key=lambda k: -slat.known[1 << k].groups)
            left = slat.known[1 << order[0]].groups
            if both <= max_diff * s and left >= (1 - min_strength) * both:
                out.append((names[order[0]], names[order[1]], "sfd"))
                continue
            d1, d2 = (min(buckets, slat.known[1 << k].groups) for k in (i, j))
            table = some.groupBy(F.pmod(F.xxhash64(F.col(f"`{names[i]}`")), F.lit(d1)).alias("a"), F.pmod(F.xxhash64(F.col(f"`{names[j]}`")), F.lit(d2)).alias("b")).count().collect()
            rows_, cols_ = [0] * d1, [0] * d2
            for r in table:
                rows_[r["a"]] += r["count"]
                cols_[r["b"]] += r["count"]
            seen = {(r["a"], r["b"]): r["count"] for r in table}
            if 0 in rows_ or 0 in cols_:
                continue
            chi = sum((seen.get((a, b), 0) - rows_[a] * cols_[b] / s) ** 2 / (rows_[a] * cols_[b] / s) for a in range(d1) for b in range(d2))
            if chi > chi_squared_quantile(1 - p_value, max(1, (d1 - 1) * (d2 - 1))):
                out.append((names[i], names[j], "correlation"))
    finally:
        some.unpersist()
    return df.sparkSession.createDataFrame(out, "lhs string, rhs string, kind string")
