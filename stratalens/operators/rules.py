"""Association rules, numeric rules, algebraic constraints and probabilistic approximate constraints."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.options import pick, require, share
from .fd import chi_squared_quantile


def frequent_itemsets(baskets: DataFrame, min_support: float, items: str = "items", max_size: int | None = None) -> DataFrame:
    """(items sorted, count) of itemsets that a share min_support of the baskets hold, by levels.

    Baskets are first cut to frequent items. A level's candidates are few next
    to the baskets; they are generated from the last level on the driver, and
    counted by a join of baskets exploded to their candidates' first items.
    """
    share(min_support, "min_support")
    sets = baskets.select(F.array_distinct(F.col(items)).alias("items"))
    n = sets.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    single = sets.select(F.explode("items").alias("i")).where("i is not null").groupBy("i").count().where(F.col("count") >= least).collect()
    out: list[tuple[tuple[str, ...], int]] = [((str(r["i"]),), r["count"]) for r in single]
    level = sorted(x for x, _ in out)
    alive = [x[0] for x in level]
    spark = baskets.sparkSession
    cut = sets.select(F.array_sort(F.array_intersect(F.transform("items", lambda i: i.cast("string")), F.array(*[F.lit(i) for i in alive]).cast("array<string>"))).alias("items")).where("size(items) > 1")
    cut = cut.groupBy("items").agg(F.count("*").alias("n")).persist()
    try:
        size = 2
        while level and (max_size is None or size <= max_size):
            have = set(level)
            todo = [(*a, b[-1]) for k, a in enumerate(level) for b in level[k + 1 :] if a[:-1] == b[:-1]]
            todo = [c for c in todo if all(s in have for s in combinations(c, size - 1))]
            if not todo:
                break
            cand = spark.createDataFrame([(list(c), c[0]) for c in todo], "cand array<string>, first string")
            met = cut.withColumn("first", F.explode("items")).join(cand, "first").where(F.size(F.array_intersect("items", "cand")) == size)
            found = met.groupBy("cand").agg(F.sum("n").alias("count")).where(F.col("count") >= least).collect()
            out += [(tuple(r["cand"]), r["count"]) for r in found]
            level = sorted(tuple(r["cand"]) for r in found)
            size += 1
    finally:
        cut.unpersist()
    return spark.createDataFrame([(list(x), int(c)) for x, c in out], "items array<string>, count long")


def association_rules(baskets: DataFrame, min_support: float, min_confidence: float, items: str = "items", max_size: int | None = None) -> DataFrame:
    """(lhs, rhs, support, confidence) of rules between disjoint non-empty itemsets."""
    share(min_confidence, "min_confidence")
    n = baskets.count()
    sets = {tuple(r["items"]): r["count"] for r in frequent_itemsets(baskets, min_support, items, max_size).collect()}
    rows = []
    for whole, c in sets.items():
        for k in range(1, len(whole)):
            for lhs in combinations(whole, k):
                conf = c / sets[lhs]
                if conf >= min_confidence:
                    rows.append((list(lhs), [i for i in whole if i not in lhs], c / n, conf))
    return baskets.sparkSession.createDataFrame(rows, "lhs array<string>, rhs array<string>, support double, confidence double")


def verify_rule(baskets: DataFrame, lhs: Sequence[str], rhs: Sequence[str], min_support: float = 0.0, min_confidence: float = 1.0, items: str = "items") -> DataFrame:
    """One row: ar_holds, support, confidence and how many baskets fall in each class of left and right overlap."""
    require(bool(lhs) and bool(rhs) and not set(lhs) & set(rhs), "sides must be non-empty and disjoint")
    part = lambda side, p: F.when(F.size(F.array_intersect(F.array_distinct("i"), F.array(*[F.lit(x) for x in side]))) == len(set(side)), "full").when(F.size(F.array_intersect("i", F.array(*[F.lit(x) for x in side]))) > 0, "part").otherwise("none").alias(p)
    rows = baskets.select(F.transform(items, lambda x: x.cast("string")).alias("i")).select("i", part(lhs, "l"), part(rhs, "r"))
    of = lambda a, b: F.count_if((F.col("l") == a) & (F.col("r") == b))
    got = rows.agg(
        F.count("*").alias("n"), of("full", "full").alias("satisfying"), of("full", "part").alias("full_part"), of("full", "none").alias("full_none"),
        of("part", "full").alias("part_full"), of("part", "part").alias("part_part"), of("part", "none").alias("part_none"),
        *[F.max(F.array_contains("i", x).cast("int")).alias(f"has{k}") for k, x in enumerate([*lhs, *rhs])],
    )
    support, all_left = F.col("satisfying") / F.col("n"), F.col("satisfying") + F.col("full_part") + F.col("full_none")
    conf = F.when(all_left > 0, F.col("satisfying") / all_left).otherwise(0.0)
    return got.select(((support >= min_support) & (conf >= min_confidence)).alias("ar_holds"), support.alias("support"), conf.alias("confidence"), "satisfying", "full_part", "full_none", "part_full", "part_part", "part_none")


_OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b != 0, a / b)}


def sample_size(bumps: int, probability: float, fuzziness: float) -> int:
    """Rows to sample so that, with `probability`, at most `fuzziness` of all rows fall outside `bumps` ranges."""
    if fuzziness == 0:
        return -1
    return math.ceil(chi_squared_quantile(probability, 2 * (bumps + 1)) * (2 - fuzziness) / (4 * fuzziness) + bumps / 2)


def algebraic_constraints(df: DataFrame, operation: str = "-", columns: Sequence[str] | None = None, weight: float = 0.05, bumps_limit: int = 5, sample: float = 1.0, seed: int = 3) -> DataFrame:
    """Ranges that a op b falls into, for pairs of numeric columns: rows (left, right, low, high, n).

    Sorted results are cut at gaps wider than span * weight / (1 - weight), with
    weight 1 meaning one range; beyond bumps_limit the closest ranges merge.
    Division runs both ways and skips zero divisors. `sample` is a row share.
    """
    require(operation in _OPERATIONS, "operation must be one of + - * /")
    require(0 < weight <= 1 and 0 < sample <= 1, "weight and sample lie in (0, 1]")
    cols = [c for c in pick(df, columns) if isinstance(df.schema[c].dataType, T.NumericType)]
    pairs = [(a, b) for a, b in combinations(cols, 2) if type(df.schema[a].dataType) is type(df.schema[b].dataType)]
    if operation == "/":
        pairs += [(b, a) for a, b in pairs]
    rows = df if sample == 1 else df.sample(sample, seed=seed)
    out = []
    for a, b in pairs:
        value = _OPERATIONS[operation](F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double"))
        values = rows.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
        # Within parts of the sorted values by lag; only part edges and wide gaps leave the executors.
        parts = values.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id()).persist()
        edges = parts.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("c")).orderBy("part").collect()
        if not edges:
            parts.unpersist()
            continue
        low, high = edges[0]["lo"], edges[-1]["hi"]
        gap = (high - low) * weight / (1 - weight) if weight < 1 else math.inf
        prev = F.lag("v").over(Window.partitionBy("part").orderBy("v"))
        wide = parts.withColumn("p", prev).withColumn("gap", F.col("v") - F.col("p")).where(F.col("gap") > gap).select("p", "v", "gap")
        cuts = [(r["gap"], r["p"], r["v"]) for r in wide.orderBy(F.desc("gap")).limit(bumps_limit).collect()]
        cuts += [(y["lo"] - x["hi"], x["hi"], y["lo"]) for x, y in zip(edges[:-1], edges[1:], strict=True) if y["lo"] - x["hi"] > gap]
        cuts = sorted(sorted(cuts, reverse=True)[: bumps_limit - 1], key=lambda c: c[1])
        bounds = list(zip([low, *(c[2] for c in cuts)], [*(c[1] for c in cuts), high], strict=True))
        counts = parts.agg(*[F.sum(F.when(F.col("v").between(float(x), float(y)), F.col("c"))).alias(f"n{k}") for k, (x, y) in enumerate(bounds)]).first()
        parts.unpersist()
        out += [(a, b, float(x), float(y), int(counts[f"n{k}"])) for k, (x, y) in enumerate(bounds)]
    return df.sparkSession.createDataFrame(out, "left string, right string, low double, high double, n long")


def algebraic_exceptions(df: DataFrame, left: str, right: str, operation: str, ranges: Sequence[tuple[float, float]]) -> DataFrame:
    """Rows whose value of the operation lies in none of the ranges."""
    value = _OPERATIONS[operation](F.col(f"`{left}`").cast("double"), F.col(f"`{right}`").cast("double"))
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | value.between(low, high)
    return df.where(value.isNotNull() & ~inside)


def box_distance(values: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    """Chebyshev distance to a box."""
    parts = [F.greatest(F.lit(lo) - v, v - F.lit(hi), F.lit(0.0)) for v, lo, hi in zip(values, low, high, strict=True)]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def ball_distance(values: Sequence[Column], center: Sequence[float], radius: float) -> Column:
    """Euclidean distance to a ball."""
    d = sum((F.pow(v - F.lit(float(c)), 2) for v, c in zip(values, center, strict=True)), F.lit(0.0))
    return F.greatest(F.sqrt(d) - F.lit(float(radius)), F.lit(0.0))


def verify_pac(df: DataFrame, distance: Column, min_epsilon: float = 0.0, max_epsilon: float | None = None, min_delta: float = 0.9, steps: int = 100, diagonal: float = 1e-5) -> DataFrame:
    """One row (epsilon, delta): P(distance <= epsilon) >= delta, at the knee of the distances' distribution.

    The distribution is taken at steps + 1 shares from min_delta to 1. The
    first point from which the distance rises faster than the share, both
    scaled to their ranges, by more than `diagonal` is the knee.
    """
    share(min_delta, "min_delta")
    d = df.select(distance.cast("double").alias("d")).where("d is not null")
    counts = d.groupBy("d").agg(F.count("*").alias("c"))
    n = d.count()
    if not n:
        return df.sparkSession.createDataFrame([], "epsilon double, delta double")
    shares = [min_delta + (1 - min_delta) * i / steps for i in range(steps + 1)]
    points = counts.agg(F.percentile("d", F.array(*[F.lit(s) for s in shares]), F.col("c")).alias("q")).first()["q"] if steps else []
    top = max_epsilon if max_epsilon is not None else points[-1]
    curve = [(max(min_epsilon, q), s) for q, s in zip(points, shares, strict=True) if q <= top] or [(top, None)]
    span = (curve[-1][0] - curve[0][0]) or 1.0
    best = curve[-1]
    for (e1, s1), (e2, s2) in zip(curve[:-1], curve[1:], strict=True):
        if (e2 - e1) / span > (s2 - s1) / max(1e-12, 1 - min_delta) + diagonal:
            best = (e1, s1)
            break
    delta = d.agg((F.count_if(F.col("d") <= F.lit(float(best[0]))) / F.count("*")).alias("delta"))
    return delta.select(F.lit(float(best[0])).alias("epsilon"), "delta")


def pac_highlights(df: DataFrame, distance: Column, low: float, high: float) -> DataFrame:
    """Rows with low < distance <= high."""
    return df.where((distance > low) & (distance <= high))


def numeric_rules(
    df: DataFrame, columns: Sequence[str] | None = None, population: int = 40, generations: int = 10, min_support: float = 0.1, min_confidence: float = 0.6,
    scale: float = 0.5, crossover: float = 0.9, seed: int = 2,
) -> DataFrame:
    """Numeric association rules by differential evolution: rows (lhs, rhs, support, confidence, fitness).

    A candidate gives each column a place in the rule and a value range (or a
    category). A generation of candidates is judged in one aggregation.
    Fitness is the mean of support, confidence and the share of columns used;
    rules above both minima are kept.
    """
    cols = pick(df, columns)
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    text = [c for c in cols if c not in numeric]
    span = df.agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`").cast("double")).alias(f"{p}{i}") for i, c in enumerate(numeric) for p, f in (("lo", F.min), ("hi", F.max))]).first()
    n = span["n"]
    # A rule has no more support than a category in it, so only those above the minimum can matter: 1 / min_support at most.
    common = lambda c: df.groupBy(F.col(f"`{c}`").cast("string").alias("v")).count().where((F.col("count") > min_support * n) & F.col("v").isNotNull())
    values = {c: [r["v"] for r in common(c).orderBy(F.desc("count"), "v").collect()] for c in text}
    rng = np.random.default_rng(seed)
    size = 4 * len(cols) + 1

    def decode(v: np.ndarray) -> tuple[list, list]:
        order = np.argsort(v[: len(cols)], kind="stable")
        parts = []
        for k in order:
            c = cols[k]
            low, high, threshold = v[len(cols) + 3 * k : len(cols) + 3 * k + 3]
            if threshold > 0.7:
                continue
            if c in numeric:
                i = numeric.index(c)
                lo, hi = span[f"lo{i}"], span[f"hi{i}"]
                if lo is None:
                    continue
                a, b = sorted((lo + low * (hi - lo), lo + high * (hi - lo)))
                parts.append((c, float(a), float(b)))
            elif values[c]:
                parts.append((c, values[c][min(len(values[c]) - 1, int(low * len(values[c])))], None))
        cut = 1 + int(v[-1] * max(0, len(parts) - 1)) if len(parts) > 1 else 0
        return parts[:cut], parts[cut:]

    def test(parts: list) -> Column:
        out = F.lit(True)
        for c, a, b in parts:
            cell = F.col(f"`{c}`")
            out = out & (cell.cast("string") == a if b is None else cell.cast("double").between(a, b))
        return F.coalesce(out, F.lit(False))

    def judge(pool: np.ndarray) -> list[tuple]:
        rules = [decode(v) for v in pool]
        live = [(k, lhs, rhs) for k, (lhs, rhs) in enumerate(rules) if lhs and rhs]
        aggs = [x for k, lhs, rhs in live for x in (F.count_if(test(lhs)).alias(f"l{k}"), F.count_if(test([*lhs, *rhs])).alias(f"b{k}"))]
        got = df.agg(*aggs).first() if aggs and n else None
        out: list[tuple] = [(0.0, None, None, 0.0, 0.0)] * len(pool)
        for k, lhs, rhs in live:
            if got is not None and got[f"l{k}"] and got[f"b{k}"]:
                s, c = got[f"b{k}"] / n, got[f"b{k}"] / got[f"l{k}"]
                out[k] = ((s + c + (len(lhs) + len(rhs)) / len(cols)) / 3, lhs, rhs, s, c)
        return out

    pool = rng.random((population, size))
    scores = judge(pool)
    kept: dict[tuple, tuple] = {}

    def keep(found: list[tuple]) -> None:
        show = lambda parts: tuple(f"{c}={a}" if b is None else f"{c} in [{a:.6g},{b:.6g}]" for c, a, b in parts)
        for fit, lhs, rhs, s, c in found:
            if lhs and s > min_support and c > min_confidence:
                kept[show(lhs), show(rhs)] = (s, c, fit)

    keep(scores)
    for _ in range(generations):
        trial = pool.copy()
        for i in range(population):
            a, b, c = pool[rng.choice([k for k in range(population) if k != i], 3, replace=False)]
            mask = rng.random(size) < crossover
            mask[rng.integers(size)] = True
            trial[i, mask] = np.clip(a + scale * (b - c), 0, 1)[mask]
        found = judge(trial)
        keep(found)
        for i in range(population):
            if found[i][0] >= scores[i][0]:
                pool[i], scores[i] = trial[i], found[i]
    rows = [(list(lhs), list(rhs), *m) for (lhs, rhs), m in sorted(kept.items(), key=lambda x: -x[1][2])]
    return df.sparkSession.createDataFrame(rows, "lhs array<string>, rhs array<string>, support double, confidence double, fitness double")

