"""Sampled codes, order dependencies and row order against brute force."""

import itertools
import math
import random

import pytest

from stratalens.operators import fd, order, stats


def same(a, b):
    """Whether Spark groups two values together."""
    return a is b or a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


def test_big_integers_and_nan_are_told_apart(spark):
    big = spark.createDataFrame([(2**53, 1), (2**53 + 1, 2), (None, 3)], "a long, b int")
    assert {f for f, _ in fd.mine(big)} == {fd.FD((0,), 1), fd.FD((1,), 0)}
    assert {c for c, _ in fd.mine_uccs(big)} == {("a",), ("b",)}
    nan = spark.createDataFrame([(float("nan"), 1), (None, 2), (1.0, 3)], "a double, b int")
    assert fd.FD((0,), 1) in {f for f, _ in fd.mine(nan)}
    zero = spark.createDataFrame([(0.0, 1), (-0.0, 2)], "a double, b int")
    assert fd.FD((0,), 1) not in {f for f, _ in fd.mine(zero)}


@pytest.mark.parametrize("seed", range(3))
def test_mining_mixed_types(spark, seed):
    """Minimal dependencies over types that a sample could confuse, by comparing all pairs of rows."""
    rng = random.Random(seed)
    pick = (
        lambda: rng.choice([None, 2**53, 2**53 + 1, 2**62]),
        lambda: rng.choice([None, float("nan"), 0.0, -0.0, 1.5]),
        lambda: rng.choice([None, "", "a", "A"]),
        lambda: rng.choice([None, [], [1], [None]]),
    )
    rows = [tuple(p() for p in pick) for _ in range(7)]
    df = spark.createDataFrame(rows, "a long, b double, c string, d array<int>")
    holds = lambda xs, a: all(same(r[a], s[a]) for r, s in itertools.combinations(rows, 2) if all(same(r[x], s[x]) for x in xs))
    want = set()
    for a in range(4):
        for k in range(4):
            for xs in itertools.combinations([i for i in range(4) if i != a], k):
                if holds(xs, a) and not any(set(f.lhs) <= set(xs) and f.rhs == a for f in want):
                    want.add(fd.FD(xs, a))
    assert {f for f, _ in fd.mine(df)} == want


def test_numerical_dependency_names_the_widest(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("y", 2), ("y", 3), ("z", 1), ("z", 2), ("z", 4)], "k string, v int")
    found = fd.numerical_dependency(df, ["k"], ["v"], 1).violations.collect()
    assert sorted((r["lhs"]["k"], r["weight"]) for r in found) == [("y", 3), ("z", 3)]


def low(x):
    """Sort key with nulls first."""
    return (x is not None, x if x is not None else 0)


def fewest_removed(rows, descending):
    """Fewest rows without which left and right order rows alike, trying all subsets."""
    turn = -1 if descending else 1
    ranks = sorted({low(r[0]) for r in rows})
    left = [turn * ranks.index(low(r[0])) for r in rows]
    fits = lambda keep: all(not (left[i] < left[j] and low(rows[i][1]) > low(rows[j][1])) for i in keep for j in keep)
    return next(k for k in range(len(rows) + 1) for gone in itertools.combinations(range(len(rows)), k) if fits([i for i in range(len(rows)) if i not in gone]))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_order_compatibility_removals(spark, kind, descending):
    """Nulls and text columns, both directions, against all subsets of rows."""
    rng = random.Random(f"{kind}{descending}")
    value = (lambda: rng.choice([None, 1, 2, 3, 4])) if kind == "int" else (lambda: rng.choice([None, "a", "b", "c", "é"]))
    groups = {g: [(value(), value()) for _ in range(6)] for g in "pq"}
    rows = [(i, g, *r) for i, (g, r) in enumerate((g, r) for g, rs in groups.items() for r in rs)]
    df = spark.createDataFrame(rows, f"id long, g string, l {kind}, r {kind}")
    got = order.oc_removal_set(df, "id", ["g"], "l", "r", descending)
    want = {g: fewest_removed(rs, descending) for g, rs in groups.items()}
    gone = {r["id"] for r in got.collect()}
    assert {g: sum(r[1] == g and r[0] in gone for r in rows) for g in groups} == want
    left = df.where(~df["id"].isin([-1, *gone]))
    assert not order.swaps(left, ["g"], "l", "r", descending).take(1)
    assert {r["context"]["g"] for r in order.swaps(df, ["g"], "l", "r", descending).collect()} == {g for g, n in want.items() if n}


@pytest.mark.parametrize(
    "values, kind",
    [([1, 2, 2, 5], "ascending"), ([5, 2, 2, 1], "descending"), ([3, 3, 3], "equal"), ([1, 3, 2], "none"), ([None, 2, None, 1], "equal"), ([], "equal"), ([1, None, 0, 4], "ascending"), (list(range(300)), "ascending"), ([*range(300), 7], "none")],
)
def test_monotonicity(spark, values, kind):
    """Neighbours with a null between them aren't compared."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v int").repartition(5, "v")
    assert stats.monotonicity(df, "v", ["i"]).first()["kind"] == kind
