"""Dependencies over pairs of rows against all pairs."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalens.functions import similarity
from stratalens.operators import order, pairs


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def people():
    rng = random.Random(3)
    return [(rng.choice([None, 0.0, 1.5, 2.0, 7.25, 9.0]), datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(40)), rng.choice(["ann", "anna", "bob", "bobby"]), rng.randrange(4)) for _ in range(30)]


@pytest.mark.parametrize(
    "lhs, rhs",
    [({"a": (0, 1.5)}, {"c": (0, 1)}), ({"d": (2, 5)}, {"a": (0, 3)}), ({"a": (0, 0)}, {"d": (0, 20)}), ({"c": (0, 1), "d": (0, 9)}, {"k": (0, 1)}), ({"c": (0, 1)}, {"k": (0, 2)}), ({"a": (0, float("inf"))}, {"k": (0, 1)})],
)
def test_differential_verdict(spark, people, lhs, rhs):
    df = spark.createDataFrame(people, "a double, d date, c string, k int")
    distance = {"a": lambda x, y: abs(x - y), "d": lambda x, y: abs((x - y).days), "c": edits, "k": lambda x, y: abs(x - y)}
    at = {"a": 0, "d": 1, "c": 2, "k": 3}
    within = lambda r, s, side: all(None not in (r[at[c]], s[at[c]]) and low <= distance[c](r[at[c]], s[at[c]]) <= high for c, (low, high) in side.items())
    left = [(r, s) for r, s in itertools.combinations(people, 2) if within(r, s, lhs)]
    bad = sum(not within(r, s, rhs) for r, s in left)
    got = pairs.verify_dd(df, lhs, rhs).first()
    assert (got["holds"], got["lhs_pairs"], got["violating_pairs"]) == (bad == 0, len(left), bad)


def test_denial_mining_of_many_predicates(spark):
    """More predicates than one long has bits; every reported constraint is minimal and every minimal one reported."""
    rng = random.Random(5)
    cols = list("abcdefghijkl")
    rows = [tuple(rng.randrange(3) for _ in cols) for _ in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    space = pairs.predicate_space(df, cols)
    assert len(space) > 62
    got = {r["constraint"] for r in pairs.mine_dcs(df, cols, max_predicates=2).collect()}
    test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}
    meets = lambda p, r, s: test[p[1]](r[cols.index(p[0])], s[cols.index(p[2])])
    both = [(r, s) for r, s in itertools.permutations(rows, 2)]
    clean = lambda group: not any(all(meets(p, r, s) for p in group) for r, s in both)
    single = {p for p in space if clean([p])}
    want = set()
    for a, b in itertools.combinations(space, 2):
        if (a[0], a[2]) != (b[0], b[2]) and not {a, b} & single and clean([a, b]):
            want.add(frozenset((a, b)))
    text = lambda group: "!(" + " and ".join(f"t.{x} {op} s.{y}" for x, op, y in sorted(group, key=space.index)) + ")"
    flip = {"==": "==", "!=": "!=", "<": ">", ">": "<", "<=": ">=", ">=": "<="}
    mirror = lambda group: frozenset((y, flip[op], x) for x, op, y in group)
    for group in want | {frozenset([p]) for p in single}:
        assert text(group) in got or all(p in space for p in mirror(group)) and text(mirror(group)) in got, group
    assert len(got) <= len(want) + len(single) and got <= {text(g) for g in want} | {text([p]) for p in single}


def brute_mds(rows, measures, levels, max_lhs, min_support, disjoint):
    """The most general left sides of the highest bounds, by comparing all pairs of rows."""
    vectors = [[sum(m(r, s) >= v for v in levels) for m in measures] for r in rows for s in rows]
    out = []
    for size in range(max_lhs + 1):
        for group in itertools.combinations(range(len(measures)), size):
            for ks in itertools.product(range(1, len(levels) + 1), repeat=size):
                lhs = dict(zip(group, ks, strict=True))
                met = [v for v in vectors if all(v[i] >= k for i, k in lhs.items())]
                for r in range(len(measures)):
                    top = min((v[r] for v in met), default=0)
                    if len(met) >= min_support and not (disjoint and r in lhs) and top > lhs.get(r, 0):
                        if not any(o == r and t >= top and all(lhs.get(i, 0) >= k for i, k in ol.items()) for ol, o, t, _ in out):
                            out.append((lhs, r, top, len(met)))
    return sorted((sorted(lhs.items()), r, t, n) for lhs, r, t, n in out)


@pytest.mark.parametrize("disjoint", [True, False])
@pytest.mark.parametrize("level", ["cardinality", "lattice"])
def test_matching_mining(spark, disjoint, level):
    """Two measures of one column pair, and right sides that stand on the left too."""
    rows = [("ann", 1), ("anna", 1), ("annie", 2), ("bob", 7), ("bobb", 7)]
    df = spark.createDataFrame(rows, "c string, k int")
    lev = lambda r, s: 1 - edits(r[0], s[0]) / max(len(r[0]), len(s[0]))
    same = lambda r, s: float(r[0] == s[0])
    far = {r[1]: max(abs(r[1] - s[1]) for s in rows) for r in rows}
    near = lambda r, s: 1 - abs(r[1] - s[1]) / far[r[1]]
    matches = [pairs.Match("c", "c", "levenshtein"), pairs.Match("c", "c", "equality"), pairs.Match("k", "k", "number")]
    names = ["c~c:levenshtein", "c~c:equality", "k~k"]
    levels = (0.5, 0.75, 1.0)
    found = pairs.mine_mds(df, None, matches, levels, 1, 2, disjoint, level).collect()
    got = sorted((sorted((names.index(k), levels.index(v) + 1) for k, v in r["lhs"].items()), names.index(r["rhs"]), levels.index(r["bound"]) + 1, r["support"]) for r in found)
    assert got == brute_mds(rows, [lev, same, near], levels, 2, 1, disjoint)


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_longest_common_subsequence(spark):
    texts = ["", "abc", "acb", "xaybzc", "ann lee", "lee ann"]
    both = spark.createDataFrame([(x, y) for x in texts for y in texts if x and y], "x string, y string")
    for r in both.withColumn("s", similarity.measure("lcs")(F.col("x"), F.col("y"))).collect():
        assert r["s"] == pytest.approx(subsequence(r["x"], r["y"]) / max(len(r["x"]), len(r["y"]))), r


@pytest.mark.parametrize("seed", range(4))
def test_sequential_edits_are_fewest(seed):
    """Deletions and insertions of every subsequence kept."""
    rng = random.Random(seed)
    y = [float(rng.randrange(0, 30)) for _ in range(7)]
    low, high = 1, rng.choice([6, 10])
    best = min(
        (len(y) - len(keep)) + sum(order.gap_cost(b - a, low, high) for a, b in zip(keep[:-1], keep[1:], strict=True))
        for k in range(1, len(y) + 1) for keep in itertools.combinations(y, k)
    )
    assert order.sequence_edits(y, low, high)[0] == best
