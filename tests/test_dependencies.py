"""Known answers on small tables, and miners against brute force."""

import itertools
import math
import random

import pytest

from stratalens import ConfigError
from stratalens.operators import cfd, fd, inclusion
from stratalens.streaming.dynamic import DynamicFD

#: Fixed rows; the expected figures below belong to them.
TABLE = [
    ("1", "1", "1", "1.233", "-", "1"), ("1", "1", "1", "0", "8", "2"), ("1", "1", "2.1", "0", "8", "3"),
    ("1", "2", "2", "hjkl", "444", "4"), ("1", "2", "2", "hjkl", "444", "4"), ("1", "2", "", "hjkl", "444", "5"),
    ("1", "3", "3", "0", "9", "6"), ("1", "3", "3", "0", "9", "6"), ("1", "3", None, "999", "-", "7"),
    ("1", "4", "4", "hjkl", "555", "8"), ("1", "4", "4", "hjkl", "555", "8"), ("1", "4", "abc", "hjkl", "555", "9"),
]
#: Fixed rows.
TENNIS = [
    ("sunny", "hot", "high", "false", "no"),
    ("sunny", "hot", "high", "true", "no"),
    ("overcast", "hot", "high", "false", "yes"),
    ("rainy", "mild", "high", "false", "yes"),
    ("rainy", "cool", "normal", "false", "yes"),
    ("rainy", "cool", "normal", "true", "no"),
    ("overcast", "cool", "normal", "true", "yes"),
    ("sunny", "mild", "high", "false", "no"),
    ("sunny", "cool", "normal", "false", "yes"),
    ("rainy", "mild", "normal", "false", "yes"),
    ("sunny", "mild", "normal", "true", "yes"),
    ("overcast", "mild", "high", "true", "yes"),
    ("overcast", "hot", "normal", "false", "yes"),
    ("rainy", "mild", "high", "true", "no"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, ", ".join(f"Col{i} string" for i in range(6))).cache()


@pytest.mark.parametrize(
    "lhs, rhs, clusters, rows, pairs",
    [([4], [3], 1, 2, 2), ([3], [4], 2, 10, 26), ([0], [1], 1, 12, 108), ([1], [2], 4, 12, 16), ([1], [3], 2, 6, 8), ([1], [2, 3], 4, 12, 18), ([2], [5], 1, 2, 2),
     ([1, 3], [5], 3, 8, 10), ([1, 2], [0, 3], 1, 2, 2), ([3, 4], [1, 2], 3, 8, 10), ([1], [0], 0, 0, 0), ([5], [1], 0, 0, 0)],
)
def test_fd_verify(table, lhs, rhs, clusters, rows, pairs):
    r = fd.verify(table, lhs, rhs).summary.first()
    assert (r["holds"], r["num_error_clusters"], r["num_error_rows"]) == (clusters == 0, clusters, rows)
    assert math.isclose(r["error"], pairs / 132)


def test_afd_metrics(table):
    a, b = fd.metrics(table, [4], [3]).first(), fd.metrics(table, [3], [4]).first()
    assert math.isclose(a["tau"], 78 / 90) and math.isclose(a["g2"], 1 / 6) and math.isclose(a["mu_plus"], 498 / 630)
    assert math.isclose(a["fi"], 1 - math.log(4) / math.log(746496))
    assert math.isclose(b["tau"], 54 / 114) and math.isclose(b["g2"], 5 / 6) and math.isclose(b["mu_plus"], 252 / 912)
    assert math.isclose(b["fi"], math.log(432) / math.log(13824))


def test_pfd_verify(table):
    assert abs(fd.verify_pfd(table, [2], [3], "per_value").summary.first()["error"] - 0.0625) < 1e-4
    assert abs(fd.verify_pfd(table, [2], [3], "per_tuple").summary.first()["error"] - 0.0834) < 1e-4
    for measure in ("per_value", "per_tuple"):
        assert abs(fd.verify_pfd(table, [4], [5], measure).summary.first()["error"] - 0.3334) < 1e-4


@pytest.mark.parametrize("cols, clusters, rows, pairs", [([0], 1, 12, 132), ([0, 1], 4, 12, 24), ([0, 1, 2], 4, 8, 8)])
def test_ucc_verify(table, cols, clusters, rows, pairs):
    r = fd.verify_ucc(table, cols).summary.first()
    assert (r["num_clusters_violating"], r["num_rows_violating"]) == (clusters, rows)
    assert math.isclose(r["error"], pairs / 132)


def test_mining_known(spark):
    long = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (1, 2, 3), (3, 3, 4), (3, 4, 5), (2, 2, 7), (5, 2, 7), (5, 3, 8)], "a int, b int, c int")
    assert {f for f, _ in fd.mine(long)} == {fd.FD((2,), 1)}
    wide = spark.createDataFrame([(1, 3, 3, 4, 5), (2, 3, 4, 4, 6)], "a int, b int, c int, d int, e int")
    want = {((0,), 2), ((0,), 4), ((2,), 0), ((2,), 4), ((4,), 0), ((4,), 2), ((), 1), ((), 3)}
    assert {(f.lhs, f.rhs) for f, _ in fd.mine(wide)} == want
    assert fd.mine(spark.createDataFrame([(1,), (1,), (2,)], "a int")) == []
    text = fd.to_json([f for f, _ in fd.mine(long)])
    assert text == '{"fds": [{"lhs": [2], "rhs": 1}]}' and fd.from_json(text) == [fd.FD((2,), 1)]
    assert fd.fletcher16("abcde") == 0xC8F0


def brute_fds(rows, width):
    out = set()
    for a in range(width):
        found = []
        for k in range(width):
            for xs in itertools.combinations([i for i in range(width) if i != a], k):
                if any(set(f) <= set(xs) for f in found):
                    continue
                seen = {}
                if all(seen.setdefault(tuple(r[i] for i in xs), r[a]) == r[a] for r in rows):
                    found.append(xs)
                    out.add((xs, a))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mining_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [tuple(rng.choice([None, 0, 1, 2]) for _ in range(4)) for _ in range(9)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    assert {(f.lhs, f.rhs) for f, _ in fd.mine(df)} == brute_fds(rows, 4)
    keys = {c for c, _ in fd.mine_uccs(df)}
    unique = lambda xs: len({tuple(r["abcd".index(c)] for c in xs) for r in rows}) == len(rows)
    every = [xs for k in range(1, 5) for xs in itertools.combinations("abcd", k) if unique(xs)]
    assert keys == {xs for xs in every if not any(set(o) < set(xs) for o in every)}


def test_numerical_dependency(spark):
    rows = [("1", None), ("1", "aa"), ("1", None), ("1", "bb")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert fd.numerical_dependency(df, ["x"], ["y"], 3).summary.first()["real_weight"] == 3
    assert fd.numerical_dependency(df, ["x"], ["y"], 3, null_equal_null=False).summary.first()["real_weight"] == 4


def test_inclusion(spark):
    three = spark.createDataFrame([("a", 1, "x", "b", 2, "y"), ("b", 2, "y", "b", 2, "y"), ("c", 3, "y", "a", 1, "x")], "c0 string, c1 int, c2 string, c3 string, c4 int, c5 string")
    assert inclusion.verify(three, [3], three, [0]).summary.first()["holds"]
    r = inclusion.verify(three, [1], three, [4]).summary.first()
    assert (r["num_rows_violating"], r["num_clusters_violating"]) == (1, 1) and math.isclose(r["error"], 1 / 3)
    typos = [("0", "a", "0", "a", "a"), ("1", "b", "2", "c", "b"), ("1", "b", "3", "d", "0"), ("0", "a", "5", "f", "1"), ("2", "c", "6", "l", "4"), ("3", "d", "7", "g", "a"), ("4", "e", "8", "h", "a"), ("5", "f", "9", "k", "a")]
    t = spark.createDataFrame(typos, "a string, b string, c string, d string, e string")
    for x, y, rows, groups, all_ in (([0], [1], 8, 6, 6), ([0], [2], 3, 2, 6), ([1], [3], 3, 2, 6), ([0, 1], [2, 3], 3, 2, 6), ([2], [0], 4, 4, 8), ([4], [0], 5, 2, 5)):
        r = inclusion.verify(t, x, t, y).summary.first()
        assert (r["num_rows_violating"], r["num_clusters_violating"]) == (rows, groups) and math.isclose(r["error"], groups / all_)
    with pytest.raises(ConfigError):
        inclusion.verify(t, [0], t.limit(0), [1])
    nary = {(tuple(r["lhs"]), tuple(r["rhs"])) for r in inclusion.nary({"t": three}, 3).collect()}
    assert (("c3", "c4", "c5"), ("c0", "c1", "c2")) in nary


def test_conditional(spark):
    df = spark.createDataFrame(TENNIS, "outlook string, temp string, humidity string, windy string, play string")
    check = lambda left, right, conf=1.0: cfd.verify(df, left, right, 1, conf).summary.first()["holds"]
    assert check([("outlook", "overcast")], ("play", "yes"))
    assert check([("temp", "_"), ("outlook", "_"), ("play", "yes")], ("windy", "_")) in (True, False)
    for item in (("temp", "mild"), ("outlook", "rainy"), ("temp", "cool")):
        assert not check([item], ("play", "yes"))
    assert check([("humidity", "normal")], ("play", "yes"), 0.8) and not check([("humidity", "normal")], ("play", "yes"))
    assert not check([], ("play", "yes"))
    mined = {(tuple(sorted(r["lhs"].items())), r["rhs_column"], r["rhs_value"]) for r in cfd.mine(df, min_support=4).collect()}
    assert ((("outlook", "overcast"),), "play", "yes") in mined


def test_dynamic_equals_static(spark, table):
    from pyspark.sql import functions as F

    df = table.coalesce(1).withColumn("id", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    state = DynamicFD(df.where("id < 9"), "id", ["Col1"], ["Col2"])
    state.apply(insert=df.where("id >= 9"))
    state.apply(delete=spark.createDataFrame([(0,), (3,)], "id long"), update=df.where("id = 5").withColumn("Col2", F.lit("2")))
    now = df.where("id not in (0, 3)").withColumn("Col2", F.when(F.col("id") == 5, "2").otherwise(F.col("Col2")))
    want, got = fd.verify(now, ["Col1"], ["Col2"]).summary.first(), state.verdict().first()
    assert tuple(want) == tuple(got)
    for bad in ({"delete": spark.createDataFrame([(99,)], "id long")}, {"insert": df.where("id = 5")}):
        with pytest.raises(ConfigError):
            state.apply(**bad)


def test_bad_options(table):
    for call in (lambda: fd.verify(table, [9], [1]), lambda: fd.verify(table, [1, 1], [2]), lambda: fd.mine(table, error=2), lambda: fd.discover(table, algorithm="x")):
        with pytest.raises(ConfigError):
            call()
