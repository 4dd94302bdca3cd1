"""Order, pair, rule, graph and sequence patterns on small tables."""

import itertools
import random

import pytest

from stratalens import ConfigError, queries
from stratalens.functions import similarity
from stratalens.operators import episodes, graphs, order, pairs, rules, stats
from stratalens.sources import tables


def test_sequence_edits():
    y = [0, 5, 10, 20, 40, 45, 55, 65, 70]
    assert order.sequence_edits(y, 0, 10)[0] == 1 and order.sequence_edits(y, 0, 10)[2] == [(3, 4)]
    assert order.sequence_edits(y, 0, float("inf"))[0] == 0
    for low, high, ops in ((4, 5, 6), (4, 4, 8), (15, 25, 4), (10, 15, 4)):
        assert order.sequence_edits(y, low, high)[0] == ops


def test_sequential_verdict(spark):
    df = spark.createDataFrame(list(zip(range(1, 10), [0, 5, 10, 20, 40, 45, 55, 65, 70])), "x int, y int")
    r = order.verify_sequential(df, "x", "y", 0, 10).first()
    assert r["ops"] == 1 and abs(r["confidence"] - 8 / 9) < 1e-9
    assert order.verify_sequential(df, "x", "y", 0, -1).first()["ops"] == 0
    with pytest.raises(ConfigError):
        order.verify_sequential(df, "x", "y", 5, 4)


@pytest.mark.parametrize("seed", range(3))
def test_removal_set_is_smallest(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 1), rng.randint(0, 4), rng.randint(0, 4)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, k int, l int, r int")
    got = {x["id"] for x in order.oc_removal_set(df, "id", ["k"], "l", "r").collect()}

    def fine(keep):
        return not any(a[1] == b[1] and a[2] < b[2] and a[3] > b[3] for a in keep for b in keep)

    least = min(len(gone) for n in range(10) for gone in itertools.combinations(range(9), n) if fine([r for r in rows if r[0] not in gone]))
    assert len(got) == least and fine([r for r in rows if r[0] not in got])


def test_list_orders(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 2, 4), (3, 3, 3)], "a int, b int, c int")
    found = {(tuple(r["lhs"]), tuple(r["rhs"])) for r in order.mine_list_based(df, max_size=1).collect()}
    assert found == {(("a",), ("b",)), (("b",), ("a",))}
    assert order.orders(df, ["a"], ["c"]).first()["swap"]


#: Fixed rows.
DC_ROWS = [("NewYork", 3000, 0.2), ("NewYork", 4000, 0.25), ("NewYork", 5000, 0.3), ("Wisconsin", 5000, 0.15), ("Wisconsin", 6000, 0.2), ("Wisconsin", 4000, 0.1), ("Texas", 1000, 0.15), ("Texas", 2000, 0.25), ("Texas", 3000, 0.3), ("Texas", 3000, 0.31)]


def test_denial(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(DC_ROWS, 2)], "id int, State string, Salary int, FedTaxRate double")
    strict = "!(s.Salary < t.Salary and s.State == t.State and s.FedTaxRate > t.FedTaxRate)"
    loose = "!(s.Salary <= t.Salary and s.State == t.State and s.FedTaxRate >= t.FedTaxRate)"
    assert pairs.verify_dc(df, strict).first()["holds"] and not pairs.verify_dc(df, loose).first()["holds"]
    assert {tuple(sorted(r)) for r in pairs.violations(df, loose, "id").collect()} == {(10, 11)}
    bits = spark.createDataFrame([(2, 1, 1, 1, 1), (3, 0, 0, 0, 1), (4, 0, 0, 1, 0), (5, 0, 1, 0, 1), (6, 0, 1, 1, 0), (7, 0, 0, 0, 0)], "id int, A int, B int, C int, D int")
    bad = pairs.violations(bits, "!(s.A == t.B and s.B == t.C and s.C == t.D)", "id")
    assert bad.count() > 0
    with pytest.raises(ConfigError):
        pairs.parse_dc("t.A == s.B", ["A", "B"])


@pytest.mark.parametrize("seed", range(4))
def test_denial_plans_agree_with_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randint(0, 2), rng.randint(0, 3), rng.randint(0, 3)) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, k int, a int, b int")
    at = {"k": 1, "a": 2, "b": 3}
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}
    for preds in ([("k", "=="), ("a", "==")], [("k", "=="), ("a", "!=")], [("k", "=="), ("a", "<="), ("b", ">")], [("k", "=="), ("a", "<"), ("b", ">=")], [("a", ">="), ("b", ">=")], [("a", ">"), ("b", "<=")]):
        text = "!(" + " and ".join(f"t.{c} {op} s.{c}" for c, op in preds) + ")"
        bad = any(all(test[op](t[at[c]], s[at[c]]) for c, op in preds) for t in rows for s in rows if t[0] != s[0])
        assert pairs.verify_dc(df, text).first()["holds"] == (not bad), text


def test_differential_and_matching(spark):
    df = spark.createDataFrame([(1, 1, "abc"), (2, 1, "abd"), (9, 5, "xyz")], "a int, b int, s string")
    r = pairs.verify_dd(df, {"a": (0, 1)}, {"b": (0, 0), "s": (0, 1)}).first()
    assert r["holds"] and r["lhs_pairs"] == 1
    assert not pairs.verify_dd(df, {"a": (0, 9)}, {"b": (0, 0)}).first()["holds"]
    md = pairs.verify_md(df, None, [pairs.Match("s", "s", "levenshtein", 0.6)], pairs.Match("b", "b", "equality", 1.0)).summary.first()
    assert md["holds"] and md["matched_pairs"] == 5
    assert pairs.mine_dds(df, {"a": [(0, 1)], "b": [(0, 0)]}).count() == 2


def test_similarities():
    assert similarity.lcs_length("abcde", "ace") == 3
    assert similarity.monge_elkan_of("a b", "a b") == 1.0
    assert similarity.alignment_similarity("abc", "abc") == 1.0
    assert abs(similarity.qgram_cosine_distance("abc", "abc")) < 1e-9


def test_metric(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, "ab"), (1, 3.0, 4.0, "abcd"), (2, 1.0, 1.0, "x")], "k int, x double, y double, s string")
    assert pairs.verify_metric(df, ["k"], ["x", "y"], 5).summary.first()["max_diameter"] == 5.0
    assert pairs.verify_metric(df, ["k"], ["s"], 1, "levenshtein").summary.first()["violating_groups"] == 1
    assert pairs.verify_metric(df, ["k"], ["x"], 3).summary.first()["holds"]


#: Fixed rows.
BOOK = [(1, "Bread"), (1, "Butter"), (3, "Cheese"), (2, "Eggs"), (1, "Milk"), (2, "Milk"), (2, "Yogurt"), (3, "Bread"), (3, "Eggs"), (3, "Milk"), (4, "Eggs"), (4, "Milk"), (4, "Yogurt"), (5, "Cheese"), (5, "Milk"), (5, "Yogurt")]


def test_association_rules(spark):
    baskets = tables.baskets_from_rows(spark.createDataFrame(BOOK, "tid int, item string"), "tid", "item")
    by: dict = {}
    for t, i in BOOK:
        by.setdefault(t, set()).add(i)
    items = sorted({i for _, i in BOOK})
    want = {}
    for k in range(1, 4):
        for s in itertools.combinations(items, k):
            n = sum(set(s) <= b for b in by.values())
            if n >= 2:
                want[s] = n
    assert {tuple(r["items"]): r["count"] for r in rules.frequent_itemsets(baskets, 0.4).collect()} == want
    found = {(tuple(r["lhs"]), tuple(r["rhs"])): r["confidence"] for r in rules.association_rules(baskets, 0.4, 0.6).collect()}
    for (x, y), c in found.items():
        assert abs(c - want[tuple(sorted(x + y))] / want[x]) < 1e-9 and c >= 0.6
    r = rules.verify_rule(baskets, ["Eggs"], ["Milk"]).first()
    assert r["ar_holds"] and r["satisfying"] == 3


def test_algebraic(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (10, 30)], "a int, b int")
    found = rules.algebraic_constraints(df, "-", weight=0.3).collect()
    assert [(r["low"], r["high"], r["n"]) for r in found] == [(-20.0, -20.0, 1), (-1.0, -1.0, 2)]
    assert rules.algebraic_exceptions(df, "a", "b", "-", [(-1, -1)]).count() == 1
    assert rules.sample_size(3, 0.9, 0.0) == -1 < rules.sample_size(3, 0.9, 0.1)


def test_graph_patterns(spark):
    v = spark.createDataFrame([(1, "a", {"n": "x"}), (2, "b", {"n": "x"}), (3, "b", {"n": "y"})], "id long, label string, attrs map<string,string>")
    e = spark.createDataFrame([(1, 2, "r"), (1, 3, "r")], "src long, dst long, label string")
    p = graphs.Pattern(("a", "b"), ((0, 1, "r"),))
    good, bad = graphs.GFD(p, (), (graphs.Literal(0, "n", -1, "x"),)), graphs.GFD(p, (), (graphs.Literal(0, "n", 1, "n"),))
    assert graphs.valid_gfds(v, e, [good, bad]) == [good]
    assert [tuple(r) for r in graphs.gfd_violations(v, e, bad).collect()] == [(1, 3)]
    assert graphs.embeddings(v, e, graphs.Pattern(("b", "a", "b"), ((0, 1, "r"), (1, 2, "r")))).count() == 2
    far = graphs.GDD(p, (), (graphs.Distance(0, "n", "<=", 0, 1, "n", "edit"),))
    assert graphs.gdd_violations(v, e, far).count() == 1
    back = tables.parse_dot(spark, tables.format_dot(v, e))
    assert back[0].count() == 3 and back[1].count() == 2


def test_mined_gfds_have_every_frequent_constant(spark):
    """Seven values of support two: each is the premise of a rule, not the five most frequent alone."""
    rows = [(2 * i + j, "p", {"x": f"x{i}", "y": f"y{i}"}) for i in range(7) for j in range(2)] + [(20, "p", {"x": "rare", "y": "y0"})]
    v = spark.createDataFrame(rows, "id long, label string, attrs map<string,string>")
    e = spark.createDataFrame([], "src long, dst long, label string")
    found = {(g.premises[0].attr, g.premises[0].value, g.conclusions[0].value) for g, _ in graphs.mine_gfds(v, e, 1, 2)}
    assert found == {("x", f"x{i}", f"y{i}") for i in range(7)} | {("y", f"y{i}", f"x{i}") for i in range(1, 7)}


def test_frequent_subgraphs(spark):
    text = "t # 0\nv 0 A\nv 1 B\nv 2 A\ne 0 1 x\ne 1 2 x\nt # 1\nv 0 B\nv 1 A\nv 2 A\ne 0 1 x\ne 0 2 x\nt # 2\nv 0 A\nv 1 B\ne 0 1 y\n"
    found = graphs.parse_graphs(text)
    assert graphs.parse_graphs(graphs.format_graphs(found))[1][1].edges == found[1][1].edges
    got = {(tuple(sorted(r["labels"])), len(r["edges"])): r["support"] for r in graphs.frequent_subgraphs(graphs.graph_frame(spark, found), 0.6, 2).collect()}
    assert got == {(("A", "B"), 1): 2, (("A", "A", "B"), 2): 2}


def test_deep_subgraphs_read_whole_orders(spark, tmp_path):
    """Lines past the third count: the return flag of the fourth is in every order."""
    rows = [(o, k, "R" if k == 4 else "A", "F") for o in range(5) for k in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["labels"]: r["support"] for r in queries.fsm_gspan_deep(spark, str(tmp_path)).collect()}
    assert got == {"order,AF": 5, "order,RF": 5, "order,AF,AF": 5, "order,AF,RF": 5}


def test_episodes(spark):
    # Fixed lines.
    lines = ["1 3|1", "1|2", "1 2|3", "1|6", "1 2|7", "3|8", "2|9", "4|11"]
    seq = tables.sequence_from_lines(spark, lines)
    data = {int(x.split("|")[1]): set(map(int, x.split("|")[0].split())) for x in lines}

    def support(e, window):
        n = 0
        for start in sorted(data):
            if not set(e[0]) <= data[start]:
                continue
            t, ok = start, True
            for s in e[1:]:
                t = next((u for u in sorted(data) if u > t and set(s) <= data[u]), None)
                if t is None or t - start >= window:
                    ok = False
                    break
            n += ok
        return n

    got = {tuple(tuple(s) for s in r["episode"]): r["support"] for r in episodes.maximal_episodes(seq, 2, 3).collect()}
    assert got and all(support(e, 3) == n >= 2 for e, n in got.items())
    assert not any(a != b and episodes.contains(a, b) for a in got for b in got)
    with pytest.raises(ConfigError):
        tables.sequence_from_lines(spark, ["1|1", "2"])


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, "a b", None), (2.0, "", "x"), (4.0, "Q!", "x"), (None, " z", "y")], "n double, s string, t string")
    d = {r["column"]: r for r in stats.describe(df).collect()}
    assert (d["s"]["num_values"], d["t"]["num_nulls"], d["n"]["num_distinct"]) == (3, 1, 3)
    m = stats.moments(df, ["n"]).first()
    assert m["sum"] == 7.0 and m["geometric_mean"] == pytest.approx(2.0)
    assert [r["value"] for r in stats.quantiles(df, "n", (0.5,)).collect()] == [2.0]
    t = stats.text_summary(df, ["s"]).first()
    assert t["special_char_rows"] == 1 and t["leading_whitespace_rows"] == 1 and t["total_words"] == 4
    assert stats.diacritics(spark.createDataFrame([("é",), ("ee",)], "s string"), "s").first()["diacritic_chars"] == 1


def test_type_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d\n1,2.5,2020-01-02,true\n2,3,2021-02-03,x\n")
    df = tables.read_csv(spark, str(path))
    assert tables.infer_types(df) == {"a": "int", "b": "double", "c": "date", "d": "string"}
    assert dict(tables.cast_inferred(df).dtypes)["c"] == "date"
    assert tables.parse_intervals(["[0;3]"]) == [(0.0, 3.0)]
