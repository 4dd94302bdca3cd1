"""Queries over the test tables, one or more per operator, and their SQL where SQL can express them.

Results hold plain values: column lists are joined by commas and measures
rounded, so that rows compare across engines.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import similarity
from .operators import cfd, cleaning, episodes, fd, graphs, inclusion, order, pairs, rules, stats
from .sources import tables
from .streaming.dynamic import DynamicFD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Arrays of text joined, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, ",")
        elif kind == "double":
            c = F.round(c, digits)
        out.append(c.alias(name))
    return df.select(*out)


# Functional dependencies.

ORDERS_FD = ("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
LINE_FD = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate")
NATION_FD = ("n_nationkey", "n_name", "n_regionkey")
PART_FD = ("p_brand", "p_type", "p_size")


def _candidates(table: str, cols: Sequence[str], max_lhs: int, value: Callable[[str, str], str]) -> str:
    """UNION of (lhs, rhs, e) over all candidate left sides."""
    parts = []
    for a in cols:
        for k in range(max_lhs + 1):
            for xs in combinations([c for c in cols if c != a], k):
                parts.append(f"SELECT {list(xs) if xs else '[]::VARCHAR[]'} AS lhs, '{a}' AS rhs, {value(', '.join(xs) or '0', a)} AS e")
    return "\nUNION ALL ".join(parts)


def _minimal_sql(table: str, cols: Sequence[str], max_lhs: int, error: float, value: Callable[[str, str], str]) -> str:
    return f"""
WITH c AS ({_candidates(table, cols, max_lhs, value)})
SELECT array_to_string(lhs, ',') AS lhs, rhs, round(CAST(e AS DOUBLE), 6) AS error FROM c
WHERE e <= {error} AND NOT EXISTS (SELECT 1 FROM c d WHERE d.e <= {error} AND d.rhs = c.rhs AND len(d.lhs) < len(c.lhs) AND list_has_all(c.lhs, d.lhs))
"""


def _exact(table: str) -> Callable[[str, str], str]:
    count = lambda cols: f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {table}))"
    return lambda x, a: f"CASE WHEN {count(x)} = {count(x + ', ' + a)} THEN 0.0 ELSE 1.0 END"


def _g1(table: str) -> Callable[[str, str], str]:
    group = lambda cols: f"(SELECT coalesce(sum(n * (n - 1) / 2.0), 0) FROM (SELECT count(*) AS n FROM {table} GROUP BY {cols}))"
    one = f"(SELECT count(*) * (count(*) - 1) / 2.0 FROM {table})"
    return lambda x, a: f"CAST(({group(x) if x != '0' else one} - {group(a if x == '0' else x + ', ' + a)}) / {one} AS DOUBLE)"


def _fd_query(table: str, cols: Sequence[str], **how) -> Query:
    return lambda spark, d: plain(fd.discover(read(spark, d, table), cols, **how))


query("fd_discover_orders", _minimal_sql("orders", ORDERS_FD, 2, 0, _exact("orders")))(_fd_query("orders", ORDERS_FD, max_lhs=2))
query("fd_discover_lineitem", _minimal_sql("lineitem", LINE_FD, 2, 0, _exact("lineitem")))(_fd_query("lineitem", LINE_FD, max_lhs=2))
query("fd_discover_nation", _minimal_sql("nation", NATION_FD, 2, 0, _exact("nation")))(_fd_query("nation", NATION_FD, max_lhs=2, algorithm="tane"))
SUPPLIER_FD = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
for _name in ("fun", "dfd", "fdmine", "depminer", "fastfds", "fdep", "aid", "eulerfd"):
    query(f"fd_{_name}", _minimal_sql("supplier", SUPPLIER_FD, 2, 0, _exact("supplier")))(_fd_query("supplier", SUPPLIER_FD, max_lhs=2, algorithm=_name))
query("afd_discover_part", _minimal_sql("part", PART_FD, 2, 0.02, _g1("part")))(_fd_query("part", PART_FD, max_lhs=2, error=0.02, measure="g1", algorithm="pyro"))


def _pair_sql(table: str, x: str, a: str, select: str) -> str:
    return f"""
WITH g AS (SELECT {x} AS x, {a} AS a, count(*) AS c FROM {table} GROUP BY ALL),
     h AS (SELECT x, sum(c)::DOUBLE AS s, count(*) AS nd, max(c)::DOUBLE AS top, sum(c * c)::DOUBLE AS q FROM g GROUP BY x),
     t AS (SELECT count(*)::DOUBLE AS n FROM {table}),
     own AS (SELECT sum(c * c)::DOUBLE AS q, sum(c * ln(c)) AS l, count(*) AS k FROM (SELECT count(*)::DOUBLE AS c FROM {table} GROUP BY {a}))
{select}"""


def _error_sql(table: str, x: str, a: str, expr: str) -> str:
    """A measure of one dependency, as mine() computes it for a non-empty left side."""
    return _pair_sql(table, x, a, f"SELECT {expr} FROM h, t, own GROUP BY t.n, own.q, own.l, own.k").strip()


def _part_error(expr: str) -> Callable[[str, str], str]:
    def value(x: str, a: str) -> str:
        if x == "0":
            return f"(SELECT CASE WHEN count(DISTINCT {a}) <= 1 THEN 0.0 ELSE 1.0 END FROM part)"
        key = "(" + x + ")" if "," in x else x
        return f"({_error_sql('part', key, a, expr)})"

    return value


_PDEP = "sum(h.q / h.s) / t.n"
_OWN = "(own.q / (t.n * t.n))"
_MEASURE_SQL = {
    "pdep": f"1 - {_PDEP}",
    "tau": f"CASE WHEN {_OWN} = 1 THEN 0 ELSE 1 - ({_PDEP} - {_OWN}) / (1 - {_OWN}) END",
    "mu_plus": f"CASE WHEN {_OWN} = 1 OR count(*) = t.n THEN 0 ELSE 1 - greatest(0, 1 - (1 - {_PDEP}) / (1 - {_OWN}) * (t.n - 1) / (t.n - count(*))) END",
    "rho": "1 - count(*)::DOUBLE / sum(h.nd)",
}
for _name, _sql in _MEASURE_SQL.items():
    query(f"afd_measure_{_name}", _minimal_sql("part", PART_FD, 2, 0.9, _part_error(_sql)))(_fd_query("part", PART_FD, max_lhs=2, error=0.9, measure=_name, algorithm="tane"))


def _pfd_error(expr: str) -> Callable[[str, str], str]:
    inner = _part_error(expr)
    return lambda x, a: f"(SELECT 1 - max(c)::DOUBLE / sum(c) FROM (SELECT count(*) AS c FROM part GROUP BY {a}))" if x == "0" else inner(x, a)


for _name, _sql in {"per_tuple": "1 - sum(h.top) / t.n", "per_value": "1 - avg(h.top / h.s)"}.items():
    query(f"pfd_discover_{_name}", _minimal_sql("part", PART_FD, 2, 0.6, _pfd_error(_sql)))(_fd_query("part", PART_FD, max_lhs=2, error=0.6, measure=_name, algorithm="pfdtane"))


@query(
    "fd_verify",
    _pair_sql(
        "orders", "o_custkey", "o_orderstatus",
        """SELECT count(*) FILTER (nd > 1) = 0 AS holds, round(coalesce(sum(s * s - h.q) FILTER (nd > 1), 0) / (t.n * (t.n - 1)), 9) AS error,
       count(*) FILTER (nd > 1) AS num_error_clusters, CAST(coalesce(sum(s) FILTER (nd > 1), 0) AS BIGINT) AS num_error_rows FROM h, t GROUP BY t.n""",
    ),
)
def fd_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.verify(read(spark, d, "orders"), ["o_custkey"], ["o_orderstatus"]).summary, 9)


@query("fd_violations", _pair_sql("part", "p_brand", "p_size", "SELECT x AS brand, CAST(s AS BIGINT) AS size, nd AS num_distinct_rhs, round(top / s, 6) AS proportion FROM h WHERE nd > 1"))
def fd_violations(spark: SparkSession, d: str) -> DataFrame:
    v = fd.verify(read(spark, d, "part"), ["p_brand"], ["p_size"], order="size").violations
    return plain(v.select(F.col("lhs.p_brand").alias("brand"), "size", "num_distinct_rhs", "proportion"))


@query("fd_violating_rows", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1)")
def fd_violating_rows(spark: SparkSession, d: str) -> DataFrame:
    return fd.violating_rows(read(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"]).select("o_orderkey")


@query("pfd_verify", _pair_sql("part", "p_brand", "p_type", "SELECT round(1 - sum(top) / t.n, 6) AS error, count(*) FILTER (nd > 1) AS num_violating_clusters, CAST(sum(s - top) FILTER (nd > 1) AS BIGINT) AS num_violating_rows FROM h, t GROUP BY t.n"))
def pfd_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.verify_pfd(read(spark, d, "part"), ["p_brand"], ["p_type"]).summary)


@query(
    "afd_metrics",
    _pair_sql(
        "part", "p_brand", "p_type",
        f"""SELECT round(sum(s * s - h.q) / (t.n * (t.n - 1)), 6) AS g1, round(sum(s) FILTER (nd > 1) / t.n, 6) AS g2, round({_PDEP}, 6) AS pdep,
       round(({_PDEP} - {_OWN}) / (1 - {_OWN}), 6) AS tau,
       round(greatest(0, 1 - (1 - {_PDEP}) / (1 - {_OWN}) * (t.n - 1) / (t.n - count(*))), 6) AS mu_plus, round(count(*)::DOUBLE / sum(nd), 6) AS rho,
       round(((ln(t.n) - sum(s * ln(s)) / t.n) + (ln(t.n) - own.l / t.n) - (ln(t.n) - (SELECT sum(c * ln(c)) FROM g) / t.n)) / (ln(t.n) - own.l / t.n), 6) AS fi
       FROM h, t, own GROUP BY t.n, own.q, own.l, own.k""",
    ),
)
def afd_metrics(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.metrics(read(spark, d, "part"), ["p_brand"], ["p_type"]))


@query("nd_verify", "WITH g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS w FROM orders GROUP BY 1) SELECT max(w) <= 3 AS holds, max(w) AS real_weight, min(w) AS global_min_weight FROM g")
def nd_verify(spark: SparkSession, d: str) -> DataFrame:
    return fd.numerical_dependency(read(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"], 3).summary


@query("sfd_cords")
def sfd_cords(spark: SparkSession, d: str) -> DataFrame:
    return fd.soft_dependencies(read(spark, d, "part"))


# Unique column combinations.


def _ucc_sql(table: str, cols: Sequence[str], size: int, error: float) -> str:
    parts = [
        f"SELECT {list(xs)} AS u, (SELECT coalesce(sum(c * (c - 1)), 0)::DOUBLE FROM (SELECT count(*) AS c FROM {table} GROUP BY {', '.join(xs)})) / (SELECT count(*) * (count(*) - 1)::DOUBLE FROM {table}) AS e"
        for k in range(1, size + 1) for xs in combinations(cols, k)
    ]
    return f"WITH c AS ({' UNION ALL '.join(parts)}) SELECT array_to_string(u, ',') AS ucc, round(e, 6) AS error FROM c WHERE e <= {error} AND NOT EXISTS (SELECT 1 FROM c d WHERE d.e <= {error} AND len(d.u) < len(c.u) AND list_has_all(c.u, d.u))"


@query("ucc_discover", _ucc_sql("lineitem", LINE_FD, 2, 0))
def ucc_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.discover_uccs(read(spark, d, "lineitem"), LINE_FD, 2))


KEY_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
for _name in ("hyucc", "hpivalid"):

    @query(f"ucc_{_name}", _ucc_sql("lineitem", KEY_COLUMNS, 3, 0))
    def ucc_named(spark: SparkSession, d: str, algorithm: str = _name) -> DataFrame:
        return plain(fd.discover_uccs(read(spark, d, "lineitem"), KEY_COLUMNS, 3, algorithm=algorithm))


@query("aucc_discover", _ucc_sql("part", PART_FD, 3, 0.01))
def aucc_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.discover_uccs(read(spark, d, "part"), PART_FD, 3, 0.01))


@query("ucc_verify", "WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_returnflag) SELECT count(*) FILTER (c > 1) = 0 AS holds, round(sum(c * (c - 1))::DOUBLE / (sum(c)::DOUBLE * (sum(c) - 1)), 9) AS error, count(*) FILTER (c > 1) AS num_clusters_violating, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS num_rows_violating FROM g")
def ucc_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(fd.verify_ucc(read(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"]).summary, 9)


# Inclusion dependencies.

IND_COLUMNS = {"orders": ["o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey", "s_nationkey"]}


def _ind_sql(error: float) -> str:
    ids = [(t, c) for t, cs in IND_COLUMNS.items() for c in cs]
    vals = " UNION ".join(f"SELECT {i} AS id, CAST({c} AS VARCHAR) AS v FROM {t}" for i, (t, c) in enumerate(ids))
    names = ", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(ids))
    return f"""
WITH v AS ({vals}), n(id, t, c) AS (VALUES {names}), s AS (SELECT id, count(*) AS k FROM v GROUP BY id),
m AS (SELECT a.id AS l, b.id AS r, count(*) AS k FROM v a JOIN v b ON a.v IS NOT DISTINCT FROM b.v AND a.id <> b.id GROUP BY ALL)
SELECT x.t AS lhs_table, x.c AS lhs_column, y.t AS rhs_table, y.c AS rhs_column, round(1 - m.k / s.k::DOUBLE, 6) AS error
FROM m JOIN s ON m.l = s.id JOIN n x ON x.id = l JOIN n y ON y.id = r WHERE 1 - m.k / s.k::DOUBLE <= {error}
"""


def _ind_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: read(spark, d, t) for t in IND_COLUMNS}


@query("ind_discover", _ind_sql(0))
def ind_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(inclusion.unary(_ind_tables(spark, d), 0.0, IND_COLUMNS))


@query("aind_discover", _ind_sql(0.5))
def aind_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(inclusion.unary(_ind_tables(spark, d), 0.5, IND_COLUMNS))


NARY_COLUMNS = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "supplier": ["s_suppkey", "s_nationkey"], "nation": ["n_nationkey", "n_regionkey"]}


@query("ind_nary")
def ind_nary(spark: SparkSession, d: str) -> DataFrame:
    return plain(inclusion.nary({t: read(spark, d, t) for t in NARY_COLUMNS}, 2, 0.0, NARY_COLUMNS, screen=True))


@query(
    "ind_verify",
    """WITH l AS (SELECT s_suppkey AS v, count(*) AS n FROM supplier GROUP BY 1), m AS (SELECT * FROM l WHERE v NOT IN (SELECT c_custkey FROM customer))
SELECT (SELECT count(*) FROM m) = 0 AS holds, round((SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM l), 6) AS error,
       (SELECT count(*) FROM m) AS num_clusters_violating, CAST((SELECT coalesce(sum(n), 0) FROM m) AS BIGINT) AS num_rows_violating""",
)
def ind_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(inclusion.verify(read(spark, d, "supplier"), ["s_suppkey"], read(spark, d, "customer"), ["c_custkey"]).summary)


@query(
    "aind_verify",
    """WITH l AS (SELECT c_nationkey AS a, c_custkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT * FROM l ANTI JOIN supplier ON a = s_nationkey AND b = s_suppkey)
SELECT (SELECT count(*) FROM m) = 0 AS holds, round((SELECT count(*) FROM m)::DOUBLE / (SELECT count(*) FROM l), 6) AS error,
       (SELECT count(*) FROM m) AS num_clusters_violating, CAST((SELECT coalesce(sum(n), 0) FROM m) AS BIGINT) AS num_rows_violating""",
)
def aind_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(inclusion.verify(read(spark, d, "customer"), ["c_nationkey", "c_custkey"], read(spark, d, "supplier"), ["s_nationkey", "s_suppkey"]).summary)


@query(
    "cind_verify",
    """WITH r AS (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS i, c_mktsegment = 'BUILDING' AS m FROM customer),
k AS (SELECT count(*) FILTER (m) AS s, count(*) FILTER (i) AS n, count(*) FILTER (i AND m) AS b FROM r)
SELECT b::DOUBLE / s >= 0.5 AND b::DOUBLE / n >= 0.1 AS holds, s > 0 AS has_support, round(b::DOUBLE / s, 6) AS real_validity, round(b::DOUBLE / n, 6) AS real_completeness,
       s AS supporting_baskets, n AS included_baskets, b AS included_support_baskets FROM k""",
)
def cind_verify(spark: SparkSession, d: str) -> DataFrame:
    v = inclusion.verify_conditional(read(spark, d, "customer"), ["c_custkey"], read(spark, d, "orders"), ["o_custkey"], {"c_mktsegment": "BUILDING"}, 0.5, 0.1)
    return plain(v.summary)


@query(
    "cind_discover",
    """WITH r AS (SELECT c_custkey IN (SELECT o_custkey FROM orders) AS i, c_mktsegment AS m FROM customer), t AS (SELECT count(*) FILTER (i) AS n FROM r)
SELECT 'c_mktsegment=' || m AS condition, round(count(*) FILTER (i)::DOUBLE / count(*), 6) AS validity, round(count(*) FILTER (i)::DOUBLE / t.n, 6) AS completeness
FROM r, t WHERE m IS NOT NULL GROUP BY m, t.n HAVING count(*) FILTER (i) >= 0.5 * count(*) AND count(*) FILTER (i) >= 0.1 * t.n""",
)
def cind_discover(spark: SparkSession, d: str) -> DataFrame:
    found = inclusion.mine_conditions(read(spark, d, "customer"), ["c_custkey"], read(spark, d, "orders"), ["o_custkey"], ["c_mktsegment"], 0.5, 0.1, 1)
    return plain(found.select(F.array_join(F.transform(F.map_entries("condition"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("condition"), "validity", "completeness"))


# Conditional functional dependencies.


@query(
    "cfd_verify",
    """WITH g AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL), h AS (SELECT sum(c) AS s, max(c) AS t FROM g GROUP BY o_custkey)
SELECT sum(t)::DOUBLE / sum(s) >= 0.4 AS holds, CAST(sum(s) AS BIGINT) AS support, round(sum(t)::DOUBLE / sum(s), 6) AS confidence FROM h""",
)
def cfd_verify(spark: SparkSession, d: str) -> DataFrame:
    v = cfd.verify(read(spark, d, "orders"), [("o_orderstatus", "O"), ("o_custkey", "_")], ("o_orderpriority", "_"), 1, 0.4)
    return plain(v.summary)


@query(
    "cfd_discover",
    """WITH g AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS c FROM lineitem GROUP BY ALL), n AS (SELECT sum(c) AS n FROM g),
a AS (SELECT f, sum(c) AS t, max(c) AS m, arg_max(s, c) AS v FROM g GROUP BY f), b AS (SELECT s, sum(c) AS t, max(c) AS m, arg_max(f, c) AS v FROM g GROUP BY s),
z AS (SELECT '' AS lhs, 'l_linestatus' AS c, arg_max(s, t) AS v, max(t) AS m, sum(t) AS t FROM b UNION ALL SELECT '', 'l_returnflag', arg_max(f, t), max(t), sum(t) FROM a),
r AS (SELECT lhs, c AS rhs_column, v AS rhs_value, t, m FROM z
 UNION ALL SELECT 'l_returnflag=_', 'l_linestatus', '_', sum(t), sum(m) FROM a UNION ALL SELECT 'l_linestatus=_', 'l_returnflag', '_', sum(t), sum(m) FROM b
 UNION ALL SELECT 'l_returnflag=' || f, 'l_linestatus', v, t, m FROM a UNION ALL SELECT 'l_linestatus=' || s, 'l_returnflag', v, t, m FROM b)
SELECT lhs, rhs_column, rhs_value, CAST(t AS BIGINT) AS support, round(m::DOUBLE / t, 6) AS confidence FROM r WHERE t >= 100 AND m >= 0.45 * t""",
)
def cfd_discover(spark: SparkSession, d: str) -> DataFrame:
    found = cfd.mine(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], 100, 0.45, 1)
    lhs = F.array_join(F.array_sort(F.transform(F.map_entries("lhs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return plain(found.select(lhs.alias("lhs"), "rhs_column", "rhs_value", "support", "confidence"))


# Order and sequential dependencies.


@query(
    "od_swaps",
    """WITH e AS (SELECT l_returnflag AS ctx, l_quantity AS l, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY ALL),
w AS (SELECT *, max(hi) OVER (PARTITION BY ctx ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT ctx, l AS quantity, lo, before FROM w WHERE before > lo""",
)
def od_swaps(spark: SparkSession, d: str) -> DataFrame:
    found = order.swaps(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return found.select(F.col("context.l_returnflag").alias("ctx"), F.col("left").alias("quantity"), "lo", "before")


@query(
    "od_ofd_removal",
    """WITH g AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY ALL), t AS (SELECT p_brand, max({'c': c, 's': p_size}).s AS s FROM g GROUP BY 1)
SELECT p_partkey AS id FROM part JOIN t USING (p_brand) WHERE p_size <> s""",
)
def od_ofd_removal(spark: SparkSession, d: str) -> DataFrame:
    return order.ofd_removal_set(read(spark, d, "part"), "p_partkey", ["p_brand"], "p_size")


@query("od_verify")
def od_verify(spark: SparkSession, d: str) -> DataFrame:
    v = order.verify_set_based(read(spark, d, "part"), "p_partkey", oc=(["p_brand"], "p_size", "p_retailprice"), error=0.9)
    return plain(v.summary)


def _set_based_sql(table: str, cols: Sequence[str]) -> str:
    """Candidates of contexts of one column at most: (kind, context, left, right, descending, ok)."""
    parts = []
    for ctx in [(), *((c,) for c in cols)]:
        same = " AND ".join(["true", *(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in ctx)])
        listed = f"{list(ctx)}::VARCHAR[]"
        for a in cols:
            if a not in ctx:
                parts.append(f"SELECT 'ofd' AS kind, {listed} AS context, NULL::VARCHAR AS l, '{a}' AS r, false AS down, NOT EXISTS (SELECT 1 FROM {table} s JOIN {table} t ON {same} AND s.{a} < t.{a}) AS ok")
        for a, b in combinations([c for c in cols if c not in ctx], 2):
            for down in (False, True):
                parts.append(f"SELECT 'oc', {listed}, '{a}', '{b}', {str(down).lower()}, NOT EXISTS (SELECT 1 FROM {table} s JOIN {table} t ON {same} AND s.{a} < t.{a} AND s.{b} {'<' if down else '>'} t.{b})")
    return f"""WITH c AS ({' UNION ALL '.join(parts)}), f AS (SELECT * FROM c WHERE ok AND kind = 'ofd' AND NOT EXISTS (SELECT 1 FROM c d WHERE d.ok AND d.kind = 'ofd' AND d.r = c.r AND len(d.context) < len(c.context) AND list_has_all(c.context, d.context))),
o AS (SELECT * FROM c WHERE ok AND kind = 'oc' AND NOT EXISTS (SELECT 1 FROM f WHERE f.r IN (c.l, c.r) AND list_has_all(c.context, f.context)))
SELECT kind, array_to_string(context, ',') AS context, l AS "left", r AS "right", down AS descending FROM (SELECT * FROM f UNION ALL SELECT * FROM o WHERE NOT EXISTS (
SELECT 1 FROM o p WHERE p.l = o.l AND p.r = o.r AND p.down = o.down AND len(p.context) < len(o.context) AND list_has_all(o.context, p.context)))"""


@query("od_discover_set_based", _set_based_sql("nation", NATION_FD))
def od_discover_set_based(spark: SparkSession, d: str) -> DataFrame:
    return plain(order.mine_set_based(read(spark, d, "nation"), max_context=1))


def _orders_sql(table: str, cols: Sequence[str]) -> str:
    """Single columns x, y where a smaller x always means a smaller y."""
    return " UNION ALL ".join(f"SELECT '{x}' AS lhs, '{y}' AS rhs WHERE NOT EXISTS (SELECT 1 FROM {table} s JOIN {table} t ON s.{x} < t.{x} AND s.{y} >= t.{y})" for x in cols for y in cols if x != y)


@query("od_discover_list_region", _orders_sql("region", ("r_regionkey", "r_name")))
def od_discover_list_region(spark: SparkSession, d: str) -> DataFrame:
    return plain(order.mine_list_based(read(spark, d, "region"), ["r_regionkey", "r_name"], 1))


@query("od_discover_list_based")
def od_discover_list_based(spark: SparkSession, d: str) -> DataFrame:
    return plain(order.mine_list_based(read(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"], 2))


@query(
    "od_list_valid",
    """WITH e AS (SELECT o_orderkey AS x, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1),
w AS (SELECT *, max(hi) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e)
SELECT count(*) FILTER (b >= lo) = 0 AS valid, count(*) FILTER (b > lo) > 0 AS swap, count(*) FILTER (b = lo) > 0 AS merge FROM w""",
)
def od_list_valid(spark: SparkSession, d: str) -> DataFrame:
    return order.orders(read(spark, d, "orders"), ["o_orderkey"], ["o_custkey"])


@query("sd_verify")
def sd_verify(spark: SparkSession, d: str) -> DataFrame:
    out = order.verify_sequential(read(spark, d, "events"), "event_id", "value", 0, 200, ["user_id"])
    return plain(out.select("group", "n", "ops", "confidence"))


# Denial, differential, matching and metric dependencies.

DC_TEXT = "!(t.p_brand == s.p_brand and t.p_size < s.p_size and t.p_retailprice > s.p_retailprice)"


@query("dc_verify", "SELECT NOT EXISTS (SELECT 1 FROM part t JOIN part s ON t.p_brand = s.p_brand AND t.p_size < s.p_size AND t.p_retailprice > s.p_retailprice) AS holds")
def dc_verify(spark: SparkSession, d: str) -> DataFrame:
    return pairs.verify_dc(read(spark, d, "part"), DC_TEXT)


@query("dc_violations", "SELECT t.p_partkey AS first, s.p_partkey AS second FROM part t JOIN part s ON t.p_brand = s.p_brand AND t.p_size = s.p_size AND t.p_retailprice > s.p_retailprice AND t.p_partkey <> s.p_partkey")
def dc_violations(spark: SparkSession, d: str) -> DataFrame:
    return pairs.violations(read(spark, d, "part"), "!(t.p_brand == s.p_brand and t.p_size == s.p_size and t.p_retailprice > s.p_retailprice)", "p_partkey")


@query("dc_equality", "SELECT NOT EXISTS (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate, o_orderstatus HAVING count(*) > 1) AS holds")
def dc_equality(spark: SparkSession, d: str) -> DataFrame:
    return pairs.verify_dc(read(spark, d, "orders"), "!(t.o_custkey == s.o_custkey and t.o_orderdate == s.o_orderdate and t.o_orderstatus == s.o_orderstatus)")


@query("dc_one_inequality", "SELECT NOT EXISTS (SELECT 1 FROM nation GROUP BY n_regionkey HAVING min(n_nationkey) < max(n_nationkey)) AS holds")
def dc_one_inequality(spark: SparkSession, d: str) -> DataFrame:
    return pairs.verify_dc(read(spark, d, "nation"), "!(t.n_regionkey == s.n_regionkey and t.n_nationkey != s.n_nationkey)")


@query("dc_one_tuple", "SELECT count(*) = 0 AS holds FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05")
def dc_one_tuple(spark: SparkSession, d: str) -> DataFrame:
    return pairs.verify_dc(read(spark, d, "lineitem"), "!(t.l_discount > 0.05 and t.l_tax > 0.05)")


@query("adc_discover")
def adc_discover(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mine_dcs(read(spark, d, "nation"), ["n_nationkey", "n_regionkey"], 0.01)


@query(
    "dd_verify",
    """WITH p AS (SELECT abs(a.s_nationkey - b.s_nationkey) <= 2 AS l, abs(a.s_acctbal - b.s_acctbal) <= 5000 AS r FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey)
SELECT count(*) FILTER (l AND NOT r) = 0 AS holds, round(count(*) FILTER (l AND NOT r)::DOUBLE / count(*) FILTER (l), 6) AS error, count(*) FILTER (l) AS lhs_pairs, count(*) FILTER (l AND NOT r) AS violating_pairs FROM p""",
)
def dd_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(pairs.verify_dd(read(spark, d, "supplier"), {"s_nationkey": (0, 2)}, {"s_acctbal": (0, 5000)}))


@query("dd_discover")
def dd_discover(spark: SparkSession, d: str) -> DataFrame:
    limits = {"n_nationkey": [(0, 5), (0, 12), (0, 24)], "n_regionkey": [(0, 0), (0, 2), (0, 4)], "n_name": [(0, 3), (0, 10), (0, 20)]}
    found = pairs.mine_dds(read(spark, d, "nation"), limits)
    return found.select(F.array_join(F.array_sort(F.transform(F.map_entries("lhs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("lhs"), "rhs_column", "rhs_interval")


_LEV = "(1 - levenshtein(a.{0}, b.{0})::DOUBLE / greatest(length(a.{0}), length(b.{0})))"


@query(
    "md_verify",
    f"""WITH p AS (SELECT {_LEV.format('n_name')} AS l, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 0.0 END AS r FROM nation a, nation b)
SELECT coalesce(min(r), 1) >= 1 AS holds, CAST(coalesce(min(r), 1) AS DOUBLE) AS true_rhs_bound, count(*) AS matched_pairs FROM p WHERE l >= 0.8""",
)
def md_verify(spark: SparkSession, d: str) -> DataFrame:
    v = pairs.verify_md(read(spark, d, "nation"), None, [pairs.Match("n_name", "n_name", "levenshtein", 0.8)], pairs.Match("n_regionkey", "n_regionkey", "equality", 1.0))
    return plain(v.summary)


@query("md_discover")
def md_discover(spark: SparkSession, d: str) -> DataFrame:
    matches = [pairs.Match("n_name", "n_name", "levenshtein"), pairs.Match("n_regionkey", "n_regionkey", "equality"), pairs.Match("n_nationkey", "n_nationkey", "number")]
    found = pairs.mine_mds(read(spark, d, "nation"), None, matches)
    return found.select(F.to_json("lhs").alias("lhs"), "rhs", "bound", "support")


@query(
    "similarity_measures",
    f"""SELECT a.r_name AS x, b.r_name AS y, round({_LEV.format('r_name')}, 6) AS levenshtein, CASE WHEN a.r_name = b.r_name THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS jaccard FROM region a, region b""",
)
def similarity_measures(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region")
    both = r.select(F.col("r_name").alias("x")).join(r.select(F.col("r_name").alias("y")))
    return plain(both.select("x", "y", similarity.measure("levenshtein")(F.col("x"), F.col("y")).alias("levenshtein"), similarity.measure("jaccard")(F.col("x"), F.col("y")).alias("jaccard")))


@query("similarity_python")
def similarity_python(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "region")
    both = r.select(F.col("r_name").alias("x")).join(r.select(F.col("r_name").alias("y")))
    return plain(both.select("x", "y", *[similarity.measure(m)(F.col("x"), F.col("y")).alias(m) for m in ("lcs", "monge_elkan")]))


@query("mfd_numeric", "WITH g AS (SELECT max(p_retailprice) - min(p_retailprice) AS g FROM part GROUP BY p_brand) SELECT count(*) FILTER (g > 900) = 0 AS holds, round(max(g), 6) AS max_diameter, count(*) FILTER (g > 900) AS violating_groups FROM g")
def mfd_numeric(spark: SparkSession, d: str) -> DataFrame:
    return plain(pairs.verify_metric(read(spark, d, "part"), ["p_brand"], ["p_retailprice"], 900).summary)


@query(
    "mfd_levenshtein",
    """WITH v AS (SELECT DISTINCT n_regionkey AS k, n_name AS v FROM nation), g AS (SELECT a.k, max(levenshtein(a.v, b.v)) AS g FROM v a JOIN v b USING (k) GROUP BY 1)
SELECT count(*) FILTER (g > 8) = 0 AS holds, CAST(max(g) AS DOUBLE) AS max_diameter, count(*) FILTER (g > 8) AS violating_groups FROM g""",
)
def mfd_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    return plain(pairs.verify_metric(read(spark, d, "nation"), ["n_regionkey"], ["n_name"], 8, "levenshtein").summary)


@query(
    "mfd_plane",
    """WITH g AS (SELECT a.n_regionkey AS k, max(sqrt((a.n_nationkey - b.n_nationkey) ** 2 + (a.l - b.l) ** 2)) AS g
FROM (SELECT *, length(n_name) AS l FROM nation) a JOIN (SELECT *, length(n_name) AS l FROM nation) b USING (n_regionkey) GROUP BY 1)
SELECT count(*) FILTER (g > 20) = 0 AS holds, round(max(g), 6) AS max_diameter, count(*) FILTER (g > 20) AS violating_groups FROM g""",
)
def mfd_plane(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation").withColumn("l", F.length("n_name"))
    return plain(pairs.verify_metric(nation, ["n_regionkey"], ["n_nationkey", "l"], 20).summary)


@query("mfd_cosine")
def mfd_cosine(spark: SparkSession, d: str) -> DataFrame:
    return plain(pairs.verify_metric(read(spark, d, "nation"), ["n_regionkey"], ["n_name"], 0.9, "cosine").summary)


# Association rules and constraints.


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem")
    items = F.array(F.concat(F.lit("f"), F.col("l_returnflag")), F.concat(F.lit("s"), F.col("l_linestatus")), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")))
    return line.select(F.col("l_orderkey").alias("tid"), F.explode(items).alias("item")).groupBy("tid").agg(F.collect_set("item").alias("items"))


_BASKET_SQL = """b AS (SELECT DISTINCT l_orderkey AS t, unnest(['f' || l_returnflag, 's' || l_linestatus, 'n' || CAST(l_linenumber AS VARCHAR)]) AS i FROM lineitem),
n AS (SELECT count(DISTINCT l_orderkey)::DOUBLE AS n FROM lineitem),
f1 AS (SELECT i, count(*) AS c FROM b GROUP BY i HAVING count(*) >= ceil(0.3 * (SELECT n FROM n) - 1e-9)),
f2 AS (SELECT x.i AS i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.t = y.t AND x.i < y.i GROUP BY ALL HAVING count(*) >= ceil(0.3 * (SELECT n FROM n) - 1e-9))"""


@query("ar_itemsets", f"WITH {_BASKET_SQL} SELECT i AS items, c AS count FROM f1 UNION ALL SELECT i || ',' || j, c FROM f2")
def ar_itemsets(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.frequent_itemsets(_baskets(spark, d), 0.3, max_size=2))


@query(
    "ar_discover",
    f"""WITH {_BASKET_SQL}, r AS (SELECT i AS lhs, j AS rhs, c FROM f2 UNION ALL SELECT j, i, c FROM f2)
SELECT lhs, rhs, round(r.c / n.n, 6) AS support, round(r.c::DOUBLE / f1.c, 6) AS confidence FROM r JOIN f1 ON f1.i = lhs, n WHERE r.c::DOUBLE / f1.c >= 0.6""",
)
def ar_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.association_rules(_baskets(spark, d), 0.3, 0.6, max_size=2))


@query(
    "ar_verify",
    """WITH b AS (SELECT l_orderkey, bool_or(l_returnflag = 'A') AS a, bool_or(l_returnflag = 'R') AS r, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY 1),
k AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a AND r AND f) AS s, count(*) FILTER (a AND r AND NOT f) AS fn, count(*) FILTER ((a OR r) AND NOT (a AND r) AND f) AS pf, count(*) FILTER ((a OR r) AND NOT (a AND r) AND NOT f) AS pn FROM b)
SELECT s / n >= 0.1 AND s::DOUBLE / (s + fn) >= 0.5 AS ar_holds, round(s / n, 6) AS support, round(s::DOUBLE / (s + fn), 6) AS confidence, s AS satisfying, CAST(0 AS BIGINT) AS full_part, fn AS full_none, pf AS part_full, CAST(0 AS BIGINT) AS part_part, pn AS part_none FROM k""",
)
def ar_verify(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.verify_rule(_baskets(spark, d), ["fA", "fR"], ["sF"], 0.1, 0.5))


@query("nar_des")
def nar_des(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.numeric_rules(read(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"], 20, 3, 0.05, 0.4))


@query("ac_discover", "SELECT 'l_extendedprice' AS \"left\", 'l_discount' AS \"right\", round(min(l_extendedprice - l_discount), 6) AS low, round(max(l_extendedprice - l_discount), 6) AS high, count(*) AS n FROM lineitem")
def ac_discover(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.algebraic_constraints(read(spark, d, "lineitem"), "-", ["l_extendedprice", "l_discount"], 1.0))


@query("ac_exceptions", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_extendedprice / l_quantity BETWEEN 900 AND 1500)")
def ac_exceptions(spark: SparkSession, d: str) -> DataFrame:
    return rules.algebraic_exceptions(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "/", [(900, 1500)]).select("l_orderkey", "l_linenumber")


@query("ac_ranges")
def ac_ranges(spark: SparkSession, d: str) -> DataFrame:
    return plain(rules.algebraic_constraints(read(spark, d, "lineitem"), "/", ["l_extendedprice", "l_quantity"], 0.01, 4))


@query("pac_verify")
def pac_verify(spark: SparkSession, d: str) -> DataFrame:
    dist = rules.box_distance([F.col("l_quantity"), F.col("l_discount") * 100], [5, 1], [40, 8])
    return plain(rules.verify_pac(read(spark, d, "lineitem"), dist, min_delta=0.8))


@query("pac_highlights", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE greatest(5 - l_quantity, l_quantity - 40, 0) > 2 AND greatest(5 - l_quantity, l_quantity - 40, 0) <= 8")
def pac_highlights(spark: SparkSession, d: str) -> DataFrame:
    return rules.pac_highlights(read(spark, d, "lineitem"), rules.box_distance([F.col("l_quantity")], [5], [40]), 2, 8).select("l_orderkey", "l_linenumber")


# Graphs and sequences.


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nation, region, supplier = (read(spark, d, t) for t in ("nation", "region", "supplier"))
    vertex = lambda df, key, base, label, name: df.select((F.col(key).cast("long") + base).alias("id"), F.lit(label).alias("label"), F.create_map(F.lit("name"), F.col(name), F.lit("kind"), F.lit(label)).alias("attrs"))
    vertices = vertex(region, "r_regionkey", 0, "region", "r_name").union(vertex(nation, "n_nationkey", 1000, "nation", "n_name")).union(vertex(supplier, "s_suppkey", 10_000, "supplier", "s_name"))
    edge = lambda df, a, base_a, b, base_b, label: df.select((F.col(a).cast("long") + base_a).alias("src"), (F.col(b).cast("long") + base_b).alias("dst"), F.lit(label).alias("label"))
    edges = edge(nation, "n_nationkey", 1000, "n_regionkey", 0, "in").union(edge(supplier, "s_suppkey", 10_000, "s_nationkey", 1000, "of"))
    return vertices, edges


@query(
    "gfd_validate",
    """SELECT s1.s_suppkey + 10000 AS v0, n_nationkey + 1000 AS v1, s2.s_suppkey + 10000 AS v2 FROM supplier s1 JOIN nation ON s1.s_nationkey = n_nationkey JOIN supplier s2 ON s2.s_nationkey = n_nationkey
WHERE s1.s_suppkey <> s2.s_suppkey AND s1.s_name <> s2.s_name""",
)
def gfd_validate(spark: SparkSession, d: str) -> DataFrame:
    pattern = graphs.Pattern(("supplier", "nation", "supplier"), ((0, 1, "of"), (2, 1, "of")))
    return graphs.gfd_violations(*_graph(spark, d), graphs.GFD(pattern, (), (graphs.Literal(0, "name", 2, "name"),)))


@query(
    "gdd_validate",
    """SELECT s_suppkey + 10000 AS v0, n_nationkey + 1000 AS v1, r_regionkey AS v2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE levenshtein(n_name, r_name) > 5""",
)
def gdd_validate(spark: SparkSession, d: str) -> DataFrame:
    pattern = graphs.Pattern(("supplier", "nation", "region"), ((0, 1, "of"), (1, 2, "in")))
    return graphs.gdd_violations(*_graph(spark, d), graphs.GDD(pattern, (), (graphs.Distance(1, "name", "<=", 5, 2, "name", "edit"),)))


@query("gfd_discover")
def gfd_discover(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.mine_gfds(*_graph(spark, d), k=2, sigma=5)
    rows = [(",".join(g.pattern.labels), repr(g.premises), repr(g.conclusions), n) for g, n in found]
    return spark.createDataFrame(rows, "pattern string, premises string, conclusions string, support long")


def _order_graphs(line: DataFrame) -> DataFrame:
    """A star per order: its status linked to the return flags of its lines."""
    by = line.groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.array_sort(F.collect_list(F.concat("l_returnflag", "l_linestatus"))).alias("x"))
    root = F.array(F.struct(F.lit(0).alias("id"), F.lit("order").alias("label")))
    leaves = F.transform("x", lambda x, i: F.struct((i + 1).alias("id"), x.alias("label")))
    edges = F.transform("x", lambda x, i: F.struct(F.lit(0).alias("src"), (i + 1).alias("dst"), F.lit("line").alias("label")))
    return by.select("graph_id", F.concat(root, leaves).alias("vertices"), edges.alias("edges"))


@query(
    "fsm_gspan",
    """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_returnflag || l_linestatus AS x FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT x AS leaf, count(*) AS support FROM l, n GROUP BY x, n.n HAVING count(*) >= ceil(0.2 * n.n - 1e-9)""",
)
def fsm_gspan(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.frequent_subgraphs(_order_graphs(read(spark, d, "lineitem")), 0.2, 1)
    return found.select(F.filter("labels", lambda x: x != "order")[0].alias("leaf"), "support")


@query(
    "fsm_gspan_deep",
    """WITH l AS (SELECT l_orderkey AS o, l_returnflag || l_linestatus AS x, count(*) AS k FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
s AS (SELECT x || ',order' AS labels, count(*) AS support FROM l GROUP BY x
UNION ALL SELECT a.x || ',' || b.x || ',order', count(*) FROM l a JOIN l b ON a.o = b.o AND (a.x < b.x OR a.x = b.x AND a.k > 1) GROUP BY a.x, b.x)
SELECT labels, support FROM s, n WHERE support >= ceil(0.2 * n.n - 1e-9)""",
)
def fsm_gspan_deep(spark: SparkSession, d: str) -> DataFrame:
    found = graphs.frequent_subgraphs(_order_graphs(read(spark, d, "lineitem")), 0.2, 2)
    return plain(found.select(F.array_sort("labels").alias("labels"), "support"))


@query("episodes_maxfem")
def episodes_maxfem(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 3).otherwise(4)
    sequence = read(spark, d, "events").groupBy(F.floor(F.unix_timestamp("ts") / 86400).alias("ts")).agg(F.collect_set(kinds.cast("long")).alias("events"))
    n = sequence.count()
    return episodes.maximal_episodes(sequence, max(2, int(0.8 * n)), 2).select(F.to_json("episode").alias("episode"), "support")


# Column statistics.


def _describe_sql(table: str, cols: Sequence[str], text: Sequence[str] = ()) -> str:
    part = lambda c: f"(SELECT NULLIF({c}, '') AS v, {c} AS raw FROM {table})" if c in text else f"(SELECT {c} AS v, {c} AS raw FROM {table})"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(v) AS num_values, count(*) - count(raw) AS num_nulls, count(DISTINCT v) AS num_distinct, count(DISTINCT v) <= least(count(v) - 1, 10 + count(v) // 1000) AS is_categorical, CAST(min(v) AS VARCHAR) AS min, CAST(max(v) AS VARCHAR) AS max FROM {part(c)}"
        for c in cols
    )


@query("stats_describe", _describe_sql("lineitem", ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), ("l_returnflag", "l_linestatus")))
def stats_describe(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])


@query("stats_table", "SELECT count(*) AS num_rows, CAST(3 AS INTEGER) AS num_columns, '' AS null_columns, '' AS columns_with_null, 'n_nationkey,n_name' AS unique_columns FROM nation")
def stats_table(spark: SparkSession, d: str) -> DataFrame:
    return plain(stats.table_summary(read(spark, d, "nation")))


def _moments_sql(table: str, cols: Sequence[str]) -> str:
    def one(c: str) -> str:
        return f"""SELECT '{c}' AS "column", round(sum(v), 4) AS sum, round(avg(v), 4) AS avg, round(stddev_samp(v), 4) AS corrected_std, round(avg(pow(v - mu, 2)), 4) AS central_moment_2,
 round(avg(pow(v - mu, 3)), 4) AS central_moment_3, round(avg(pow(v - mu, 3)) / pow(stddev_samp(v), 3), 4) AS skewness, round(avg(pow(v - mu, 4)) / pow(stddev_samp(v), 4) - 3, 4) AS kurtosis,
 round(sum(v * v), 4) AS sum_of_squares, round(CASE WHEN min(v) > 0 THEN exp(avg(ln(CASE WHEN v > 0 THEN v END))) WHEN min(v) = 0 THEN 0 END, 4) AS geometric_mean, round(avg(abs(v - mu)), 4) AS mean_ad,
 round(CASE WHEN avg(v) <> 0 THEN stddev_samp(v) / avg(v) END, 4) AS coefficient_of_variation, count(*) FILTER (v = 0) AS num_zeros, count(*) FILTER (v < 0) AS num_negatives,
 round(count(*) FILTER (v = 0)::DOUBLE / (count(v) - (count(*) - count(v))), 4) AS zero_percent,
 round(count(v) / 6.0 * (pow(avg(pow(v - mu, 3)) / pow(stddev_samp(v), 3), 2) + pow(avg(pow(v - mu, 4)) / pow(stddev_samp(v), 4) - 6, 2) / 4), 4) AS jarque_bera
 FROM (SELECT {c}::DOUBLE AS v, avg({c}) OVER () AS mu FROM {table})"""

    return " UNION ALL ".join(one(c) for c in cols)


@query("stats_moments", _moments_sql("lineitem", ("l_quantity", "l_linenumber", "l_tax")))
def stats_moments(spark: SparkSession, d: str) -> DataFrame:
    return plain(stats.moments(read(spark, d, "lineitem"), ["l_quantity", "l_linenumber", "l_tax"]), 4)


@query("stats_quantiles", "WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), p(share) AS (VALUES (0.25), (0.5), (0.75), (1.0)) SELECT CAST(share AS DOUBLE) AS share, v AS value FROM p JOIN s ON k = least(floor(n * CAST(share AS DOUBLE)), n - 1)")
def stats_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantiles(read(spark, d, "lineitem"), "l_extendedprice", (0.25, 0.5, 0.75, 1.0))


@query(
    "stats_medians",
    """WITH m AS (SELECT median(l_quantity) AS m FROM lineitem), s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT 'l_quantity' AS "column", (SELECT m FROM m) AS median, (SELECT median(abs(l_quantity - m)) FROM lineitem, m) AS median_ad, (SELECT max(v) - min(v) FROM s WHERE k = floor(n * 0.25) OR k = floor(n * 0.75)) AS iqr""",
)
def stats_medians(spark: SparkSession, d: str) -> DataFrame:
    return stats.medians(read(spark, d, "lineitem"), ["l_quantity"])


def _monotonicity_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", CASE WHEN up = 0 AND down = 0 THEN 'equal' WHEN down = 0 THEN 'ascending' WHEN up = 0 THEN 'descending' ELSE 'none' END AS kind FROM (
SELECT count(*) FILTER (v > p) AS up, count(*) FILTER (v < p) AS down FROM (SELECT {column} AS v, lag({column}) OVER (ORDER BY o_orderkey) AS p FROM orders))"""


@query("stats_monotonicity", " UNION ALL ".join(_monotonicity_sql(c) for c in ("o_orderkey", "o_totalprice")))
def stats_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    return stats.monotonicity(orders, "o_orderkey", ["o_orderkey"]).unionByName(stats.monotonicity(orders, "o_totalprice", ["o_orderkey"]))


@query(
    "stats_moments_of_order",
    """WITH m AS (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s FROM lineitem)
SELECT 'l_quantity' AS "column", round(avg(pow(l_quantity - a, 5)), 3) AS central_5, round(avg(pow((l_quantity - a) / s, 6)), 6) AS standardized_6 FROM lineitem, m""",
)
def stats_moments_of_order(spark: SparkSession, d: str) -> DataFrame:
    found = stats.moments_of_order(read(spark, d, "lineitem"), {"central_5": (5, False), "standardized_6": (6, True)}, ["l_quantity"])
    return found.select("column", F.round("central_5", 3).alias("central_5"), F.round("standardized_6", 6).alias("standardized_6"))


@query(
    "stats_text",
    """WITH w AS (SELECT o_orderpriority AS s, list_filter(regexp_split_to_array(o_orderpriority, '\\s+'), lambda x: x <> '') AS ws FROM orders)
SELECT 'o_orderpriority' AS "column", CAST(sum(length(regexp_replace(s, '[A-Za-z]', '', 'g'))) AS BIGINT) AS non_letter_chars, CAST(sum(length(regexp_replace(s, '[^0-9]', '', 'g'))) AS BIGINT) AS digit_chars,
 CAST(sum(length(regexp_replace(s, '[^a-z]', '', 'g'))) AS BIGINT) AS lower_chars, CAST(sum(length(regexp_replace(s, '[^A-Z]', '', 'g'))) AS BIGINT) AS upper_chars, CAST(sum(length(s)) AS BIGINT) AS total_chars,
 round(sum(length(s))::DOUBLE / count(s), 6) AS avg_chars, CAST(min(length(s)) AS INTEGER) AS min_chars, CAST(max(length(s)) AS INTEGER) AS max_chars,
 CAST(min(length(s) - length(replace(s, ' ', ''))) AS INTEGER) AS min_white_spaces, CAST(max(length(s) - length(replace(s, ' ', ''))) AS INTEGER) AS max_white_spaces,
 CAST(min(len(ws)) AS INTEGER) AS min_words, CAST(max(len(ws)) AS INTEGER) AS max_words, CAST(sum(len(ws)) AS BIGINT) AS total_words,
 CAST(sum(len(list_filter(ws, lambda x: NOT regexp_matches(x, '[a-z]')))) AS BIGINT) AS upper_words, CAST(sum(len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Z]')))) AS BIGINT) AS lower_words,
 count(*) FILTER (regexp_matches(s, '^\\s+$')) AS whitespace_only_rows, count(*) FILTER (regexp_matches(s, '^\\s')) AS leading_whitespace_rows, count(*) FILTER (regexp_matches(s, '\\s$')) AS trailing_whitespace_rows,
 count(*) FILTER (regexp_matches(s, '[@#$%^&!?*_+=~''\\-"]')) AS special_char_rows FROM w""",
)
def stats_text(spark: SparkSession, d: str) -> DataFrame:
    return plain(stats.text_summary(read(spark, d, "orders"), ["o_orderpriority"]))


@query("stats_top_chars", "SELECT char, count(*) AS n FROM (SELECT unnest(string_split(n_name, '')) AS char FROM nation) GROUP BY char ORDER BY n DESC, char LIMIT 5")
def stats_top_chars(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_k(stats.char_counts(read(spark, d, "nation"), "n_name"), 5)


@query("stats_top_words", "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(p_name, '\\s+')) AS word FROM part) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10")
def stats_top_words(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_k(stats.word_counts(read(spark, d, "part"), "p_name"), 10)


@query("stats_vocabulary", "SELECT 'c_mktsegment' AS \"column\", string_agg(c, '' ORDER BY c) AS vocab FROM (SELECT DISTINCT unnest(string_split(c_mktsegment, '')) AS c FROM customer)")
def stats_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary(read(spark, d, "customer"), "c_mktsegment")


@query(
    "stats_edge_chars",
    """WITH e AS (SELECT 'first' AS edge, left(n_name, 1) AS c FROM nation UNION ALL SELECT 'last', right(n_name, 1) FROM nation), g AS (SELECT edge, c, count(*) AS n FROM e GROUP BY ALL)
SELECT edge, c AS char, n FROM (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY n DESC, c DESC) AS k FROM g) WHERE k = 1""",
)
def stats_edge_chars(spark: SparkSession, d: str) -> DataFrame:
    return stats.edge_chars(read(spark, d, "nation"), "n_name")


@query(
    "stats_distribution",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, round(1 - sum(n * n)::DOUBLE / (sum(n)::DOUBLE * sum(n)), 6) AS gini FROM (SELECT count(*) AS n FROM customer GROUP BY {c})" for c in ("c_mktsegment", "c_nationkey")
    ),
)
def stats_distribution(spark: SparkSession, d: str) -> DataFrame:
    return plain(stats.distribution(read(spark, d, "customer"), ["c_mktsegment", "c_nationkey"]))


@query("stats_booleans", "SELECT count(*) FILTER (l_returnflag = 'R') AS num_true, count(*) FILTER (l_returnflag <> 'R') AS num_false FROM lineitem")
def stats_booleans(spark: SparkSession, d: str) -> DataFrame:
    return stats.booleans(read(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("r")), "r")


@query("stats_sample", "SELECT CAST(k AS INTEGER) AS row, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) WHERE k BETWEEN 3 AND 7")
def stats_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.sample_window(read(spark, d, "nation"), ["n_nationkey"], (3, 7), (2, 3))


@query("stats_diacritics", "SELECT 'text' AS \"column\", CAST(sum(length(regexp_replace(text, '[^éèêçàâîôûëïüùáíóúñäöÉÈÊÇÀÂÎÔÛËÏÜÙÁÍÓÚÑÄÖ]', '', 'g'))) AS BIGINT) AS diacritic_chars FROM documents")
def stats_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return stats.diacritics(read(spark, d, "documents"), "text")


_INT_FORM = "bool_and(regexp_full_match(CAST({0} AS VARCHAR), '[+-]?[0-9]{{1,19}}'))"


@query("types_infer", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN {_INT_FORM.format(c)} THEN 'int' ELSE 'string' END AS kind FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))
def types_infer(spark: SparkSession, d: str) -> DataFrame:
    found = tables.infer_types(read(spark, d, "nation"))
    return spark.createDataFrame(list(found.items()), "column string, kind string")


def _scratch(spark: SparkSession) -> str:
    """A folder of its own that driver and executors share."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/scratch-{uuid.uuid4().hex}"


@query("csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """nation through a CSV file with rows that are too short and too long, which a scan drops."""
    line = F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey")
    lines = read(spark, d, "nation").select(F.explode(F.array(line, F.concat(line, F.lit("|more")), F.col("n_name"))).alias("value"))
    path = _scratch(spark)
    lines.write.text(path)
    schema = "n_nationkey string, n_name string, n_regionkey string"
    found = tables.cast_inferred(tables.read_csv(spark, path, "|", False, schema=schema))
    return found.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("baskets_from_columns", "SELECT p_partkey AS tid, array_to_string(list_sort(list_distinct([p_brand, p_type, CAST(p_size AS VARCHAR)])), ',') AS items FROM part")
def baskets_from_columns(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string"))
    return plain(tables.baskets_from_columns(rows, "p_partkey"))


@query("dot_round_trip", "SELECT r_regionkey AS id, 'region' AS label, r_name AS name, 0 AS edges FROM region UNION ALL SELECT n_nationkey + 1000, 'nation', n_name, 1 FROM nation")
def dot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the regions' and nations' graph, written as dot and read again, with the edges they start."""
    vertices, edges = _graph(spark, d)
    vertices, edges = vertices.where("label <> 'supplier'"), edges.where("label = 'in'")
    vertices, edges = tables.parse_dot(spark, tables.format_dot(vertices, edges, directed=True))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("edges"))
    return vertices.join(out, "id", "left").select(F.col("id").cast("int"), "label", F.col("attrs")["name"].alias("name"), F.coalesce("edges", F.lit(0)).alias("edges"))


@query("gspan_round_trip", "SELECT CAST(n_regionkey AS BIGINT) AS graph_id, CAST(count(*) + 1 AS INTEGER) AS vertices, CAST(count(*) AS INTEGER) AS edges FROM nation GROUP BY 1")
def gspan_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A star of nations for each region, written as graph lines and read again."""
    stars: dict[int, graphs.SmallGraph] = {}
    for r in read(spark, d, "nation").orderBy("n_nationkey").collect():
        star = stars.setdefault(r["n_regionkey"], graphs.SmallGraph({0: "region"}))
        star.labels[len(star.labels)] = "nation"
        star.edges.append((0, len(star.labels) - 1, "in"))
    back = graphs.graph_frame(spark, graphs.parse_graphs(graphs.format_graphs(sorted(stars.items()))))
    return back.select("graph_id", F.size("vertices").alias("vertices"), F.size("edges").alias("edges"))


@query("baskets_from_rows", "SELECT l_orderkey AS tid, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS items FROM lineitem GROUP BY 1")
def baskets_from_rows(spark: SparkSession, d: str) -> DataFrame:
    return plain(tables.baskets_from_rows(read(spark, d, "lineitem"), "l_orderkey", "l_suppkey"))


# Dynamic validation and pipelines.


@query(
    "dynamic_fd",
    """WITH r AS (SELECT o_custkey AS x, CASE WHEN o_orderkey % 10 = 1 THEN 'X' ELSE o_orderstatus END AS a FROM orders WHERE o_orderkey % 10 <> 2),
g AS (SELECT x, a, count(*) AS c FROM r GROUP BY ALL), h AS (SELECT x, sum(c)::DOUBLE AS s, count(*) AS nd, sum(c * c)::DOUBLE AS q FROM g GROUP BY x)
SELECT count(*) FILTER (nd > 1) = 0 AS holds, round(coalesce(sum(s * s - q) FILTER (nd > 1), 0) / (sum(s) * (sum(s) - 1)), 9) AS error, count(*) FILTER (nd > 1) AS num_error_clusters, CAST(coalesce(sum(s) FILTER (nd > 1), 0) AS BIGINT) AS num_error_rows FROM h""",
)
def dynamic_fd(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey") % 10
    state = DynamicFD(orders.where(k != 3), "o_orderkey", ["o_custkey"], ["o_orderstatus"])
    state.apply(insert=orders.where(k == 3))
    state.apply(delete=orders.where(k == 2).select("o_orderkey"), update=orders.where(k == 1).withColumn("o_orderstatus", F.lit("X")))
    return plain(state.verdict(), 9)


@query(
    "typo_mining",
    """WITH g AS (SELECT c_mktsegment AS s, CASE WHEN c_custkey % 97 = 0 THEN c_mktsegment || 'X' ELSE c_mktsegment END AS v, count(*) AS n FROM customer GROUP BY ALL),
t AS (SELECT s, max({'n': n, 'v': v}) AS m FROM g GROUP BY s)
SELECT s AS segment, v AS value, g.n, m.v AS likely, m.n AS likely_n FROM g JOIN t USING (s) WHERE v <> m.v AND levenshtein(v, m.v) <= 3 AND g.n <= 0.1 * m.n""",
)
def typo_mining(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 97 == 0, F.concat("c_mktsegment", F.lit("X"))).otherwise(F.col("c_mktsegment")))
    return cleaning.typos(c, ["c_mktsegment"], "v").select(F.col("lhs.c_mktsegment").alias("segment"), "value", "n", "likely", "likely_n")


@query(
    "dedupe_pairs",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS k FROM part),
p AS (SELECT a.p_partkey AS "first", b.p_partkey AS "second", CAST(a.p_type = b.p_type AS INTEGER) + CAST(a.p_size = b.p_size AS INTEGER) AS equal FROM o a JOIN o b ON a.p_brand = b.p_brand AND b.k - a.k BETWEEN 1 AND 2)
SELECT "first", "second", equal FROM p WHERE equal >= 2""",
)
def dedupe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.duplicate_pairs(read(spark, d, "part"), "p_partkey", ["p_brand", "p_type"], ["p_type", "p_size"], 3, 2)


def _lost_sql() -> str:
    """Of single columns, as no column of nation is constant."""
    pairs_ = [(x, a) for x in NATION_FD for a in NATION_FD if x != a]
    bad = lambda t, x, a: f"(SELECT coalesce(sum(s * s - q) FILTER (nd > 1), 0)::DOUBLE / (sum(s) * (sum(s) - 1)) FROM (SELECT {x}, sum(c)::DOUBLE AS s, count(*) AS nd, sum(c * c)::DOUBLE AS q FROM (SELECT {x}, {a}, count(*) AS c FROM {t} GROUP BY ALL) GROUP BY {x}))"
    return f"""WITH b AS (SELECT n_nationkey, CASE WHEN n_nationkey < 2 THEN 'SAME' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 0 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation),
c AS ({' UNION ALL '.join(f"SELECT '{x}' AS lhs, '{a}' AS rhs, {bad('nation', x, a)} AS was, {bad('b', x, a)} AS error" for x, a in pairs_)})
SELECT lhs, rhs, round(error, 6) AS error FROM c WHERE was = 0 AND error > 0"""


@query("anomaly_lost_fds", _lost_sql())
def anomaly_lost_fds(spark: SparkSession, d: str) -> DataFrame:
    nation = read(spark, d, "nation")
    broken = nation.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 0, 99).otherwise(F.col("n_regionkey"))).withColumn("n_name", F.when(F.col("n_nationkey") < 2, "SAME").otherwise(F.col("n_name")))
    return plain(cleaning.lost_dependencies(nation, broken))


@query("cleaning_dc", "WITH v AS (SELECT t.p_partkey AS f, s.p_partkey AS s FROM part t JOIN part s ON t.p_brand = s.p_brand AND t.p_size = s.p_size AND t.p_retailprice > s.p_retailprice), u AS (SELECT f AS id FROM v UNION ALL SELECT s FROM v) SELECT id, count(*) AS n FROM u GROUP BY id")
def cleaning_dc(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.rows_breaking(read(spark, d, "part"), "!(t.p_brand == s.p_brand and t.p_size == s.p_size and t.p_retailprice > s.p_retailprice)", "p_partkey")
