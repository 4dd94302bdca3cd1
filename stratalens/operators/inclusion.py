"""Inclusion dependencies, approximate and conditional ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.options import pick, require, share
from .fd import Verdict


def _key(df: DataFrame, columns: list[str]) -> Column:
    """Values as text, so that columns of different types compare by what they show; NULL stays NULL."""
    return F.struct(*[F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(columns)])


def verify(left: DataFrame, lhs: Sequence[str | int], right: DataFrame, rhs: Sequence[str | int]) -> Verdict:
    """Whether the left columns' values all occur in the right columns.

    error is violating over all distinct left values. violations: value, rows.
    NULL equals NULL. Empty tables and sides of different length are errors.
    """
    x, y = pick(left, lhs, "lhs"), pick(right, rhs, "rhs")
    require(len(x) == len(y) > 0, "both sides need the same number of columns")
    require(bool(left.take(1)) and bool(right.take(1)), "a table is empty")
    values = left.groupBy(_key(left, x).alias("value")).agg(F.count("*").alias("rows"))
    known = right.select(_key(right, y).alias("known")).distinct()
    flagged = values.join(known.withColumn("hit", F.lit(True)), F.col("value") == F.col("known"), "left")
    missing = F.col("hit").isNull()
    summary = flagged.agg(
        (F.count_if(missing) == 0).alias("holds"), (F.count_if(missing) / F.count("*")).alias("error"),
        F.count_if(missing).alias("num_clusters_violating"), F.coalesce(F.sum(F.when(missing, F.col("rows"))), F.lit(0)).alias("num_rows_violating"),
    )
    return Verdict(summary, flagged.where(missing).select("value", "rows"))


def unary(tables: Mapping[str, DataFrame], error: float = 0.0, columns: Mapping[str, Sequence[str]] | None = None, null_equal_null: bool = True) -> DataFrame:
    """All unary inclusions between columns of the tables with at most `error` of the distinct left values missing.

    Rows (lhs_table, lhs_column, rhs_table, rhs_column, error). One pass turns
    cells to distinct (value, column) pairs; columns that hold a value meet in
    one set per value, and equal sets are counted together before they are
    paired, so pairs grow with the number of columns only.
    """
    share(error, "error")
    ids: list[tuple[str, str]] = []
    cells: DataFrame | None = None
    for name, df in tables.items():
        cols = pick(df, (columns or {}).get(name))
        base = len(ids)
        ids += [(name, c) for c in cols]
        pairs = F.array(*[F.struct(F.lit(base + i).alias("id"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(cols)])
        part = df.select(F.explode(pairs).alias("p")).select("p.*").distinct()
        cells = part if cells is None else cells.unionByName(part)
    require(cells is not None, "no tables")
    if not null_equal_null:
        cells = cells.where("value is not null")
    sets = cells.groupBy("value").agg(F.array_sort(F.collect_set("id")).alias("ids")).groupBy("ids").agg(F.count("*").alias("n"))
    met = sets.select("n", "ids", F.explode("ids").alias("l")).select("n", "l", F.explode("ids").alias("r")).groupBy("l", "r").agg(F.sum("n").alias("n"))
    own = met.where("l = r").select(F.col("l").alias("own"), F.col("n").alias("size"))
    out = met.where("l <> r").join(own, F.col("l") == F.col("own")).withColumn("error", 1 - F.col("n") / F.col("size")).where(F.col("error") <= error)
    names = df.sparkSession.createDataFrame([(i, t, c) for i, (t, c) in enumerate(ids)], "id int, t string, c string")
    a, b = names.toDF("l", "lhs_table", "lhs_column"), names.toDF("r", "rhs_table", "rhs_column")
    return out.join(a, "l").join(b, "r").select("lhs_table", "lhs_column", "rhs_table", "rhs_column", "error")


def nary(tables: Mapping[str, DataFrame], max_arity: int = 2, error: float = 0.0, columns: Mapping[str, Sequence[str]] | None = None, screen: bool = False) -> DataFrame:
    """Inclusions up to `max_arity` between ordered column lists of one table and another, by apriori levels.

    Rows (lhs_table, lhs, rhs_table, rhs, error). A candidate joins two smaller
    ones of the same tables that share all but the last pair; left columns
    ascend and no column is on both sides. screen: a distinct-count sketch first
    drops candidates whose left side clearly has more values than the right.
    """
    require(max_arity >= 1, "max_arity must be positive")
    level = [((r["lhs_table"], (r["lhs_column"],)), (r["rhs_table"], (r["rhs_column"],)), r["error"]) for r in unary(tables, error, columns).collect()]
    out = list(level)
    for _ in range(2, max_arity + 1):
        have = {(a, b) for a, b, _ in level}
        todo = []
        for (ta, xa), (tb, ya) in sorted(have):
            for (tc, xc), (td, yc) in sorted(have):
                if (ta, tb) == (tc, td) and xa[:-1] == xc[:-1] and ya[:-1] == yc[:-1] and xa[-1] < xc[-1] and ya[-1] != yc[-1]:
                    x, y = (*xa, xc[-1]), (*ya, yc[-1])
                    if ta == tb and set(x) & set(y):
                        continue
                    if all(((ta, s), (tb, t)) in have for s, t in zip(combinations(x, len(x) - 1), combinations(y, len(y) - 1), strict=True)):
                        todo.append((ta, x, tb, y))
        level = []
        for ta, x, tb, y in todo:
            if screen and error == 0:
                l, r = (tables[t].agg(F.approx_count_distinct(_key(tables[t], list(c)), 0.02)).first()[0] for t, c in ((ta, x), (tb, y)))  # noqa: E741
                if l > 1.2 * r:
                    continue
            e = verify(tables[ta], x, tables[tb], y).summary.first()["error"]
            if e <= error:
                level.append(((ta, x), (tb, y), e))
        out += level
    rows = [(a[0], list(a[1]), b[0], list(b[1]), float(e)) for a, b, e in out]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "lhs_table string, lhs array<string>, rhs_table string, rhs array<string>, error double")


def _included(left: DataFrame, x: list[str], right: DataFrame, y: list[str]) -> DataFrame:
    known = right.select(_key(right, y).alias("_known")).distinct().withColumn("_hit", F.lit(True))
    return left.join(known, _key(left, x) == F.col("_known"), "left").withColumn("included", F.col("_hit").isNotNull()).drop("_known", "_hit")


def verify_conditional(
    left: DataFrame, lhs: Sequence[str], right: DataFrame, rhs: Sequence[str], condition: Mapping[str, str], validity: float = 1.0, completeness: float = 0.0, kind: str = "row"
) -> Verdict:
    """Inclusion of left rows that meet `condition` (column to constant; '-' and '_' are wildcards).

    kind 'row' takes rows as baskets, 'group' all rows of a left value. summary:
    holds, has_support, real_validity (included among supporting baskets, null
    without support), real_completeness (supporting among included baskets),
    supporting_baskets, included_baskets, included_support_baskets.
    """
    require(kind in ("row", "group"), "kind must be row or group")
    x, y = pick(left, lhs, "lhs"), pick(right, rhs, "rhs")
    require(len(x) == len(y) > 0, "both sides need the same number of columns")
    test = F.lit(True)
    for c, value in condition.items():
        pick(left, [c], "condition")
        if value not in ("-", "_"):
            test = test & F.coalesce(F.col(f"`{c}`").cast("string") == value, F.lit(False))
    rows = _included(left, x, right, y).withColumn("meets", test)
    if kind == "group":
        rows = rows.groupBy(_key(left, x).alias("value")).agg(F.max("included").alias("included"), F.max("meets").alias("meets"))
    both = F.count_if(F.col("included") & F.col("meets"))
    sup, inc = F.count_if("meets"), F.count_if("included")
    got = rows.agg(sup.alias("supporting_baskets"), inc.alias("included_baskets"), both.alias("included_support_baskets"))
    v = F.when(F.col("supporting_baskets") > 0, F.col("included_support_baskets") / F.col("supporting_baskets"))
    c = F.when(F.col("included_baskets") > 0, F.col("included_support_baskets") / F.col("included_baskets"))
    summary = got.select(
        (F.coalesce(v >= validity, F.lit(False)) & F.coalesce(c >= completeness, F.lit(False))).alias("holds"), (F.col("supporting_baskets") > 0).alias("has_support"),
        v.alias("real_validity"), c.alias("real_completeness"), "supporting_baskets", "included_baskets", "included_support_baskets",
    )
    return Verdict(summary, rows.where("meets and not included"))


def mine_conditions(left: DataFrame, lhs: Sequence[str], right: DataFrame, rhs: Sequence[str], condition_columns: Sequence[str] | None = None, validity: float = 1.0, completeness: float = 0.1, max_size: int = 2) -> DataFrame:
    """Conditions over other left columns under which the inclusion holds: rows (condition map, validity, completeness).

    Levels grow by columns; a constant's completeness bounds that of every
    larger condition, so only complete enough ones are extended.
    """
    x, y = pick(left, lhs, "lhs"), pick(right, rhs, "rhs")
    cols = [c for c in pick(left, condition_columns, "condition_columns") if c not in x]
    rows = _included(left, x, right, y)
    narrow = rows.select("included", *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).persist()
    try:
        total = narrow.where("included").count()
        out, alive = [], {(): set()}
        for size in range(1, max_size + 1):
            nxt: dict = {}
            for group in combinations(cols, size):
                if not all(s in alive for s in combinations(group, size - 1)):
                    continue
                g = narrow.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("included").alias("k")).where(F.col("k") >= completeness * total)
                for r in g.collect() if total else []:  # at most 1 / completeness rows
                    nxt.setdefault(group, set()).add(tuple(r[c] for c in group))
                    if r["k"] >= validity * r["n"] and all(r[c] is not None for c in group):
                        out.append(({c: r[c] for c in group}, r["k"] / r["n"], r["k"] / total))
            alive = nxt
    finally:
        narrow.unpersist()
    return left.sparkSession.createDataFrame(out, "condition map<string,string>, validity double, completeness double")
