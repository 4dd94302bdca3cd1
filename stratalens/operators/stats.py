"""Column statistics: one wide aggregation per table, and a few grouped ones.

NULL and empty cells are ignored unless a function says otherwise. Numeric
statistics are null for other columns, text statistics for non-text columns.
Lengths and characters are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.options import pick, require

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is(df: DataFrame, column: str, *kinds: type) -> bool:
    return isinstance(df.schema[column].dataType, kinds)


def _cell(df: DataFrame, column: str) -> Column:
    """The column with empty strings as NULL."""
    c = F.col(f"`{column}`")
    return F.when(c != "", c) if _is(df, column, T.StringType) else c


def table_summary(df: DataFrame) -> DataFrame:
    """One row: num_rows, num_columns, null_columns, columns_with_null, unique_columns (arrays of names)."""
    cols = df.columns
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(cols)], *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(cols)])
    names = lambda test: F.array_compact(F.array(*[F.when(test(i), F.lit(c)) for i, c in enumerate(cols)]))
    return row.select(
        F.col("n").alias("num_rows"), F.lit(len(cols)).alias("num_columns"),
        names(lambda i: F.col(f"k{i}") == 0).alias("null_columns"), names(lambda i: F.col(f"k{i}") < F.col("n")).alias("columns_with_null"),
        names(lambda i: (F.col(f"d{i}") == F.col("n")) & (F.col(f"k{i}") == F.col("n"))).alias("unique_columns"),
    )


def _stacked(df: DataFrame, columns: list[str], measures: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation over the table, turned to a row per column."""
    names = list(next(iter(measures.values())))
    wide = df.agg(*[measures[c][m].alias(f"{m}__{i}") for i, c in enumerate(columns) for m in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{m}__{i}").alias(m) for m in names]) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per column: counts, nulls, distinct values, extremes as text, and whether it is categorical."""
    cols = pick(df, columns)
    per = {}
    for c in cols:
        v = _cell(df, c)
        n, d = F.count(v), F.count_distinct(v)
        limit = F.least(n - 1, 10 + F.floor(n / 1000))
        per[c] = {
            "num_values": n, "num_nulls": F.count_if(F.col(f"`{c}`").isNull()), "num_distinct": d, "is_categorical": d <= limit,
            "min": F.min(v).cast("string"), "max": F.max(v).cast("string"),
        }
    return _stacked(df, cols, per)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _is(df, c, *_NUMERIC)]


def moments(df: DataFrame, columns: Sequence[str] | None = None, compatible: bool = True) -> DataFrame:
    """A row per numeric column with sums, means, moments and what follows from them.

    Moments divide by n, standardized ones by powers of the n - 1 deviation.
    compatible: the Jarque-Bera statistic takes 3 off an already excess
    kurtosis, and zero_percent's denominator takes the nulls off twice.
    """
    cols = pick(df, columns) if columns is not None else numeric_columns(df)
    require(all(_is(df, c, *_NUMERIC) for c in cols), "columns must be numeric")
    # Two passes over the table: deviations need the mean first, and are then stable.
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    first = df.agg(*[F.avg(v).alias(f"mu{i}") for i, v in enumerate(values)])
    joined = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).join(first)  # a single row
    out = {}
    for i, c in enumerate(cols):
        v, dev = F.col(f"v{i}"), F.col(f"v{i}") - F.col(f"mu{i}")
        n = F.count(v)
        std = F.stddev_samp(v)
        m3, m4 = F.sum(F.pow(dev, 3)) / n, F.sum(F.pow(dev, 4)) / n
        skew, kurt = m3 / F.pow(std, 3), m4 / F.pow(std, 4) - 3
        zeros, nulls = F.count_if(v == 0), F.count_if(v.isNull())
        out[c] = {
            "sum": F.sum(v), "avg": F.avg(v), "corrected_std": std, "central_moment_2": F.sum(dev * dev) / n, "central_moment_3": m3,
            "skewness": skew, "kurtosis": kurt, "sum_of_squares": F.sum(v * v),
            "geometric_mean": F.when(F.min(v) > 0, F.exp(F.avg(F.when(v > 0, F.log(v))))).when(F.min(v) == 0, 0.0),
            "mean_ad": F.sum(F.abs(dev)) / n, "coefficient_of_variation": F.when(F.avg(v) != 0, std / F.avg(v)),
            "num_zeros": zeros, "num_negatives": F.count_if(v < 0),
            "zero_percent": zeros / (n - (nulls if compatible else 0)),
            "jarque_bera": n / 6 * (skew * skew + F.pow(kurt - (3 if compatible else 0), 2) / 4),
        }
    return _stacked(joined, cols, out)


def moments_of_order(df: DataFrame, wanted: dict[str, tuple[int, bool]], columns: Sequence[str] | None = None) -> DataFrame:
    """(column, ...): for each name of `wanted` the central moment of that order, over a power of the n - 1 deviation if standardized."""
    cols = pick(df, columns) if columns is not None else numeric_columns(df)
    require(all(_is(df, c, *_NUMERIC) for c in cols), "columns must be numeric")
    require(all(k >= 0 for k, _ in wanted.values()), "orders can't be negative")
    values = [F.col(f"`{c}`").cast("double") for c in cols]
    first = df.agg(*[x for i, v in enumerate(values) for x in (F.avg(v).alias(f"mu{i}"), F.stddev_samp(v).alias(f"sd{i}"))])
    joined = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]).join(first)  # a single row
    dev = lambda i, scaled: (F.col(f"v{i}") - F.col(f"mu{i}")) / (F.col(f"sd{i}") if scaled else F.lit(1.0))
    return _stacked(joined, cols, {c: {name: F.avg(F.pow(dev(i, scaled), k)) for name, (k, scaled) in wanted.items()} for i, c in enumerate(cols)})


def quantiles(df: DataFrame, column: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(share, value): the element at index floor(n * share) of the sorted values, not interpolated.

    Ranks come from running sums over value counts in two levels of ranges, so
    no single task sorts the column.
    """
    require(all(0 <= p <= 1 for p in shares), "shares must lie between 0 and 1")
    counts = df.select(_cell(df, column).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    parts = counts.repartitionByRange(F.col("v")).withColumn("part", F.spark_partition_id())
    part_sums = parts.groupBy("part").agg(F.sum("c").alias("s"))
    base = part_sums.withColumn("base", F.sum("s").over(Window.orderBy("part")) - F.col("s"))
    total = counts.agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    ranked = parts.withColumn("upto", upto).join(base.select("part", "base"), "part").withColumn("upto", F.col("upto") + F.col("base")).join(total)
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("share"), F.least(F.floor(F.col("n") * float(p)), F.col("n") - 1).alias("k")) for p in shares]))
    hit = ranked.withColumn("w", wanted).where((F.col("w.k") < F.col("upto")) & (F.col("w.k") >= F.col("upto") - F.col("c")))
    return hit.select(F.col("w.share").alias("share"), F.col("v").alias("value"))


def medians(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, median, median_ad, iqr): medians average the two middle values; IQR uses the index rule of quantiles()."""
    cols = pick(df, columns) if columns is not None else numeric_columns(df)
    v = {c: F.col(f"`{c}`").cast("double") for c in cols}
    med = df.agg(*[F.median(v[c]).alias(f"m{i}") for i, c in enumerate(cols)])
    joined = df.select(*[v[c].alias(f"v{i}") for i, c in enumerate(cols)]).join(med)  # a single row
    out = None
    base = _stacked(joined, cols, {c: {"median": F.first(f"m{i}"), "median_ad": F.median(F.abs(F.col(f"v{i}") - F.col(f"m{i}")))} for i, c in enumerate(cols)})
    for c in cols:
        q = quantiles(df.select(F.col(f"`{c}`").cast("double").alias(c)), c, (0.25, 0.75)).agg((F.max("value") - F.min("value")).alias("iqr")).withColumn("column", F.lit(c))
        out = q if out is None else out.unionByName(q)
    return base.join(out, "column")


def monotonicity(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """(column, kind): equal, ascending, descending or none, in the row order given.

    Neighbours are compared inside range partitions of the order; then the last
    row of each partition with the first of the next, a row each.
    """
    rank = F.struct(*[F.col(f"`{c}`") for c in order_by])
    parts = df.select(rank.alias("at"), F.struct(_cell(df, column).alias("v")).alias("c")).repartitionByRange(F.col("at")).withColumn("part", F.spark_partition_id())
    near = parts.withColumn("p", F.lag("c").over(Window.partitionBy("part").orderBy("at")))
    own = near.groupBy("part").agg(
        F.count_if(F.col("c.v") > F.col("p.v")).alias("up"), F.count_if(F.col("c.v") < F.col("p.v")).alias("down"),
        F.min_by("c", "at").alias("first"), F.max_by("c", "at").alias("last"),
    )
    edge = own.withColumn("p", F.lag("last").over(Window.orderBy("part")))
    up, down = (F.sum(F.col(k) + F.coalesce(step.cast("int"), F.lit(0))) for k, step in (("up", F.col("first.v") > F.col("p.v")), ("down", F.col("first.v") < F.col("p.v"))))
    kind = F.when((F.coalesce(up, F.lit(0)) == 0) & (F.coalesce(down, F.lit(0)) == 0), "equal").when(down == 0, "ascending").when(up == 0, "descending").otherwise("none")
    return edge.agg(kind.alias("kind")).select(F.lit(column).alias("column"), "kind")


def text_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if _is(df, c, T.StringType)]


def _kept(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, pattern, ""))


def text_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per text column: characters by kind, words, white space and special rows.

    Averages divide by the non-null rows, empty ones included. A word without
    letters counts as both entirely upper and entirely lower case.
    """
    cols = pick(df, columns) if columns is not None else text_columns(df)
    out = {}
    for c in cols:
        s = F.col(f"`{c}`")
        length = F.length(s)
        words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
        n_words = F.size(words)
        spaces = length - F.length(F.replace(s, F.lit(" "), F.lit("")))
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        out[c] = {
            "non_letter_chars": total(_kept(s, "[A-Za-z]")), "digit_chars": total(_kept(s, "[^0-9]")), "lower_chars": total(_kept(s, "[^a-z]")), "upper_chars": total(_kept(s, "[^A-Z]")),
            "total_chars": total(length), "avg_chars": F.sum(length) / F.count(s), "min_chars": F.min(length), "max_chars": F.max(length),
            "min_white_spaces": F.min(spaces), "max_white_spaces": F.max(spaces),
            "min_words": F.min(n_words), "max_words": F.max(n_words), "total_words": total(n_words),
            "upper_words": total(F.size(F.filter(words, lambda w: ~w.rlike("[a-z]")))), "lower_words": total(F.size(F.filter(words, lambda w: ~w.rlike("[A-Z]")))),
            "whitespace_only_rows": F.count_if(s.rlike(r"^\s+$")), "leading_whitespace_rows": F.count_if(s.rlike(r"^\s")), "trailing_whitespace_rows": F.count_if(s.rlike(r"\s$")),
            "special_char_rows": F.count_if(s.rlike(r"[@#$%^&!?*_+=~'\-\"]")),
        }
    return _stacked(df, cols, out)


def char_counts(df: DataFrame, column: str) -> DataFrame:
    """(char, n) over the column; the vocabulary is its chars."""
    return df.select(F.explode(F.split(_cell(df, column), "")).alias("char")).where("char <> ''").groupBy("char").agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """(word, n) over the column, words split at white space."""
    return df.select(F.explode(F.split(_cell(df, column), r"\s+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent rows of char_counts() or word_counts(), ties to the smaller key."""
    return counts.orderBy(F.desc("n"), counts.columns[0]).limit(k)


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(column, vocab): the distinct characters in order, as one string."""
    return char_counts(df, column).agg(F.array_join(F.array_sort(F.collect_list("char")), "").alias("vocab")).select(F.lit(column).alias("column"), "vocab")


def edge_chars(df: DataFrame, column: str) -> DataFrame:
    """(edge, char, n): the most frequent first and last characters, ties to the largest character."""
    s = _cell(df, column)
    both = df.select(F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.substring(s, 1, 1).alias("char")), F.struct(F.lit("last").alias("edge"), F.substring(s, -1, 1).alias("char")))).alias("e")).select("e.*").where("char is not null")
    counts = both.groupBy("edge", "char").agg(F.count("*").alias("n"))
    return counts.groupBy("edge").agg(F.max(F.struct("n", "char")).alias("m")).select("edge", "m.char", "m.n")


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, entropy in bits, gini): of the value shares of each column."""
    out = None
    for c in pick(df, columns):
        g = df.select(_cell(df, c).alias("v")).where("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("c"))
        n = F.sum("c")
        row = g.agg((F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("entropy"), (1 - F.sum(F.col("c") * F.col("c")) / (n * n)).alias("gini")).withColumn("column", F.lit(c))
        out = row if out is None else out.unionByName(row)
    return out.select("column", "entropy", "gini")


def booleans(df: DataFrame, column: str) -> DataFrame:
    c = F.col(f"`{column}`")
    return df.agg(F.count_if(c).alias("num_true"), F.count_if(~c).alias("num_false"))


def sample_window(df: DataFrame, order_by: Sequence[str], rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """Cells of a 1-based window of rows and columns, as strings; only the first rows[1] rows are sorted out."""
    require(1 <= rows[0] <= rows[1] and 1 <= columns[0] <= columns[1] <= len(df.columns), "windows are 1-based and in bounds")
    cols = df.columns[columns[0] - 1 : columns[1]]
    top = df.orderBy(*order_by).limit(rows[1])
    numbered = top.withColumn("_row", F.row_number().over(Window.orderBy(*order_by)))
    return numbered.where(F.col("_row") >= rows[0]).select(F.col("_row").alias("row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])


def _marks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: 0 if s is None else sum(unicodedata.category(ch) == "Mn" for ch in unicodedata.normalize("NFD", s))).astype("int64")


def diacritics(df: DataFrame, column: str) -> DataFrame:
    """(column, diacritic_chars): non-spacing marks after canonical decomposition."""
    marks = F.pandas_udf(_marks, T.LongType())
    return df.agg(F.sum(marks(F.coalesce(F.col(f"`{column}`"), F.lit("")))).alias("diacritic_chars")).select(F.lit(column).alias("column"), "diacritic_chars")
