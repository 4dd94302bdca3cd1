"""Verdicts on a functional dependency that follow inserts, updates and deletes.

State is the table of (left, right) value counts. A batch becomes signed
counts that are added to it; only groups that a batch touches change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.options import pick, require


class DynamicFD:
    """A dependency lhs -> rhs over a changing table with a row id column.

    `current` holds the rows (id, lhs, rhs values) and `counts` the state.
    """

    def __init__(self, table: DataFrame, row_id: str, lhs: Sequence[str], rhs: Sequence[str]):
        self.row_id, self.lhs, self.rhs = row_id, pick(table, lhs, "lhs"), pick(table, rhs, "rhs")
        require(row_id in table.columns, f"no column {row_id}")
        self.current = self._rows(table)
        self.counts = self._signed(self.current, 1)

    def _rows(self, df: DataFrame) -> DataFrame:
        missing = [c for c in (self.row_id, *self.lhs, *self.rhs) if c not in df.columns]
        require(not missing, f"missing columns: {missing}")
        return df.select(F.col(f"`{self.row_id}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in self.lhs]).alias("x"), F.struct(*[F.col(f"`{c}`") for c in self.rhs]).alias("a"))

    @staticmethod
    def _signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.groupBy("x", "a").agg((sign * F.count("*")).alias("c"))

    def apply(self, insert: DataFrame | None = None, delete: DataFrame | None = None, update: DataFrame | None = None) -> None:
        """insert: new rows; delete: a frame with the row id column; update: rows whose ids exist. Bad ids raise."""
        changes = []
        gone = None
        for name, df in (("delete", delete), ("update", update)):
            if df is None:
                continue
            ids = df.select(F.col(f"`{self.row_id}`").alias("id"))
            require(ids.count() == ids.distinct().count(), f"{name}: a row id is repeated")
            require(not ids.join(self.current, "id", "left_anti").take(1), f"{name}: unknown row id")
            require(gone is None or not ids.join(gone, "id", "left_semi").take(1), "a row is both deleted and updated")
            gone = ids if gone is None else gone.union(ids)
        rows = self.current
        if gone is not None:
            changes.append(self._signed(rows.join(gone, "id", "left_semi"), -1))
            rows = rows.join(gone, "id", "left_anti")
        for name, df in (("insert", insert), ("update", update)):
            if df is None:
                continue
            new = self._rows(df)
            if name == "insert":
                require(not new.join(self.current, "id", "left_semi").take(1) and new.count() == new.select("id").distinct().count(), "insert: a row id exists already")
            changes.append(self._signed(new, 1))
            rows = rows.union(new)
        for c in changes:
            self.counts = self.counts.union(c)
        self.counts = self.counts.groupBy("x", "a").agg(F.sum("c").alias("c")).where("c <> 0")
        self.current = rows

    def verdict(self) -> DataFrame:
        """One row: holds, error, num_error_clusters, num_error_rows."""
        g = self.counts.groupBy("x").agg(F.sum("c").alias("s"), F.count("*").alias("nd"), F.sum(F.col("c") * F.col("c")).alias("q"))
        bad = F.col("nd") > 1
        zero = lambda e: F.coalesce(F.sum(F.when(bad, e)), F.lit(0))
        m = g.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("n"), zero(F.col("s") * F.col("s") - F.col("q")).alias("p"), F.count_if(bad).alias("k"), zero(F.col("s")).alias("r"))
        error = F.when(F.col("n") > 1, F.col("p") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
        return m.select((F.col("k") == 0).alias("holds"), error.alias("error"), F.col("k").alias("num_error_clusters"), F.col("r").alias("num_error_rows"))


def follow(stream: DataFrame, lhs: Sequence[str], rhs: Sequence[str], query_name: str, checkpoint: str) -> StreamingQuery:
    """Keep per-group counts of an append-only stream in a memory table: lhs, rhs, c.

    The verdict of the moment is an aggregation over that table; Spark keeps
    the state and its recovery.
    """
    x, a = pick(stream, lhs, "lhs"), pick(stream, rhs, "rhs")
    counts = stream.groupBy(F.struct(*x).alias("lhs"), F.struct(*a).alias("rhs")).agg(F.count("*").alias("c"))
    return counts.writeStream.outputMode("complete").format("memory").queryName(query_name).option("checkpointLocation", checkpoint).start()
