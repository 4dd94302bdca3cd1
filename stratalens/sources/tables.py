"""Loading tables, baskets, event sequences and graphs; writing results."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.options import require

#: Recognised forms of cells, in order of precedence.
TYPE_PATTERNS = (
    ("date", r"^(1[4-9]\d\d|[2-9]\d{3})([-./])(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])$"),
    ("int", r"^[+-]?\d{1,19}$"),
    ("bigint", r"^[+-]?\d{20,}$"),
    ("double", r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan)$"),
    ("bool", r"^\s*(?i:true|false|0|1)\s*$"),
)
_SPARK_TYPE = {"int": "bigint", "bigint": "decimal(38,0)", "double": "double", "bool": "boolean", "date": "date"}


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, infer: bool = False, schema: str | None = None) -> DataFrame:
    """A CSV file as text columns, named "0", "1", ... without a header or a schema; NULL is null and empty stays empty.

    Rows of the wrong width are dropped; without a schema, the first row's width
    counts. infer casts each column by infer_types().
    """
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED")
    reader = reader.option("nullValue", "NULL").option("emptyValue", "")
    # Whole rows are asked for: a scan that prunes columns would not see a row's width.
    df = (reader.schema(schema) if schema else reader).option("columnPruning", "false").csv(path)
    if not header and not schema:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    return cast_inferred(df) if infer else df


def infer_types(df: DataFrame) -> dict[str, str]:
    """One scan: the first form that all non-null, non-empty cells of a text column have; else string, or undefined."""
    aggs = []
    for i, c in enumerate(df.columns):
        cell = F.col(f"`{c}`").cast("string")
        full = cell.isNotNull() & (cell != "")
        aggs.append(F.count_if(full).alias(f"n{i}"))
        wide = {"bigint": "int", "double": "int"}
        for name, pattern in TYPE_PATTERNS:
            fits = cell.rlike(pattern)
            if name in wide:
                fits = fits | cell.rlike(dict(TYPE_PATTERNS)[wide[name]])
            aggs.append(F.count_if(full & fits).alias(f"{name}{i}"))
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        out[c] = "undefined" if not n else next((name for name, _ in TYPE_PATTERNS if r[f"{name}{i}"] == n), "string")
    return out


def cast_inferred(df: DataFrame) -> DataFrame:
    kinds = infer_types(df)
    dates = lambda c: F.to_date(F.regexp_replace(c, r"[./]", "-"))
    cell = lambda c: F.when(F.col(f"`{c}`") != "", F.trim(F.col(f"`{c}`")))
    return df.select(*[(dates(cell(c)) if kinds[c] == "date" else cell(c).cast(_SPARK_TYPE[kinds[c]])).alias(c) if kinds[c] in _SPARK_TYPE else F.col(f"`{c}`") for c in df.columns])


def load(spark: SparkSession, table) -> DataFrame:
    """A DataFrame from itself, a pandas frame, a Parquet path or a (path, separator, has_header) tuple."""
    if isinstance(table, DataFrame):
        return table
    if isinstance(table, tuple):
        return read_csv(spark, *table)
    if isinstance(table, str):
        return spark.read.csv(table, header=True) if table.endswith(".csv") else spark.read.parquet(table)
    return spark.createDataFrame(table)


def baskets_from_rows(df: DataFrame, tid: str, item: str) -> DataFrame:
    """(tid, items): one row per (tid, item) merged to a set per tid."""
    return df.groupBy(F.col(f"`{tid}`").alias("tid")).agg(F.array_sort(F.collect_set(F.col(f"`{item}`").cast("string"))).alias("items"))


def baskets_from_columns(df: DataFrame, tid: str | None = None) -> DataFrame:
    """(tid, items): one basket per row, blank cells skipped; rows that repeat a tid are merged."""
    cells = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.trim(F.col(f"`{c}`").cast("string"))) for c in df.columns if c != tid]
    key = F.col(f"`{tid}`") if tid else F.monotonically_increasing_id()
    rows = df.select(key.alias("tid"), F.array_distinct(F.array_compact(F.array(*cells))).alias("items"))
    return rows.groupBy("tid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")) if tid else rows


def sequence_from_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """(ts, events) of lines `e1 e2 ...` or `e1 e2 ...|ts`; all with a timestamp or none, then numbered."""
    rows: list[tuple[int, list[int]]] = []
    stamped = None
    for k, line in enumerate(x for x in lines if x.strip()):
        events, bar, ts = line.partition("|")
        require(stamped is None or stamped == bool(bar), "lines with and without timestamps are mixed")
        stamped = bool(bar)
        found = [int(e) for e in events.split()]
        require(found == sorted(set(found)), f"events of a line must be sorted and distinct: {line}")
        rows.append((int(ts) if bar else k, found))
    return spark.createDataFrame(rows, "ts long, events array<long>")


def parse_dot(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a dot graph; an attribute map per vertex, its label apart."""
    vertices, edges = [], []
    for name, target, attrs in re.findall(r"(\w+)\s*(?:(?:->|--)\s*(\w+)\s*)?\[([^\]]*)\]", text):
        fields = {k: (q or v) for k, q, v in re.findall(r"(\w+)\s*=\s*(?:\"([^\"]*)\"|([^,\s\]]+))", attrs)}
        if target:
            edges.append((int(name), int(target), fields.get("label", "")))
        elif name not in ("graph", "node", "edge"):
            vertices.append((int(name), fields.get("label", ""), fields))
    return (
        spark.createDataFrame(vertices, "id long, label string, attrs map<string,string>"),
        spark.createDataFrame(edges, "src long, dst long, label string"),
    )


def format_dot(vertices: DataFrame, edges: DataFrame, directed: bool = False) -> str:
    """A dot text of a small graph; its rows come to the driver."""
    show = lambda m: ", ".join(f'{k}="{v}"' for k, v in sorted(m.items()))
    lines = [f"{r['id']} [{show({**(r['attrs'] or {}), 'label': r['label']})}];" for r in vertices.orderBy("id").collect()]
    arrow = "->" if directed else "--"
    lines += [f'{r["src"]} {arrow} {r["dst"]} [label="{r["label"]}"];' for r in edges.orderBy("src", "dst", "label").collect()]
    return f"{'digraph' if directed else 'graph'} G {{\n" + "\n".join(lines) + "\n}\n"


def parse_intervals(cells: Sequence[str]) -> list[tuple[float, float]]:
    """Intervals of a difference table, cells like [a;b]."""
    out = []
    for c in cells:
        m = re.fullmatch(r"\s*\[\s*([\d.]+)\s*;\s*([\d.]+)\s*\]\s*", c)
        require(m is not None, f"not an interval: {c}")
        require(float(m[1]) <= float(m[2]), f"an interval's ends are swapped: {c}")
        out.append((float(m[1]), float(m[2])))
    return out


def write_json(df: DataFrame, path: str) -> None:
    """A result as JSON lines."""
    df.write.mode("overwrite").json(path)
