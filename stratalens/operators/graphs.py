"""Patterns over graphs: validation and mining of graph dependencies, frequent subgraphs.

A graph is two frames: vertices(id, label, attrs MAP<STRING,STRING>) and
edges(src, dst, label). Pattern embeddings are chains of joins along the
pattern's edges, with labels filtered before each join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations, permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.options import require


@dataclass(frozen=True)
class Pattern:
    """Vertex labels by position ('_' fits any) and edges (from, to, label)."""

    labels: tuple[str, ...]
    edges: tuple[tuple[int, int, str], ...]


@dataclass(frozen=True)
class Literal:
    """vertex.attr = other.attr2, or a constant where other is -1."""

    vertex: int
    attr: str
    other: int
    value: str


@dataclass(frozen=True)
class GFD:
    pattern: Pattern
    premises: tuple[Literal, ...] = ()
    conclusions: tuple[Literal, ...] = ()


_ATTRIBUTE = re.compile(r"(\d+)\.([^\W\d]\w*)")


def parse_gfd(text: str) -> GFD:
    """A dependency: a line of premises, a line of conclusions, then its pattern as a dot graph.

    Literals are apart by blanks: `0.name=1.name`, or `0.name=value` for a constant.
    """
    head, found, graph = text.partition("{")
    lines = head.rsplit("\n", 1)[0].split("\n") if found else []
    require(len(lines) == 2, "a dependency starts with a line of premises and one of conclusions")

    def literals(line: str) -> tuple[Literal, ...]:
        out = []
        for item in line.split():
            left, _, right = item.partition("=")
            own, other = _ATTRIBUTE.fullmatch(left), _ATTRIBUTE.fullmatch(right)
            require(own is not None and right != "", f"not a literal: {item}")
            out.append(Literal(int(own[1]), own[2], *((int(other[1]), other[2]) if other else (-1, right))))
        return tuple(out)

    labels = {int(v): x.strip() for v, x in re.findall(r"^\s*(\d+)\s*\[\s*label\s*=\s*\"?([^\"\];,]*)", graph, re.M)}
    edges = [(int(a), int(b), x.strip()) for a, b, x in re.findall(r"(\d+)\s*-[->]\s*(\d+)\s*(?:\[\s*label\s*=\s*\"?([^\"\];,]*))?", graph)]
    require(sorted(labels) == list(range(len(labels))) and all(v in labels for a, b, _ in edges for v in (a, b)), "vertices must be numbered from 0")
    return GFD(Pattern(tuple(labels[v] for v in sorted(labels)), tuple(edges)), literals(lines[0]), literals(lines[1]))


def format_gfd(gfd: GFD) -> str:
    """The text that parse_gfd() reads."""
    literals = lambda items: " ".join(f"{x.vertex}.{x.attr}={x.value if x.other == -1 else f'{x.other}.{x.value}'}" for x in items)
    vertices = [f"{v}[label={x}];" for v, x in enumerate(gfd.pattern.labels)]
    edges = [f"{a}--{b} [label={x}];" for a, b, x in gfd.pattern.edges]
    return "\n".join([literals(gfd.premises), literals(gfd.conclusions), "graph G {", *vertices, *edges, "}", ""])


def embeddings(vertices: DataFrame, edges: DataFrame, pattern: Pattern, directed: bool = False, injective: bool = True) -> DataFrame:
    """Columns v0, v1, ... of vertex ids and a0, a1, ... of their attributes: every place the pattern occurs.

    Undirected edges are stored once and followed both ways. Injective matching
    is subgraph isomorphism on the pattern's edges; otherwise homomorphism.
    """
    require(bool(pattern.labels), "a pattern needs a vertex")
    fits = lambda i: vertices.where((F.col("label") == pattern.labels[i]) if pattern.labels[i] != "_" else F.lit(True))
    links = edges.select("src", "dst", F.col("label").alias("elabel"))
    if not directed:
        links = links.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("label").alias("elabel"))).distinct()
    out = fits(0).select(F.col("id").alias("v0"), F.col("attrs").alias("a0"))
    placed, left = {0}, list(pattern.edges)
    while left:
        edge = next((e for e in left if e[0] in placed or e[1] in placed), None)
        require(edge is not None, "a pattern must be connected")
        left.remove(edge)
        a, b, label = edge
        step = links.where((F.col("elabel") == label) if label != "_" else F.lit(True)).select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
        if a in placed and b in placed:
            out = out.join(step, (F.col(f"v{a}") == F.col("_s")) & (F.col(f"v{b}") == F.col("_d")), "left_semi")
            continue
        old, new = (a, b) if a in placed else (b, a)
        near, far = ("_s", "_d") if a in placed else ("_d", "_s")
        reach = step.join(fits(new).select(F.col("id").alias(f"v{new}"), F.col("attrs").alias(f"a{new}")), F.col(far) == F.col(f"v{new}"))
        out = out.join(reach, F.col(f"v{old}") == F.col(near)).drop("_s", "_d")
        if injective:
            for k in placed:
                out = out.where(F.col(f"v{k}") != F.col(f"v{new}"))
        placed.add(new)
    require(len(placed) == len(pattern.labels), "a pattern must be connected")
    return out


def _all_hold(literals: Sequence[Literal]) -> Column:
    out = F.lit(True)
    for x in literals:
        left = F.col(f"a{x.vertex}")[x.attr]
        right = F.lit(x.value) if x.other < 0 else F.col(f"a{x.other}")[x.value]
        out = out & F.coalesce(left == right, F.lit(False))
    return out


def gfd_violations(vertices: DataFrame, edges: DataFrame, gfd: GFD) -> DataFrame:
    """Embeddings that meet the premises and not the conclusions."""
    return embeddings(vertices, edges, gfd.pattern).where(_all_hold(gfd.premises) & ~_all_hold(gfd.conclusions)).select(*[f"v{i}" for i in range(len(gfd.pattern.labels))])


def valid_gfds(vertices: DataFrame, edges: DataFrame, gfds: Sequence[GFD]) -> list[GFD]:
    """Those that hold on the graph."""
    return [g for g in gfds if not gfd_violations(vertices, edges, g).take(1)]


_COMPARE = {"<=": lambda d, k: d <= k, ">=": lambda d, k: d >= k, "<": lambda d, k: d < k, ">": lambda d, k: d > k, "=": lambda d, k: d == k, "!=": lambda d, k: d != k}


@dataclass(frozen=True)
class Distance:
    """distance(vertex.attr, other.attr2 or constant) op bound; 'abs' on numbers, 'edit' on text."""

    vertex: int
    attr: str
    op: str
    bound: float
    other: int = -1
    value: str = ""
    metric: str = "abs"


@dataclass(frozen=True)
class GDD:
    pattern: Pattern
    premises: tuple[Distance, ...] = ()
    conclusions: tuple[Distance, ...] = ()


def _all_within(items: Sequence[Distance]) -> Column:
    out = F.lit(True)
    for x in items:
        require(x.op in _COMPARE and x.metric in ("abs", "edit"), "unknown operator or metric")
        a = F.col(f"a{x.vertex}")[x.attr]
        b = F.lit(x.value) if x.other < 0 else F.col(f"a{x.other}")[x.value]
        d = F.levenshtein(a, b).cast("double") if x.metric == "edit" else F.abs(a.try_cast("double") - b.try_cast("double"))
        out = out & F.coalesce(_COMPARE[x.op](d, F.lit(float(x.bound))), F.lit(False))
    return out


def gdd_violations(vertices: DataFrame, edges: DataFrame, gdd: GDD) -> DataFrame:
    """Homomorphic, directed matches that meet the premises and not the conclusions; each is a counterexample."""
    found = embeddings(vertices, edges, gdd.pattern, directed=True, injective=False)
    return found.where(_all_within(gdd.premises) & ~_all_within(gdd.conclusions)).select(*[f"v{i}" for i in range(len(gdd.pattern.labels))])


def mine_gfds(vertices: DataFrame, edges: DataFrame, k: int = 2, sigma: int = 2, attrs: Sequence[str] | None = None, max_premises: int = 1) -> list[tuple[GFD, int]]:
    """GFDs over tree patterns of up to k vertices whose least number of distinct images per vertex is sigma or more.

    Conclusions are single literals with values or attributes seen in sigma or
    more embeddings; of two rules with one conclusion the one with fewer
    premises is kept.
    """
    frequent = [r["label"] for r in vertices.groupBy("label").count().where(F.col("count") >= sigma).collect()]
    steps = edges.join(vertices.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(vertices.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    kinds = {(r["ls"], r["label"], r["ld"]) for r in steps.groupBy("ls", "label", "ld").count().where(F.col("count") >= sigma).collect()}
    kinds |= {(b, e, a) for a, e, b in kinds}
    names = list(attrs) if attrs is not None else [r["k"] for r in vertices.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect() if r["k"] != "label"]
    level = [Pattern((x,), ()) for x in sorted(frequent)]
    out: list[tuple[GFD, int]] = []
    for size in range(1, k + 1):
        nxt: dict[tuple, Pattern] = {}
        for p in level:
            found = embeddings(vertices, edges, p).persist()
            try:
                n = len(p.labels)
                images = found.agg(*[F.count_distinct(f"v{i}").alias(f"n{i}") for i in range(n)]).first()
                support = min(images[f"n{i}"] for i in range(n))
                if support < sigma:
                    continue
                out += [(g, support) for g in _rules(found, p, names, sigma, max_premises)]
                for i in range(n):
                    for a, e, b in sorted(kinds):
                        if a == p.labels[i] and size < k:
                            q = Pattern((*p.labels, b), (*p.edges, (i, n, e)))
                            nxt.setdefault((tuple(sorted(q.labels)), tuple(sorted((tuple(sorted((q.labels[x], q.labels[y]))), z) for x, y, z in q.edges))), q)
            finally:
                found.unpersist()
        level = list(nxt.values())
    return out


def _rules(found: DataFrame, p: Pattern, names: Sequence[str], sigma: int, max_premises: int) -> list[GFD]:
    n = len(p.labels)
    literals = [Literal(i, a, j, b) for i, j in combinations(range(n), 2) for a in names for b in names]
    for i in range(n):
        for a in names:
            seen = found.groupBy(F.col(f"a{i}")[a].alias("v")).count().where(F.col("v").isNotNull() & (F.col("count") >= sigma)).orderBy("v")
            literals += [Literal(i, a, -1, r["v"]) for r in seen.collect()]
    if not literals:
        return []
    bits = found.select(*[_all_hold([x]).alias(f"h{m}") for m, x in enumerate(literals)])
    classes = bits.groupBy(*bits.columns).count().collect()
    rows = [({m for m in range(len(literals)) if r[f"h{m}"]}, r["count"]) for r in classes]
    live = [m for m in range(len(literals)) if sum(c for s, c in rows if m in s) >= sigma]
    out, done = [], []
    for size in range(max_premises + 1):
        for prem in combinations(live, size):
            met = [(s, c) for s, c in rows if set(prem) <= s]
            if sum(c for _, c in met) < sigma:
                continue
            for m in live:
                if m not in prem and all(m in s for s, _ in met) and not any(dm == m and dp <= set(prem) for dp, dm in done):
                    done.append((set(prem), m))
                    out.append(GFD(p, tuple(literals[x] for x in prem), (literals[m],)))
    return out


# Frequent subgraphs of many small labelled graphs.

Code = tuple[tuple[int, int, str, str, str], ...]


@dataclass
class SmallGraph:
    labels: dict[int, str]
    edges: list[tuple[int, int, str]] = field(default_factory=list)


def parse_graphs(text: str) -> list[tuple[int, SmallGraph]]:
    """Graphs in lines `t # id`, `v id label`, `e from to label`."""
    out: list[tuple[int, SmallGraph]] = []
    for line in text.splitlines():
        parts = line.split()
        if not parts:
            continue
        if parts[0] == "t":
            require(len(parts) >= 3, f"not a graph line: {line}")
            if parts[2] != "-1":
                out.append((int(parts[2]), SmallGraph({})))
        elif parts[0] == "v":
            out[-1][1].labels[int(parts[1])] = parts[2]
        elif parts[0] == "e":
            require({int(parts[1]), int(parts[2])} <= set(out[-1][1].labels), f"an edge of unknown vertices: {line}")
            out[-1][1].edges.append((int(parts[1]), int(parts[2]), parts[3]))
    return out


def format_graphs(graphs: Sequence[tuple[int, SmallGraph]]) -> str:
    lines = []
    for i, g in graphs:
        lines += [f"t # {i}", *(f"v {v} {x}" for v, x in sorted(g.labels.items())), *(f"e {a} {b} {x}" for a, b, x in g.edges)]
    return "\n".join(lines) + "\n"


def canonical(labels: Sequence[str], edges: Sequence[tuple[int, int, str]]) -> str:
    """A text that is equal for isomorphic small graphs: the least over vertex orders that respect local invariants."""
    n = len(labels)
    near: list[list] = [[] for _ in range(n)]
    for a, b, x in edges:
        near[a].append((x, b))
        near[b].append((x, a))
    colour = [str(x) for x in labels]
    for _ in range(n):  # refine by neighbours until classes are stable
        new = [repr((colour[v], sorted((x, colour[w]) for x, w in near[v]))) for v in range(n)]
        ranks = {c: str(i) for i, c in enumerate(sorted(set(new)))}
        new = [f"{labels[v]}|{ranks[new[v]]}" for v in range(n)]
        if len(set(new)) == len(set(colour)):
            colour = new
            break
        colour = new
    classes: dict[str, list[int]] = {}
    for v in range(n):
        classes.setdefault(colour[v], []).append(v)
    orders: list[list[int]] = [[]]
    for c in sorted(classes):
        orders = [o + list(p) for o in orders for p in permutations(classes[c])]
    best = None
    for o in orders:
        at = {v: i for i, v in enumerate(o)}
        code = (tuple(labels[v] for v in o), tuple(sorted((min(at[a], at[b]), max(at[a], at[b]), x) for a, b, x in edges)))
        if best is None or code < best:
            best = code
    return repr(best)


_GRAPH = "graph_id long, vertices array<struct<id:int,label:string>>, edges array<struct<src:int,dst:int,label:string>>"


def graph_frame(spark, graphs: Sequence[tuple[int, SmallGraph]]) -> DataFrame:
    rows = [(i, sorted(g.labels.items()), list(g.edges)) for i, g in graphs]
    return spark.createDataFrame(rows, _GRAPH)


def frequent_subgraphs(graphs: DataFrame, min_support: float, max_edges: int = 3, single_vertices: bool = False) -> DataFrame:
    """Connected subgraphs of at least ceil(min_support * n) graphs: rows (code, labels, edges, support).

    By levels of edges: each graph lists its connected subgraphs of one edge
    more that extend a frequent one of the level before; codes are counted over
    graphs. Graphs stay where they are; only codes move.
    """
    require(0 < min_support <= 1, "min_support lies in (0, 1]")
    n = graphs.count()
    least = max(1, math.ceil(min_support * n - 1e-9))
    spark = graphs.sparkSession
    out: list[tuple] = []
    if single_vertices:
        one = graphs.select("graph_id", F.explode(F.array_distinct("vertices.label")).alias("l")).groupBy("l").count().where(F.col("count") >= least)
        out += [(canonical([r["l"]], []), [r["l"]], [], r["count"]) for r in one.collect()]
    previous: set[str] | None = None
    for size in range(1, max_edges + 1):
        wanted = previous

        def grow(frames: Iterator[pd.DataFrame], size: int = size, wanted: set[str] | None = wanted) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                rows = []
                for gid, vs, es in zip(pdf["graph_id"], pdf["vertices"], pdf["edges"], strict=True):
                    label = {v["id"]: v["label"] for v in vs}
                    edges = [(e["src"], e["dst"], e["label"]) for e in es]
                    sets = {frozenset([k]) for k in range(len(edges))}
                    for step in range(2, size + 1):
                        nxt = set()
                        for s in sets:
                            if step == size and wanted is not None and _code(s, edges, label)[0] not in wanted:
                                continue
                            ends = {v for k in s for v in edges[k][:2]}
                            nxt |= {s | {k} for k in range(len(edges)) if k not in s and {edges[k][0], edges[k][1]} & ends}
                        sets = nxt
                    seen = {}
                    for s in sets:
                        code, labels, own = _code(s, edges, label)
                        seen[code] = (labels, own)
                    rows += [(gid, code, labels, repr(own)) for code, (labels, own) in seen.items()]
                yield pd.DataFrame(rows, columns=["graph_id", "code", "labels", "edges"])

        found = graphs.mapInPandas(grow, "graph_id long, code string, labels array<string>, edges string")
        counted = found.groupBy("code").agg(F.count_distinct("graph_id").alias("n"), F.first("labels").alias("labels"), F.first("edges").alias("edges")).where(F.col("n") >= least).collect()
        if not counted:
            break
        import ast

        out += [(r["code"], r["labels"], ast.literal_eval(r["edges"]), r["n"]) for r in counted]
        previous = {r["code"] for r in counted}
    return spark.createDataFrame(out, "code string, labels array<string>, edges array<struct<src:int,dst:int,label:string>>, support long")


_canonical = lru_cache(maxsize=100_000)(canonical)


def _code(s: frozenset, edges: list, label: dict) -> tuple[str, list, list]:
    ids = sorted({v for k in s for v in edges[k][:2]})
    at = {v: i for i, v in enumerate(ids)}
    labels = [label[v] for v in ids]
    own = sorted((min(at[a], at[b]), max(at[a], at[b]), x) for a, b, x in (edges[k] for k in s))
    return _canonical(tuple(labels), tuple(own)), labels, own
