"""Self-join of documents by Jaccard similarity of word n-gram sets: a grouped prefix join.

1. Each document's set is put in hash order. Two sets that link share at least
   a known number of tokens within their first fifth or so, so only those
   leading tokens are counted across the corpus, and documents with too few
   shared ones are out.
2. The leading tokens left are ordered by how many distinct sets have them;
   the rarest, as many as the overlap bound leaves open, are the prefix.
3. Documents that share a prefix token are dealt together, large clusters in
   blocks by size, which only meet blocks of like size. There, documents of
   equal prefix and size collapse into groups, pairs of groups are filtered by
   prefix and size, and members are expanded and verified on whole sets.
Links are returned as a forest that connects whatever is linked, so thousands
of near copies never expand into all their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import bucket_of, cuts, dealt, hashed, narrow, pack, rows, run_lengths, runs, unpack
from .components import components
from .hashing import mix, windows
from .storage import stage, unstage, width

_U, _LOW = np.uint64, np.uint64(0xFFFFFFFF)
_SENT = {"bucket": pa.int32(), "pid": pa.int32(), "blob": pa.binary()}
_SENT_DDL = "bucket int, pid int, blob binary"
_SALTS = 16


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _shares(n: int, percent: int) -> int:
    """Tokens that a set of n shares, at least, within the leading tokens."""
    return max(1, n * (100 - percent) // 100)


def _leading(n: int, percent: int) -> int:
    """How many leading tokens of a set of n are counted."""
    return min(n, n - _ceil(percent * n, 100) + _shares(n, percent))


def _needed(n: int, percent: int) -> int:
    """Shared leading tokens without which a set of n links with nothing, whatever the partner's size."""
    return _shares(_ceil(percent * n, 100), percent)


def _sets(texts: pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, first = hashed(texts, lower=True)
    grams = windows(words, size)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(windows(words[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit fingerprints of each set."""
    out = np.zeros((len(sets), 2), _U)
    for i, s in enumerate(sets):
        out[i] = s.sum(dtype=_U), mix(s + _U(0x9E3779B97F4A7C15)).sum(dtype=_U)
    return out


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, and the first row of each distinct non-empty set."""
    prints = _prints(sets)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return prints, full
    _, at = np.unique(prints[full], axis=0, return_index=True)
    return prints, full[np.sort(at)]


def _asks(size: int, percent: int, buckets: int):
    """Each group's leading tokens by bucket, one entry per token and distinct set."""

    def run(table: pa.Table) -> pa.Table:
        sets = _sets(table["text"], size)
        prints, only = _distinct(sets)
        heads = [sets[i][: _leading(len(sets[i]), percent)] for i in only]
        if not heads:
            return rows(_SENT, bucket=[], pid=[], blob=[])
        h = np.concatenate(heads)
        who = np.repeat(np.arange(len(only)), [len(x) for x in heads])
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        names, bounds = cuts(h, buckets)
        blobs = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            some, code = np.unique(who[a:b], return_inverse=True)
            blobs.append(pack((h[a:b] & _LOW).astype(np.uint32), narrow(code, len(some)), prints[only[some], 1]))
        return rows(_SENT, bucket=names, pid=[table["pid"][0].as_py()] * len(names), blob=blobs)

    return run


def _counts(table: pa.Table) -> pa.Table:
    """Of one bucket: how many distinct sets have each token, told to the groups where that is two or more."""
    pids, bucket = table["pid"].to_pylist(), table["bucket"][0].as_py()
    told = [unpack(x) for x in table["blob"].to_pylist()]
    _, who = np.unique(np.concatenate([x[2] for x in told]), return_inverse=True)
    first = np.cumsum([0, *(len(x[2]) for x in told)])
    pair = np.concatenate([(token.astype(_U) << _U(32)) | who[at + code].astype(_U) for (token, code, _), at in zip(told, first, strict=False)])
    pair.sort()
    pair = pair[runs(pair)] >> _U(32)
    start = runs(pair)
    many = run_lengths(start, len(pair))
    token, many = pair[start][many > 1].astype(np.uint32), many[many > 1]
    out: dict[str, list] = {"bucket": [], "pid": [], "blob": []}
    for pid, (mine, _, _) in zip(pids, told, strict=True) if len(token) else ():
        mine = mine[runs(mine)]
        at = np.minimum(np.searchsorted(token, mine), len(token) - 1)
        at = at[token[at] == mine]
        if len(at):
            out["bucket"].append(bucket)
            out["pid"].append(pid)
            out["blob"].append(pack(token[at], narrow(many[at], int(many.max()) + 1)))
    return rows(_SENT, **out)


_DOC = "doc_id long, n_shingles long, print1 long, print2 long, prefix array<long>, tokens binary"


def _survivors(size: int, percent: int, buckets: int):
    """Every document's size and set fingerprint; prefix and set of those distinct sets that may link."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        sets = _sets(docs["text"], size)
        prints, only = _distinct(sets)
        prefix: list = [None] * len(sets)
        tokens: list = [None] * len(sets)
        if told.num_rows:
            parts = [(b, *unpack(x)) for b, x in zip(told["bucket"].to_pylist(), told["blob"].to_pylist(), strict=True)]
            known = np.concatenate([(_U(b) << _U(32)) | k.astype(_U) for b, k, _ in parts])
            many = np.concatenate([m.astype(np.uint32) for _, _, m in parts])
            order = np.argsort(known)
            known, many = known[order], many[order]
            for i in only:
                n = len(sets[i])
                head = sets[i][: _leading(n, percent)]
                mine = (bucket_of(head, buckets).astype(_U) << _U(32)) | (head & _LOW)
                spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hit = known[spot] == mine
                # Tokens of a single set come first in the order; what they leave of the prefix must reach shared ones.
                room = len(head) - _needed(n, percent) + 1 - int((~hit).sum())
                if room > 0:
                    shared, freq = head[hit], many[spot[hit]]
                    prefix[i] = shared[np.lexsort((shared, freq))[:room]].view(np.int64).tolist()
                    tokens[i] = sets[i].tobytes()
        return pa.table(
            {
                "doc_id": docs["doc_id"].cast(pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "print1": pa.array(prints[:, 0].view(np.int64)), "print2": pa.array(prints[:, 1].copy().view(np.int64)),
                "prefix": pa.array(prefix, pa.list_(pa.int64())), "tokens": pa.array(tokens, pa.binary()),
            }
        )

    return run


class _Forest:
    """Labels of what is connected so far; merging relabels the smaller side."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: np.array([i]) for i in range(n)}

    def merge(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            self.label[self.members[b]] = a
            self.members[a] = np.concatenate([self.members[a], self.members.pop(b)])


def link_forest(sizes: list[int], prefixes: list[tuple], sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link, enough of them to connect all that is linked.

    side: only pairs of different sides are looked at (None: all pairs).
    """
    n = len(sizes)
    groups: dict[tuple, list[int]] = {}
    for i in range(n):
        groups.setdefault((sizes[i], prefixes[i]), []).append(i)
    keys = sorted(groups, key=lambda k: (k[0], groups[k][0]))
    flat = np.concatenate(sets)
    names, code = np.unique(flat, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    seen = np.zeros(len(names), np.int32)
    posting: dict[int, list[int]] = {}
    group_size = np.array([k[0] for k in keys])
    group_members = [np.array(groups[k]) for k in keys]
    forest, out, size = _Forest(n), [], np.array(sizes)

    def verify(x: int, others: np.ndarray) -> None:
        if side is not None:
            others = others[side[others] != side[x]]
        others = others[forest.label[others] != forest.label[x]]
        for at in range(0, len(others), 512):
            some = others[at : at + 512]
            some = some[forest.label[some] != forest.label[x]]
            if not len(some):
                continue
            lens = size[some]
            idx = np.repeat(bounds[some] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
            seen[code[bounds[x] : bounds[x + 1]]] = 1
            shared = np.add.reduceat(seen[code[idx]], np.concatenate([[0], np.cumsum(lens)[:-1]]))
            seen[code[bounds[x] : bounds[x + 1]]] = 0
            for y in some[100 * shared >= percent * (lens + size[x] - shared)]:
                if forest.label[x] != forest.label[y]:
                    forest.merge(x, int(y))
                    out.append((x, int(y)))

    for g, (n_g, prefix) in enumerate(keys):
        met = [posting[t] for t in prefix if t in posting]
        if met:
            near = np.unique(np.concatenate([np.array(p) for p in met]))
            near = near[100 * group_size[near] >= percent * n_g]  # earlier groups are no larger
        else:
            near = np.zeros(0, np.int64)
        own = group_members[g]
        others = np.concatenate([group_members[h] for h in near]) if len(near) else np.zeros(0, np.int64)
        for i, x in enumerate(own):
            verify(int(x), np.concatenate([others, own[:i]]))
        for t in prefix:
            posting.setdefault(t, []).append(g)
    return out


def _verified(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node = table["node"].to_numpy()
        sets = [np.frombuffer(x, _U) for x in table["tokens"].to_pylist()]
        prefixes = [tuple(x) for x in table["prefix"].to_pylist()]
        across = table["i"][0].as_py() != table["j"][0].as_py()
        pairs = link_forest([len(s) for s in sets], prefixes, sets, percent, table["side"].to_numpy() if across else None)
        return pa.table({"a": pa.array([node[x] for x, _ in pairs], pa.int64()), "b": pa.array([node[y] for _, y in pairs], pa.int64())})

    return run


def meetings(nodes: DataFrame, percent: int, block_rows: int, block_tokens: int) -> DataFrame:
    """node, cluster, i, j, side: the pairs of blocks in which each of `nodes(node, n, cluster)` is compared; side is null in small clusters.

    A cluster beyond block_rows members or block_tokens tokens is cut into
    blocks in order of size, and only blocks whose sizes allow a link meet. Places
    in that order come from counts by size, a hash breaking ties. A node weighs
    block_tokens, or block_rows for each token, of a block's block_rows * block_tokens.
    """
    room, span = block_rows * block_tokens, Window.partitionBy("cluster")
    sized = nodes.groupBy("cluster", "n").agg(F.count("*").alias("many")).withColumn("weight", F.greatest(F.lit(block_tokens).cast("long"), F.col("n") * block_rows))
    sized = sized.withColumn("all", F.sum(F.expr("many * weight")).over(span)).where(F.col("all") > room)
    sized = sized.withColumn("before", F.sum(F.expr("many * weight")).over(span.orderBy("n")) - F.expr("many * weight")).drop("all")
    at = lambda place: F.expr(f"(before + weight * {place}) div {room}")
    blocks = sized.select("cluster", "n", F.explode(F.sequence(at("0"), at("(many - 1)"))).alias("side"))
    blocks = blocks.groupBy("cluster", "side").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    others = blocks.select("cluster", F.col("side").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    alike = (percent * F.col("other_low") <= 100 * F.col("high")) & (percent * F.col("low") <= 100 * F.col("other_high"))
    met = blocks.join(others, "cluster").where(alike).groupBy("cluster", "side").agg(F.collect_list("other").alias("others"))
    placed = nodes.join(sized, ["cluster", "n"], "left").select("node", "cluster", at("pmod(xxhash64(node), many)").alias("side"))
    placed = placed.join(met, ["cluster", "side"], "left")
    placed = placed.withColumn("other", F.explode(F.coalesce("others", F.array(F.lit(0).cast("long")))))
    own = F.coalesce("side", F.lit(0))
    return placed.select("node", "cluster", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), "side")


def near_duplicates(docs: DataFrame, shingle: int = 3, percent: int = 90, block_rows: int = 2000, block_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs(doc_id, text)`.

    Documents link when 100 * |intersection| >= percent * |union| of their sets
    of lower-cased word shingles; component_id is the smallest doc_id reachable.
    A text of fewer words than a shingle is one shingle; null texts and texts
    without words have no shingle and link with nothing. Rows with a null
    doc_id get their n_shingles and a null component_id and link with nothing.
    Repeated rows are one class like any copies. Texts of any length are
    compared whole; there is no cap on partners. Empty tables give no rows and
    extra columns are ignored.

    A cluster beyond block_rows members or block_tokens tokens is split into
    blocks by size, whose pairs of like size are verified in tasks of their own.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n = width(docs)
    laid = dealt(docs, n)
    told = laid.select("pid", "text").groupBy("pid").applyInArrow(_asks(shingle, percent, n), _SENT_DDL).groupBy("bucket").applyInArrow(_counts, _SENT_DDL)
    every = stage(laid.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(_survivors(shingle, percent, n), _DOC), "sets")
    key = ["n_shingles", "print1", "print2"]
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    classes = stage(every.where(usable).groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    alive = every.where(usable & F.col("prefix").isNotNull()).join(classes, key)
    alive = stage(alive.groupBy("node").agg(F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens")), "alive")

    # Clusters: what a chain of shared prefix tokens reaches. Every link lies inside one. A token's documents hang
    # on the smallest of their salt, and those on the smallest of all, so that no task gets all of a frequent token.
    posting = alive.select("node", F.explode("prefix").alias("token"), F.pmod(F.xxhash64("node"), F.lit(_SALTS)).alias("salt"))
    near = posting.groupBy("token", "salt").agg(F.min("node").alias("near"))
    hub = near.groupBy("token").agg(F.min("near").alias("hub"))
    edges = posting.join(near, ["token", "salt"]).select(F.col("node").alias("a"), F.col("near").alias("b"))
    clusters = components(edges.unionByName(near.join(hub, "token").select(F.col("near").alias("a"), F.col("hub").alias("b"))))
    nodes = alive.select("node", (F.length("tokens") / 8).cast("long").alias("n")).join(clusters.withColumnRenamed("component", "cluster"), "node")
    met = meetings(nodes, percent, block_rows, block_tokens)
    # Small clusters share a task; blocks of a large one get one for each pair.
    bin_ = F.when(F.col("side").isNull(), F.pmod(F.xxhash64("cluster"), F.lit(4 * n))).otherwise(F.col("cluster") + 4 * n)
    work = alive.join(met, "node").withColumn("bin", bin_).select("bin", "i", "j", "side", "node", "prefix", "tokens")
    links = components(work.groupBy("bin", "i", "j").applyInArrow(_verified(percent), "a long, b long"))
    unstage(alive)

    named = classes.join(links, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    plain = every.select("doc_id", *key)
    out = plain.where(usable).join(named, key).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(plain.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """One document of each component: the one whose doc_id names it. Null doc_ids are kept."""
    found = near_duplicates(docs, **how)
    gone = found.where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
