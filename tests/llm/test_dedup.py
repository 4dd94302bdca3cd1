"""Near duplicates, passages and components against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from stratalens.llm import components, jaccard, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def reach(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def brute_components(corpus, k, percent):
    sets = {(d, t): shingles(t, k) for d, t, *_ in corpus}
    links = [(a[0], b[0]) for a, b in itertools.combinations(sets, 2) if None not in (a[0], b[0]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = reach({d for d, *_ in corpus if d is not None}, links)
    return sorted((d is None, d or 0, len(sets[d, t]), label.get(d)) for d, t, *_ in corpus)


@pytest.mark.parametrize("k, percent, block_rows", [(3, 90, 2000), (5, 80, 2)])
def test_near_duplicates(docs, corpus, k, percent, block_rows):
    """Against brute force; the second case splits every larger cluster into blocks."""
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, k, percent, block_rows).collect())
    assert got == brute_components(corpus, k, percent)


def test_keep_first(docs, corpus):
    out = jaccard.keep_first(docs)
    label = {d: c for null, d, _, c in brute_components(corpus, 3, 90) if not null}
    assert sorted(str(r["doc_id"]) for r in out.select("doc_id").collect()) == sorted(str(d) for d, *_ in corpus if d is None or label[d] == d)
    assert set(out.columns) == set(docs.columns)


@pytest.mark.parametrize("seed", range(3))
def test_link_forest(seed):
    rng = random.Random(seed)
    sets = [np.array(sorted(rng.sample(range(14), rng.randint(1, 10))), np.uint64) for _ in range(30)]
    percent = 60
    order = lambda s: tuple(s.tolist()[: len(s) - -(-percent * len(s) // 100) + 1])
    got = jaccard.link_forest([len(s) for s in sets], [order(s) for s in sets], sets, percent)
    links = [(a, b) for a, b in itertools.combinations(range(30), 2) if 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= percent * len(set(sets[a].tolist()) | set(sets[b].tolist()))]
    assert reach(range(30), got) == reach(range(30), links) and set(map(tuple, map(sorted, got))) <= set(links)


def brute_removed(corpus, window):
    starts = {}
    for d, t, *_ in corpus:
        w = words(t)
        for i in range(len(w) - window + 1):
            if d is not None:
                starts.setdefault(tuple(w[i : i + window]), set()).add(d)
    out = []
    for d, t, *_ in corpus:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and min(starts[tuple(w[i : i + window])]) < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 7])
def test_substrings(docs, corpus, window):
    rows = substrings.dedup_substrings(docs, window).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in rows)
    assert got == brute_removed(corpus, window)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"]) for r in rows)


def test_empty_tables(empty, spark):
    assert jaccard.near_duplicates(empty).count() == 0
    assert substrings.dedup_substrings(empty).count() == 0
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(20, 40)] + [(rng.randint(0, 15), rng.randint(0, 15)) for _ in range(10)] + [(3, 3), (None, 4), (20, 21)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = reach({x for e in real for x in e}, real)
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == want


def test_blocks_meet_by_size(spark):
    """All pairs of like size meet once, and a large cluster's members are not sent to all of its blocks."""
    rng = random.Random(6)
    nodes = [(i, int(20 * 1.0025**i) if i % 5 else 100, 7) for i in range(1500)] + [(2000 + i, 40 + i, 8) for i in range(10)]
    rows = jaccard.meetings(spark.createDataFrame(nodes, "node long, n long, cluster long"), 90, 20, 10**6).collect()
    size, met = {i: n for i, n, _ in nodes}, {}
    for r in rows:
        met.setdefault((r["cluster"], r["i"], r["j"]), []).append((r["node"], r["side"]))
    assert {r["side"] for r in rows if r["cluster"] == 8} == {None} and len(met[8, 0, 0]) == 10
    got = [frozenset((a, b)) for (_, i, j), some in met.items() for (a, x), (b, y) in itertools.combinations(some, 2) if i == j or x != y]
    pairs = set(got)
    assert len(got) == len(pairs)
    for a, b in ((rng.randrange(1500), rng.randrange(1500)) for _ in range(40_000)):
        if a != b and 90 * max(size[a], size[b]) <= 100 * min(size[a], size[b]):
            assert frozenset((a, b)) in pairs
    assert len(rows) <= 15 * 1500  # blocks by a hash of the node send each to all 75
