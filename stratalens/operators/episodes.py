"""Maximal frequent episodes of an event sequence.

An episode is a series of event sets; it occurs from a start time if its sets
occur, each as early as can be after the one before, within a window. Support
counts start times.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import require

Episode = tuple[tuple[int, ...], ...]


def _frequent_sets(sequence: DataFrame, min_support: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """Event sets of one timestamp with their times, by levels; times of sets below min_support stay on the executors."""
    rows = sequence.select("ts", F.array_sort(F.array_distinct("events")).alias("events"))
    single = rows.select(F.explode("events").alias("e"), "ts").groupBy("e").agg(F.array_sort(F.collect_set("ts")).alias("t")).where(F.size("t") >= min_support).collect()
    level = {(r["e"],): r["t"] for r in single}
    out = dict(level)
    while level:
        keys = sorted(level)
        nxt = {}
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if a[:-1] == b[:-1]:
                    t = sorted(set(level[a]) & set(out[(b[-1],)]))
                    if len(t) >= min_support:
                        nxt[(*a, b[-1])] = t
        out |= nxt
        level = nxt
    return sorted(out.items())


def _extend(bounds: list[tuple[int, int]], times: list[int], window: int) -> list[tuple[int, int]]:
    """Occurrences (start, end) of an episode followed by a set with these times."""
    out = []
    for start, end in bounds:
        k = bisect_right(times, end)
        if k < len(times) and times[k] - start < window:
            out.append((start, times[k]))
    return out


def contains(big: Episode, small: Episode) -> bool:
    """Whether small's sets are subsets of some of big's sets, in order."""
    at = 0
    for s in big:
        if at < len(small) and set(small[at]) <= set(s):
            at += 1
    return at == len(small)


def maximal_episodes(sequence: DataFrame, min_support: int, window: int) -> DataFrame:
    """(episode array<array<long>>, support) of the frequent episodes that no longer frequent one contains.

    `sequence` has ts and events. Episodes grow depth first, one task per first
    set; location lists of frequent sets are what every task needs. Maximality
    is settled among the survivors of each task.
    """
    require(min_support >= 1 and window >= 1, "min_support and window must be positive")
    sets = _frequent_sets(sequence, min_support)
    spark = sequence.sparkSession
    seeds = spark.range(len(sets), numPartitions=max(1, min(len(sets), 64)))

    def mine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found: list[tuple[Episode, int]] = []

            def grow(episode: Episode, bounds: list[tuple[int, int]]) -> None:
                leaf = True
                for events, times in sets:
                    longer = _extend(bounds, times, window)
                    if len(longer) >= min_support:
                        leaf = False
                        grow((*episode, events), longer)
                if leaf:
                    found.append((episode, len(bounds)))

            for i in pdf["id"]:
                events, times = sets[i]
                grow((events,), [(t, t) for t in times])
            own = [e for e, _ in found]
            keep = [(e, n) for e, n in found if not any(o != e and contains(o, e) for o in own)]
            yield pd.DataFrame({"episode": [[list(s) for s in e] for e, _ in keep], "support": [n for _, n in keep]})

    rows = [(tuple(tuple(s) for s in r["episode"]), r["support"]) for r in seeds.mapInPandas(mine, "episode array<array<long>>, support long").collect()]
    rows.sort(key=lambda r: -sum(map(len, r[0])))
    kept: list[tuple[Episode, int]] = []
    for e, n in rows:
        if not any(contains(o, e) for o, _ in kept):
            kept.append((e, n))
    return spark.createDataFrame([([list(s) for s in e], int(n)) for e, n in kept], "episode array<array<long>>, support long")
