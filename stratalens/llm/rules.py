"""Quality rules with risk-controlled thresholds.

Texts are reduced to counts; rates of them are tested against fixed ladders of
candidate cutoffs. A cutoff may be used in a stratum only if labelled good
documents bound its false rejections: the exact binomial probability of seeing
so few under the allowed rate must fall below the error level divided by the
number of (stratum, rule) pairs. Cutoffs of a rule are tested from the loosest
on, up to the first that fails; the rule takes the last certified one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import run_lengths
from .hashing import Words, byte_hash, slices, windows
from .storage import stage

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")
_SYMBOL, _MARK, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8)] = True
_MARK[ord("!")] = True
_CAPITAL[ord("A") : ord("Z") + 1] = True
REPEAT_WINDOW = 8


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    w = Words(texts)
    docs = len(w.counts)
    out = {"n_words": w.counts}
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    out["word_chars"] = _per_doc(inside & ((w.data & 0xC0) != 0x80), w.bounds)
    out["n_symbols"] = _per_doc(_SYMBOL[w.data], w.bounds)
    out["n_marks"] = _per_doc(_MARK[w.data], w.bounds)
    out["n_capitals"] = _per_doc(_CAPITAL[w.data], w.bounds)
    # Lines: cut after each newline and at document bounds; those with a word count.
    begins = np.unique(np.concatenate([w.bounds[:-1][np.diff(w.bounds) > 0], np.flatnonzero(w.data == 10) + 1]))
    begins = begins[begins < len(w.data)]
    ends = np.append(begins[1:], len(w.data))
    filled = np.searchsorted(w.start, ends) > np.searchsorted(w.start, begins)
    begins, ends = begins[filled], ends[filled]
    ends = ends - (w.data[ends - 1] == 10)
    owner = np.searchsorted(w.bounds, begins, "right") - 1
    line = byte_hash(w.data, begins, ends)
    order = np.lexsort((line, owner))
    same = (np.diff(line[order]) == 0) & (np.diff(owner[order]) == 0)
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = np.bincount(owner[order][1:][same], minlength=docs)
    # Words under windows that occur twice or more in their text.
    size = REPEAT_WINDOW
    h = windows(w.hashes(0), size)
    who = np.repeat(np.arange(docs), w.counts)
    at = np.flatnonzero(np.arange(len(h)) + size <= w.first[who[: len(h)] + 1])
    order = np.lexsort((h[at], who[at]))
    at = at[order]
    key_new = np.concatenate([[True], (np.diff(h[at]) != 0) | (np.diff(who[at]) != 0)]) if len(at) else np.zeros(0, bool)
    start = np.flatnonzero(key_new)
    again = at[np.repeat(run_lengths(start, len(at)) > 1, run_lengths(start, len(at)))]
    cover = np.zeros(len(who) + size + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + size, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover)[: len(who)] > 0, w.first)
    return out


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in slices(batch.set_column(2, "text", batch.column(2).fill_null("")), "text"):
            found = counts(some.column(2))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", "stratum", *COUNTS])


def signals(docs: DataFrame, stratum: str) -> DataFrame:
    """doc_id, stratum and COUNTS of each text; null texts count zero of everything."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col(stratum).cast("string").alias("stratum"), "text")
    return narrow.mapInArrow(_count_rows, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: Each rule rejects values above a cutoff of its ladder, the loosest cutoff last.
LADDER = tuple(round(0.01 * 1.33**k, 4) for k in range(16))
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbol_rate": ("n_symbols / word_chars", LADDER),
    "dup_line_rate": ("n_dup_lines / n_lines", LADDER),
    "repeat_word_rate": ("n_repeat_words / n_words", LADDER),
    "capital_rate": ("n_capitals / word_chars", LADDER),
    "mark_rate": ("n_marks / word_chars", LADDER),
}


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def least_good(strata: int, rules: int, risk: float, error: float) -> int:
    """Good documents with which a cutoff that loses none of them is certified, where `rules` share the risk."""
    return math.ceil(math.log(error / (max(1, strata) * rules)) / math.log1p(-risk / rules) - 1e-9)


def tested_strata(sizes: list[int], risk: float, error: float) -> int:
    """How many of the largest strata can be tested, so that each of them could certify a cutoff of one rule."""
    sizes = sorted(sizes, reverse=True)
    return max((k for k, n in enumerate(sizes, 1) if n >= least_good(k, 1, risk, error)), default=0)


def certify(table: list[tuple[str | None, str, int, int, int]], strata: int, risk: float, error: float) -> dict[str | None, dict[str, float]]:
    """Cutoffs per stratum and rule from rows (stratum, rule, cutoffs exceeded, good, bad).

    The false rejections of all rules together stay within `risk` in every
    stratum, with probability 1 - error over all strata. A stratum divides risk
    and error among as many rules as its number of good documents can certify,
    those whose ladder meets most bad documents. A rule's cutoffs are tested in
    sequence from the loosest up to the first that fails, each at the rule's
    whole level: a bad cutoff is certified only if the loosest bad one is.
    """
    by: dict[str | None, dict[str, dict[int, tuple[int, int]]]] = {}
    for stratum, rule, over, good, bad in table:
        by.setdefault(stratum, {}).setdefault(rule, {})[over] = (good, bad)
    out: dict[str | None, dict[str, float]] = {}
    for stratum, found in by.items():
        n = max(sum(good for good, _ in cells.values()) for cells in found.values())
        share = max((m for m in range(1, len(RULES) + 1) if n >= least_good(strata, m, risk, error)), default=0)
        # The choice looks at bad documents only, so the tests on good ones stay valid.
        met = {rule: sum(bad for over, (_, bad) in found.get(rule, {}).items() if over) for rule in RULES}
        for rule in sorted(RULES, key=lambda r: -met[r])[:share]:
            cells, each, level = found.get(rule, {}), risk / share, error / (max(1, strata) * share)
            for k in reversed(range(len(RULES[rule][1]))):
                lost = sum(good for over, (good, _) in cells.items() if over > k)
                caught = sum(bad for over, (_, bad) in cells.items() if over > k)
                if lost > each * n or binomial_tail(lost, n, each) > level:
                    break
                if caught:
                    out.setdefault(stratum, {})[rule] = RULES[rule][1][k]
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, error: float = 0.05) -> DataFrame:
    """COUNTS, base_failed and kept for each row of `docs(doc_id, text, <stratum>)`.

    `labels(doc_id, quality)` is the holdout: quality 1 marks good documents.
    A document is kept unless it fails the base rules or a certified cutoff of
    its stratum. Null texts count as empty and fail the base rules. A null
    stratum is a stratum of its own; null doc_ids are judged but never labelled;
    repeated labels of a doc_id count once, as good if any says so; null
    qualities are left out. Strata with too few labels to certify anything, and
    all of them where labels are empty, have the base rules only. Repeated rows
    are judged each; an empty table gives no rows; extra columns are ignored.
    """
    found = stage(signals(docs, stratum).withColumn("base_failed", base_failed()), "signals")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    usable = found.where("not base_failed").join(known, "doc_id")
    over = lambda rule: F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in RULES[rule][1]]), lambda c: F.expr(RULES[rule][0]) > c)), F.lit(0))
    cells = usable.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), over(r).alias("over")) for r in RULES])))
    good = (F.col("quality") == 1).cast("long")
    cells = cells.groupBy("stratum", "r.rule", "r.over").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    # Only strata that could certify a cutoff come to the driver; the number of good documents alone decides which.
    good_of = usable.groupBy("stratum").agg(F.sum(good).alias("n_good")).where(F.col("n_good") >= least_good(1, 1, risk, error))
    sizes = good_of.withColumnRenamed("stratum", "s")
    near = cells.join(sizes, F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "rule", "over", "good", "bad", "n_good").collect()
    strata = tested_strata(list({r["stratum"]: r["n_good"] for r in near}.values()), risk, error)
    fit = least_good(strata, 1, risk, error)
    cutoffs = certify([tuple(r)[:5] for r in near if r["n_good"] >= fit], strata, risk, error) if strata else {}
    if not cutoffs:
        return found.drop("stratum").withColumn("kept", ~F.col("base_failed"))
    schema = "s string, " + ", ".join(f"cut_{r} double" for r in RULES)
    limits = found.sparkSession.createDataFrame([(s, *(c.get(r) for r in RULES)) for s, c in cutoffs.items()], schema)
    failed = F.lit(False)
    for rule, (rate, _) in RULES.items():
        failed = failed | F.coalesce(F.expr(rate) > F.col(f"cut_{rule}"), F.lit(False))
    out = found.join(limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~failed).alias("kept"))
