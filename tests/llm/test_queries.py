"""The registered queries on small tables, against plain versions of what they return."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest
from test_dedup import brute_components, brute_removed, shingles, words

import __spark_entry__
import corpus_pipeline
from stratalens.llm import classifier, mixing, packing, rules, storage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    """The corpus, and good and bad documents of two languages with labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    made = [(1000 + i, " ".join(f"word{(7 * i + j * j) % 83} item{i}x{j}" for j in range(12)), "en" if i % 4 else "fr", f"s{i % 5}", 0) for i in range(700)]
    junk = [(3000 + i, " ".join(f"BUY#{i}$ now%{j}" for j in range(14)), "en", "s1", 0) for i in range(80)]
    rows = [r for r in corpus if r[0] is not None] + made + junk
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, 0) for r in made] + [(r[0], 0, 0) for r in junk] + [(1000, 0, 0), (5, None, 0), (99999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def result(spark, folder, name):
    return __spark_entry__.queries()[name](spark, folder[0]).collect()


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    marks = sum(c in "#*$%&|<>" for c in text or "")
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": marks, "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover),
        "n_lines": len(lines), "n_capitals": sum("A" <= c <= "Z" for c in text or ""), "n_marks": (text or "").count("!"),
    }


def test_op1(spark, folder):
    """Verdicts of cutoffs certified from labelled good documents of each language, recounted here."""
    _, rows, labels = folder
    found = {r[0]: (r[2], base_counts(r[1])) for r in rows}
    failed = {d: c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"] for d, (_, c) in found.items()}
    quality = {}
    for d, q, _ in labels:
        if q is not None and d in found:
            quality[d] = max(q, quality.get(d, 0))
    rate = {name: tuple(part.strip() for part in text.split("/")) for name, (text, _) in rules.RULES.items()}
    value = lambda c, name: c[rate[name][0]] / c[rate[name][1]] if c[rate[name][1]] else None
    good = collections.Counter(found[d][0] for d, q in quality.items() if q and not failed[d])
    strata = rules.tested_strata(list(good.values()), 0.02, 0.05)
    cells = collections.Counter()
    for d, q in quality.items():
        lang, c = found[d]
        if not failed[d] and good[lang] >= rules.least_good(strata, 1, 0.02, 0.05):
            for name, (_, ladder) in rules.RULES.items():
                v = value(c, name)
                cells[lang, name, sum(v is not None and v > cut for cut in ladder), q] += 1
    table = [(*key, cells[*key, 1], cells[*key, 0]) for key in {k[:3] for k in cells}]
    cutoffs = rules.certify(table, strata, 0.02, 0.05)
    assert strata and cutoffs
    got = result(spark, folder, "op1_rules")
    assert len(got) == len(rows)
    rejected = 0
    for r in got:
        lang, c = found[r["doc_id"]]
        assert [r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == list(c.values())[:5]
        over = any((value(c, name) or 0) > cut for name, cut in cutoffs.get(lang, {}).items())
        assert r["base_failed"] == failed[r["doc_id"]] and r["kept"] == (not failed[r["doc_id"]] and not over)
        rejected += not failed[r["doc_id"]] and not r["kept"]
    assert rejected >= 80


def test_certified_risk_holds():
    """Over many draws of labels, cutoffs that lose more than the risk are certified in no more than the error's share."""
    import random

    rng, bad, trials, n, risk = random.Random(3), 0, 300, 400, 0.02
    for _ in range(trials):
        cells = collections.Counter()
        for _ in range(n):
            # A good document exceeds k + 1 cutoffs of the first rule with a chance of 0.3 / (k + 2).
            u = rng.random()
            cells[sum(u < 0.3 / (k + 2) for k in range(16))] += 1
        table = [("en", "symbol_rate", k, cells[k], 5) for k in range(17)]
        cut = rules.certify(table, 1, risk, 0.05).get("en", {}).get("symbol_rate")
        if cut is not None:
            bad += 0.3 / (rules.LADDER.index(cut) + 2) > risk
    assert bad <= trials * 0.05 + 3 * math.sqrt(trials * 0.05)


def test_op2(spark, folder):
    """Labels of the held-out fold are not learnt from, and are told well."""
    _, rows, labels = folder
    got = {r["doc_id"]: r for r in result(spark, folder, "op2_classifier")}
    assert set(got) == {r[0] for r in rows}
    quality = {d: q for d, q, _ in labels if d in got and d >= 1001}
    held = [d for d in quality if crc(d) % 4 == 2]
    assert all(r["held_out"] == (crc(d) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    assert sum(got[d]["predicted"] == quality[d] for d in held) >= 0.97 * len(held)
    flipped = spark.read.parquet(f"{folder[0]}/labels.parquet")
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    out = classifier.held_out(flipped["doc_id"])
    assert (classifier.train(docs, flipped.where(~out)) == classifier.train(docs, flipped.where(~out).union(flipped.where("doc_id = 99999")))).all()


def test_words_of_the_classifier():
    """Punctuation runs are words, a repeated word is a ditto mark, and texts don't touch."""
    import pyarrow as pa

    texts = ["to%%% the", "to %%% the", "was was was", "was", None, "", "was"]
    h, first = classifier._words(pa.array(texts))
    own = [h[a:b].tolist() for a, b in itertools.pairwise(first)]
    assert own[0] == own[1] and [len(x) for x in own] == [3, 3, 3, 1, 0, 0, 1]
    assert own[2][0] == own[3][0] == own[6][0] and own[2][1] == own[2][2] == int(classifier._DITTO)


def test_op5_and_op7(spark, folder):
    _, rows, _ = folder
    small = [r for r in rows if r[0] < 1200]  # brute force over all pairs
    path = folder[0] + "-small"
    spark.createDataFrame(small, DOCS).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    got = result(spark, (path,), "op5_jaccard")
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(small, 3, 90)
    got = result(spark, (path,), "op7_substrings")
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_removed(small, 50)


def test_packing_reaches_the_bound():
    """Sequences against an exact optimum on small cases, and the dual bound and the share of the program on larger ones."""
    import random

    def fits(pieces, bins):
        """Whether the pieces go into bins of 12, trying all places."""
        if not pieces:
            return True
        tried = set()
        for i, room in enumerate(bins):
            if room >= pieces[0] and room not in tried:
                tried.add(room)
                if fits(pieces[1:], [*bins[:i], room - pieces[0], *bins[i + 1 :]]):
                    return True
        return False

    rng = random.Random(9)
    for _ in range(12):
        pieces = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        best = next(k for k in range(1, 10) if fits(pieces, [12] * k))
        plan = packing.planned(dict(collections.Counter(pieces)), 12)
        assert sum(plan.uses.values()) == best and plan.bound <= best + 1e-9
    histogram = dict(collections.Counter(min(256, max(1, int(rng.lognormvariate(4, 0.8)))) for _ in range(5000)))
    plan = packing.planned(histogram, 256)
    assert sum(plan.uses.values()) <= math.ceil(1.005 * plan.bound) and plan.rounded >= 0.95 * plan.pieces
    # The bound is that of any dual: no worse than the volume, and never above what was reached.
    assert sum(n * m for n, m in histogram.items()) / 256 <= plan.bound + 1e-6 <= sum(plan.uses.values()) + 1e-6


def test_pipeline_against_plain_stages(spark, folder):
    """Filter, near copies and passages by plain code; then the mix packs just what it took."""
    path, rows, _ = folder
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    weights = classifier.train(docs, labels.where(~classifier.held_out(labels["doc_id"])))
    scores = {r["doc_id"]: r["score"] for r in classifier.score(docs, weights).collect()}
    kept = [r for r in rows if scores[r[0]] >= 0.7]
    # Small sets first, so that pairs of a kind are found by their shared shingles.
    sets = {r[0]: shingles(r[1], 5) for r in kept}
    having = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    label = {d: d for d in sets}
    near = {(a, b) for ds in having.values() for a, b in itertools.combinations(sorted(ds), 2)}
    changed = True
    links = [(a, b) for a, b in near if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    kept = [r for r in kept if label[r[0]] == r[0]]
    removed = {d: (n, k) for d, _, n, k in brute_removed(kept, 50)}
    now = docs
    for name, function in corpus_pipeline.STAGES[:3]:
        now = storage.stage(function(spark, now, path), name)
    got = now.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in kept)
    for r in got:
        n, digest = removed[str(r["doc_id"])]
        joined = " ".join(words(r["text"]))
        assert hashlib.sha256(joined.encode()).hexdigest() == digest and (n == 0) == (r["text"] == next(x[1] for x in rows if x[0] == r["doc_id"]))
        assert r["n_chars"] == len(r["text"] or "")
    taken = sum(r["taken"] for r in mixing.mix(now).collect())
    mixed = corpus_pipeline.STAGES[3][1](spark, now, path).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed) == taken
