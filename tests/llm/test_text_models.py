"""Quality rules, classifier and language model."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import classifier, pitman_yor, rules
from stratalens.llm.hashing import Words, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b\na b\nc", None, "", " \n ", "é# <b> | 50%", "x " * 40, "one two three four five six seven eight " * 3, "A!\n\nA!\nB", "z"]


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_counts():
    got = rules.counts(pa.array(TEXTS))
    assert [tuple(int(got[c][i]) for c in rules.COUNTS[:5]) for i in range(len(TEXTS))] == [brute_counts(t) for t in TEXTS]


def test_binomial_tail():
    for n, p in ((7, 0.2), (12, 0.05)):
        for k in range(n + 1):
            assert rules.binomial_tail(k, n, p) == pytest.approx(min(1, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))))


def test_certify_bounds():
    rate = lambda good: [("en", "symbol_rate", 0, 4000 - good, 10), ("en", "symbol_rate", 16, good, 90)]
    assert rules.certify(rate(0), 1, 0.02, 0.05)["en"]["symbol_rate"] == rules.LADDER[0]
    assert rules.certify(rate(15), 1, 0.02, 0.05) == {}  # 15 of 4000 is too many to certify 0.4 percent
    assert rules.certify([("en", "symbol_rate", 0, 90, 10)], 1, 0.02, 0.05) == {}


def test_moderate_strata_certify():
    """Three hundred good documents certify one rule in each of five strata; the count needed is the one certify() applies."""
    table = [(s, "symbol_rate", over, good, bad) for s in "abcde" for over, good, bad in ((0, 300, 10), (16, 0, 90))]
    got = rules.certify(table, rules.tested_strata([300] * 5, 0.02, 0.05), 0.02, 0.05)
    assert got == {s: {"symbol_rate": rules.LADDER[0]} for s in "abcde"}
    for n in (rules.least_good(5, 1, 0.02, 0.05) - 1, rules.least_good(5, 1, 0.02, 0.05)):
        assert bool(rules.certify([("a", "symbol_rate", 0, n, 0), ("a", "symbol_rate", 16, 0, 9)], 5, 0.02, 0.05)) == (n == rules.least_good(5, 1, 0.02, 0.05))
    assert rules.tested_strata([2076, 507, 400, 321, 150, 20], 0.02, 0.05) == 4


def test_judge(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, labels)
    assert got.count() == len(corpus)
    for r in got.where("doc_id in (60, 61, 70)").collect():
        assert r["kept"] == (r["doc_id"] == 70)
    assert rules.judge(empty, labels).count() == 0 and rules.judge(docs, labels.limit(0)).count() == len(corpus)


def test_judge_rejects_when_certified(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en") for i in range(4000)]
    bad = [(4000 + i, " ".join(f"w{i}#$%{j}" for j in range(30)), "en") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 4000)) for i in range(4050)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(df, labels).collect()}
    assert all(got[i] for i in range(4000)) and not any(got[i] for i in range(4000, 4050))


def test_classifier(spark, docs, corpus, empty):
    good = [(i, f"plain words come here number {i} and go on", 1) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! {i} BUY!!", 0) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in good + bad] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    held = classifier.held_out(labels["doc_id"])
    weights = classifier.train(df, labels.where(~held))
    scores = {r["doc_id"]: r["score"] for r in classifier.score(df, weights).collect()}
    out = {d for d, *_ in good + bad if zlib.crc32(str(d).encode()) % 4 == 2}
    assert out and all((scores[d] > 0.5) == bool(q) for d, _, q in good + bad if d in out)
    assert classifier.score(docs, weights).count() == len(corpus) and classifier.score(empty, weights).count() == 0
    kept = classifier.keep(docs, weights, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(corpus)
    assert not classifier.train(df, labels.limit(0)).any()
    again = classifier.train(df, labels.where(~held))
    assert np.array_equal(weights, again)


def test_language_model(spark, docs, corpus, empty):
    model = pitman_yor.train(docs)
    got = pitman_yor.score(model, docs).collect()
    tokens = [[*(w.lower() for w in WORD.findall(t or "")), None] for _, t, *_ in corpus]
    counts = collections.Counter(x for t in tokens for x in t)
    n, v = sum(counts.values()), len(counts)
    assert model.train_tokens == n and model.now.vocabulary == v
    want = sorted((str(d), len(t), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t)) for (d, *_), t in zip(corpus, tokens))
    for (d, k, base), r in zip(want, sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"])), strict=True):
        assert (d, k) == (str(r["doc_id"]), r["n_tokens"]) and r["base_score"] == pytest.approx(base) and r["n_known"] == k
    assert pitman_yor.score(model, empty).count() == 0
    nothing = pitman_yor.train(empty)
    assert pitman_yor.perplexity(pitman_yor.score(nothing, docs)) == pytest.approx(1.0)


def test_language_model_is_a_distribution(spark):
    """The first token's probabilities over all training words, the unknown word and the end sum to one."""
    train = spark.createDataFrame([(i, "a b a c a b") for i in range(5)], "doc_id long, text string")
    model = pitman_yor.train(train)
    probe = ["", *"abc", "new"]
    ends = {w: f"{w} {x}".strip() for w in probe for x in [""]}
    texts = [*ends.values(), "a a", "b a", "c a", "new a"]
    rows = {t: 10 ** r["score"] for t, r in zip(texts, pitman_yor.score(model, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect(), strict=True)}
    assert rows["a"] > rows["new"] and sum(rows[w] for w in probe) < 1
    # p(w, every next token) must add up to p(w) <= 1: all two-token texts from "a".
    nexts = ["a", "a a", "a b", "a c", "a new"]
    two = pitman_yor.score(model, spark.createDataFrame(list(enumerate(nexts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all(r["score"] < 0 for r in two)


def test_contexts_do_not_share_restaurants(spark):
    """Two words whose hashes agree in 16 bits are contexts of their own."""
    names = [f"w{i}" for i in range(3000)]
    short, seen = (mix(Words(pa.array(names)).hashes(0, True)) >> np.uint64(48)).tolist(), {}
    x, y = next((names[seen[h]], names[i]) for i, h in enumerate(short) if h in seen or seen.setdefault(h, i) is None)
    model = pitman_yor.train(spark.createDataFrame([(i, f"{x} a" if i % 2 else f"{y} b") for i in range(400)], "doc_id long, text string"))
    right, wrong = (r["score"] for r in pitman_yor.score(model, spark.createDataFrame([(0, f"{x} a"), (1, f"{x} b")], "doc_id long, text string")).orderBy("doc_id").collect())
    assert right - wrong > 1


def test_draw_tables():
    rng = np.random.default_rng(0)
    stirling = pitman_yor._stirling(0.5)
    customers = np.array([1, 2, 5, 64, 500, 3000])
    many = [pitman_yor.draw_tables(customers, np.full(6, 0.1), np.full(6, 10.0), 0.5, 1.0, rng, stirling) for _ in range(800)]
    t = np.array(many)
    assert (t[:, 0] == 1).all() and (t >= 1).all() and (t <= customers).all()
    # Near the bound both ways of drawing agree: 1 + r * base / (1 - base) tables, r = strength / discount + others + 1.
    assert abs(t[:, 3].mean() - t[:, 4].mean()) < 0.25 and abs(t[:, 4].mean() - (1 + 13 * 0.1 / 0.9)) < 0.25
    # Exact conditional for two customers against its closed form.
    p2 = np.mean([pitman_yor.draw_tables(np.array([2]), np.array([0.1]), np.array([10.0]), 0.5, 1.0, rng, stirling)[0] == 2 for _ in range(4000)])
    w1, w2 = (1 - 0.5) * (1 + 5) * 0.1, (1 + 5) * (1 + 5.5) * 0.01
    assert abs(p2 - w2 / (w1 + w2)) < 0.03
