"""Draws of the language model's seating against exact conditionals and a sampler that moves one customer at a time."""

import math

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import blobs, pitman_yor, seating


def exact(c, weight):
    """Mean and deviation of the tables of c customers, t of them weighing S(c, t) * exp(weight(t))."""
    discount, log_weight = weight
    s = np.full((c + 1, c + 1), -np.inf)
    s[1, 1] = 0
    for k in range(1, c):
        t = np.arange(1, k + 2)
        with np.errstate(divide="ignore"):
            stay = s[k, 1 : k + 2] + np.log(np.maximum(k - discount * t, 0))
        s[k + 1, 1 : k + 2] = np.logaddexp(s[k, : k + 1], stay)
    t = np.arange(1, c + 1)
    p = s[c, 1:] + log_weight(t)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = (p * t).sum()
    return mean, math.sqrt(max((p * t * t).sum() - mean * mean, 1e-12))


@pytest.mark.parametrize("discount", [0.3, 0.6, 0.9])
@pytest.mark.parametrize("customers", [2, 40, seating.LISTED, seating.LISTED + 1, 600])
@pytest.mark.parametrize("rate", [0.05, 1.0, 20.0])
def test_tables(discount, customers, rate):
    """No step at the listed sizes: both ways of drawing have the exact conditional's mean and deviation."""
    rng, n = np.random.default_rng(5), 1500
    got = seating.tables_at(np.full(n, customers), np.full(n, rate), discount, rng, seating.stirling(discount))
    mean, sd = exact(customers, (discount, lambda t: t * math.log(discount * rate)))
    assert got.min() >= 1 and got.max() <= customers
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(n) + 0.005 * mean and abs(got.std() - sd) < 0.1 * sd + 0.02


@pytest.mark.parametrize("customers", [30, 400])
def test_tables_of_a_crowded_restaurant(customers):
    """Other tables many, strength integrated out: the case in which a limit for few tables fails."""
    rng, n, discount, strength, base, others = np.random.default_rng(6), 1500, 0.6, 1.0, 0.02, 2000
    got = seating.draw_tables(np.full(n, customers), np.full(n, base), np.full(n, others), discount, strength, rng, seating.stirling(discount))
    rising = lambda t: np.array([sum(math.log(strength + discount * (others + i)) for i in range(k)) for k in t])
    mean, sd = exact(customers, (discount, lambda t: rising(t) + t * math.log(base)))
    assert abs(got.mean() - mean) < 5 * sd / math.sqrt(n) + 0.005 * mean


def test_rest_masses():
    """Mean and variance of tempered stable masses."""
    rng = np.random.default_rng(1)
    for shape in (0.2, 1.0, 3.5):
        x = seating.rest_masses(100_000, shape, 0.6, rng)
        assert x.mean() == pytest.approx(shape * 0.6, rel=0.02) and x.var() == pytest.approx(shape * 0.6 * 0.4, rel=0.06)


def seated_one_by_one(pairs, vocabulary, discount, strength, sweeps, rng):
    """Mean tables per (context, word): customers leave and sit down again one at a time, in a context and then in the parent."""
    tables = {p: [] for p in pairs}  # sizes; each table is a customer of the parent
    parent = {w: [] for _, w in pairs}
    home = {p: [] for p in pairs}  # the parent table of each table

    def parent_weight(w):
        total, many = sum(sum(x) for x in parent.values()), sum(len(x) for x in parent.values())
        return (sum(parent[w]) - discount[1] * len(parent[w]) + (strength[1] + discount[1] * many) / (vocabulary + 1)) / (strength[1] + total)

    def send(w):
        many = sum(len(x) for x in parent.values())
        weight = [x - discount[1] for x in parent[w]] + [(strength[1] + discount[1] * many) / (vocabulary + 1)]
        k = rng.choice(len(weight), p=np.array(weight) / sum(weight))
        if k == len(parent[w]):
            parent[w].append(0)
        parent[w][k] += 1
        return k

    def leave(w, k):
        parent[w][k] -= 1
        if not parent[w][k]:
            del parent[w][k]
            for p in pairs:
                if p[1] == w:
                    home[p] = [h - (h > k) for h in home[p]]

    def sit(p):
        u, w = p
        many = sum(len(tables[q]) for q in pairs if q[0] == u)
        weight = [x - discount[0] for x in tables[p]] + [(strength[0] + discount[0] * many) * parent_weight(w)]
        k = rng.choice(len(weight), p=np.array(weight) / sum(weight))
        if k == len(tables[p]):
            tables[p].append(0)
            home[p].append(send(w))
        tables[p][k] += 1

    for p, c in pairs.items():
        for _ in range(c):
            sit(p)
    total = dict.fromkeys(pairs, 0)
    for sweep in range(sweeps):
        for p, c in pairs.items():
            for _ in range(c):
                k = rng.choice(len(tables[p]), p=np.array(tables[p]) / sum(tables[p]))
                tables[p][k] -= 1
                if not tables[p][k]:
                    del tables[p][k]
                    leave(p[1], home[p].pop(k))
                sit(p)
            # The parent's own customers, too, move from table to table.
            for j in range(len(home[p])):
                k = home[p][j]
                home[p][j] = -1
                leave(p[1], k)
                home[p][j] = send(p[1])
        if sweep >= sweeps // 10:
            for p in pairs:
                total[p] += len(tables[p])
    return {p: x / (sweeps - sweeps // 10) for p, x in total.items()}


def test_blocks_sample_the_same_seating():
    """Mean tables of the blocked sampler, run as Spark runs it but for the shuffles, against one customer at a time."""
    pairs = {(0, 10): 6, (0, 11): 3, (1, 10): 5, (1, 12): 1, (2, 11): 4, (2, 12): 2, (3, 10): 1}
    discount, strength, vocabulary = (0.6, 0.4), (1.0, 1.0), 3
    rng = np.random.default_rng(2)
    want = seated_one_by_one(pairs, vocabulary, discount, strength, 1200, rng)
    words, contexts = np.array([10, 11, 12], np.uint64), np.arange(4, dtype=np.uint64)
    order = sorted(pairs, key=lambda p: (p[1], p[0]))
    per = np.array([sum(p[1] == w for p in order) for w in (10, 11, 12)], np.uint32)
    counts = [words, per, contexts, np.array([p[0] for p in order], np.uint8), np.array([pairs[p] for p in order], np.uint8)]
    state = pitman_yor._told(0, counts, np.ones(len(order), np.int64), per.astype(np.int64), np.ones(3, np.int64), np.zeros(len(order), np.int64), 1)
    total, sweeps = np.zeros(len(order)), 3000
    for sweep in range(sweeps + 100):
        now = pitman_yor._Totals(state["customers"][0], state["tables"][0], sum(pairs.values()), vocabulary)
        rest, own = (rng.gamma(strength[1] / discount[1] + now.parent_tables) for _ in range(2))
        told = pa.table({"bucket": pa.array([0], pa.int32()), "pid": pa.array([0], pa.int32()), "kind": pa.array([pitman_yor._TOLD], pa.int32()), "blob": pa.array([state["blob"][1]], pa.binary())})
        rooms = pitman_yor._added(discount[0], strength[0], sweep)(told).to_pylist()
        customers, parent = pitman_yor.unpack(state["parents"][0])
        mass = pitman_yor._masses(0, customers, parent, rest, vocabulary, discount[1], sweep).sum() + seating.rest_masses(1, rest / (vocabulary + 1), discount[1], rng)[0]
        held = [
            {"bucket": 0, "pid": 0, "kind": pitman_yor._COUNTS, "blob": pitman_yor.pack(*counts), "parents": None},
            {"bucket": 0, "pid": 0, "kind": pitman_yor._SEATS, "blob": state["blob"][0], "parents": state["parents"][0]},
            *({**r, "parents": None} for r in rooms if r["kind"] == pitman_yor._ROOMS),
        ]
        table = pa.Table.from_pylist(held, schema=pa.schema([(k, pitman_yor._STATE[k]) for k in ("bucket", "pid", "kind", "blob", "parents")]))
        out = pitman_yor._sweeper(now, discount, strength, rest, mass, own, sweep, False, 1)(table)
        state = {c: out[c].to_pylist() for c in out.column_names}
        if sweep >= 100:
            total += pitman_yor.unpack(state["blob"][0])[0]
    for p, mean in zip(order, total / sweeps, strict=True):
        assert abs(mean - want[p]) < 0.12 + 0.04 * want[p], (p, mean, want[p])


def test_pairs_number_words_and_contexts_by_one_sort(monkeypatch):
    """As by sorting both, with no text, and with words that hash like a text's start or end."""
    for clash in (None, "_END", "_START"):
        with monkeypatch.context() as m:
            if clash:
                m.setattr(pitman_yor, clash, pitman_yor.hashed(pa.chunked_array([["b"]]), lower=True)[0][0])
            for texts in ([], ["", None, " "], ["a b a", None, "B c", "c a b a b"]):
                col = pa.chunked_array([pa.array(texts, pa.string())])
                token, context, n = pitman_yor._tokens(col)
                words, contexts, pair, sizes, which = pitman_yor._pairs(col, "which")
                assert words.tolist() == np.unique(token).tolist() and contexts.tolist() == np.unique(context).tolist() and sizes.tolist() == n.tolist()
                assert words[(pair >> 32)[which]].tolist() == token.tolist() and contexts[(pair & pitman_yor._LOW)[which]].tolist() == context.tolist()
                assert pitman_yor._pairs(col)[2].tolist() == pair.tolist()
                assert pitman_yor._pairs(col, "many")[4].tolist() == np.bincount(which, minlength=len(pair)).tolist()


def test_contexts_are_named_once():
    """After the first sweep a bucket tells tables alone, in the order of the names, and the index turns them into the same variates."""
    rng = np.random.default_rng(3)
    contexts = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2))
    place = np.concatenate([np.arange(len(contexts)), rng.integers(0, len(contexts), 20)])
    per = np.array([len(contexts), 20], np.uint32)
    counts = [np.array([5, 9], np.uint64), per, contexts, place.astype(np.uint8), rng.integers(1, 9, len(place))]
    tables = np.minimum(counts[4], 3)
    rest = (tables, per.astype(np.int64), np.ones(2, np.int64), np.zeros(len(place), np.int64))
    named, plain = pitman_yor._told(0, counts, *rest, 3), pitman_yor._retold(0, pitman_yor._shape(counts, 3), *rest)
    assert {k: v for k, v in named.items() if k != "blob"} == {k: v for k, v in plain.items() if k != "blob"}
    for home in range(3):
        row = lambda state, home=home: [{k: state[k][i] for k in pitman_yor._ROWS} for i, b in enumerate(state["bucket"]) if i and b == home]
        schema = pa.schema(list(pitman_yor._ROWS.items()))
        first = pitman_yor._added(0.5, 1.0, 7)(pa.Table.from_pylist(row(named), schema=schema)).to_pylist()
        index = [r for r in first if r["kind"] == pitman_yor._INDEX]
        again = pitman_yor._added(0.5, 1.0, 7)(pa.Table.from_pylist(row(plain) + index, schema=schema)).to_pylist()
        assert again == [r for r in first if r["kind"] != pitman_yor._INDEX]
        assert len(row(plain)[0]["blob"]) < len(row(named)[0]["blob"]) / 2


def test_blocks_of_repeated_pairs_sample_the_same_seating():
    """Sweeps as training runs them, over pairs seen more than once: mean tables against one customer at a time, with words that have no such pair."""
    pairs = {(0, 10): 6, (0, 11): 3, (1, 10): 1, (1, 12): 1, (2, 11): 4, (2, 12): 1, (3, 10): 1, (3, 13): 1, (3, 11): 1}
    discount, strength, vocabulary = (0.6, 0.4), (1.0, 1.0), 4
    rng = np.random.default_rng(4)
    want = seated_one_by_one(pairs, vocabulary, discount, strength, 1200, rng)
    order = sorted(pairs, key=lambda p: (p[1], p[0]))
    per = np.array([sum(p[1] == w for p in order) for w in (10, 11, 12, 13)], np.uint32)
    counts = [np.arange(10, 14, dtype=np.uint64), per, np.arange(4, dtype=np.uint64), np.array([p[0] for p in order], np.uint8), np.array([pairs[p] for p in order], np.uint8)]
    schema = pa.schema([(k, pitman_yor._STATE[k]) for k in ("bucket", "pid", "kind", "blob", "parents")])
    line = lambda s, k: {c: s[c][s["kind"].index(k)] for c in schema.names}
    state = pitman_yor._opened(0, counts, 1)
    shape, index, sweeps = line(state, pitman_yor._SHAPE), [], 3000
    assert pitman_yor.unpack(shape["blob"])[-1].tolist() == [1, sum(pairs.values()), 4, 6, 0, 1, 1]
    repeated = [p for p in order if pairs[p] > 1]
    total = np.zeros(len(repeated))
    for sweep in range(sweeps + 100):
        at = state["kind"].index(pitman_yor._SEATS)
        now = pitman_yor._Totals(state["customers"][at], state["tables"][at], sum(pairs.values()), vocabulary)
        rest, own = (rng.gamma(strength[1] / discount[1] + now.parent_tables) for _ in range(2))
        told = pa.Table.from_pylist([line(state, pitman_yor._TOLD), *index], schema=pa.schema(list(pitman_yor._ROWS.items())))
        rooms = pitman_yor._added(discount[0], strength[0], sweep)(told).to_pylist()
        index = index or [r for r in rooms if r["kind"] == pitman_yor._INDEX and r["pid"] == pitman_yor._SPOTS]
        seats = line(state, pitman_yor._SEATS)
        mass, many, seated, words = pitman_yor._weigher(rest, vocabulary, discount[1], sweep)(0, pitman_yor.unpack(seats["parents"]))
        mass += rng.gamma(now.tables - many - discount[1] * (now.parent_tables - seated)) + seating.rest_mass((vocabulary + 1 - words) * rest / (vocabulary + 1), discount[1], rng)
        held = [shape, seats, *({**r, "parents": None} for r in rooms if r["kind"] == pitman_yor._ROOMS)]
        out = pitman_yor._sweeper(now, discount, strength, rest, mass, own, sweep, False, 1)(pa.Table.from_pylist(held, schema=schema))
        state = {c: out[c].to_pylist() for c in out.column_names}
        if sweep >= 100:
            total += pitman_yor.unpack(line(state, pitman_yor._SEATS)["blob"])[0]
    for p, mean in zip(repeated, total / sweeps, strict=True):
        assert abs(mean - want[p]) < 0.12 + 0.04 * want[p], (p, mean, want[p])


def test_sweeps_carry_repeated_pairs_alone():
    """Of 50,000 pairs a hundred are repeated: sweeps carry those, yet every context has its tables, and its variate is that of all pairs told."""
    rng = np.random.default_rng(6)
    pair = np.unique(rng.integers(0, 400, 60_000) << 32 | rng.integers(0, 3_000, 60_000))[:50_000]
    per = np.bincount(pair >> 32).astype(np.uint32)
    contexts = np.unique(rng.integers(0, 2**63, 3_100).astype(np.uint64) * np.uint64(2))[:3_000]
    many = np.ones(len(pair), np.uint8)
    many[rng.choice(len(pair), 100, replace=False)] = 5
    table = pa.table({"bucket": pa.array([7], pa.int32()), "blob": [pitman_yor.pack(np.arange(len(per), dtype=np.uint64), per, contexts, (pair & pitman_yor._LOW).astype(np.uint16), many)]})
    out = pitman_yor._merged(2)(table).to_pylist()
    size = lambda kind: sum(len(r["blob"]) + len(r["parents"] or b"") for r in out if r["kind"] == kind)
    assert size(pitman_yor._SHAPE) + size(pitman_yor._SEATS) < 0.1 * size(pitman_yor._NAMES)

    counts = pitman_yor.unpack(next(r["blob"] for r in out if r["kind"] == pitman_yor._NAMES))
    dense = pitman_yor._told(7, counts, np.ones(len(pair), np.int64), per.astype(np.int64), np.ones(len(per), np.int64), np.zeros(len(pair), np.int64), 2)
    schema, add = pa.schema(list(pitman_yor._ROWS.items())), pitman_yor._added(0.5, 1.0, 3)
    for home in range(2):
        told = [{k: r[k] for k in schema.names} for r in out if r["kind"] == pitman_yor._TOLD and r["bucket"] == home]
        every = [{k: dense[k][i] for k in schema.names} for i, kind in enumerate(dense["kind"]) if kind == pitman_yor._TOLD and dense["bucket"][i] == home]
        few, full = (add(pa.Table.from_pylist(x, schema=schema)).to_pylist() for x in (told, every))
        blob = lambda rows, kind: pitman_yor.unpack(next(r["blob"] for r in rows if r["kind"] == kind))
        assert blob(few, pitman_yor._HOME)[0].tolist() == blob(full, pitman_yor._HOME)[0].tolist()
        where = pitman_yor.unpack(told[0]["blob"])[3]
        assert 0 < len(where) < 100 and blob(few, pitman_yor._ROOMS)[0].tolist() == blob(full, pitman_yor._ROOMS)[0][where].tolist()
        # A later sweep in which no bucket of words has a repeated pair here.
        index = [{**r, "blob": pitman_yor.pack(pitman_yor.unpack(r["blob"])[0], np.zeros(0, np.uint8))} for r in few if r["pid"] == pitman_yor._SPOTS]
        alone = add(pa.Table.from_pylist(index, schema=schema)).to_pylist()
        assert [r["kind"] for r in alone] == [pitman_yor._HOME] and len(blob(alone, pitman_yor._HOME)[0]) == len(blob(full, pitman_yor._HOME)[0])


def test_mass_of_many_dishes_is_one_draw():
    """Against the sum over dishes, and at 10**9 by mean and variance."""
    rng = np.random.default_rng(8)
    for discount, shape in ((0.3, 0.4), (0.5, 6.0), (0.72, 30.0), (0.9, 1.5)):
        one = np.sort([seating.rest_mass(shape, discount, rng) for _ in range(4000)])
        other = np.sort(seating.rest_masses(20 * 4000, shape / 20, discount, rng).reshape(-1, 20).sum(axis=1))
        both = np.concatenate([one, other])
        gap = np.abs(np.searchsorted(one, both, "right") - np.searchsorted(other, both, "right")).max() / 4000
        assert gap < 1.95 * np.sqrt(2 / 4000), (discount, shape, gap)
    draws = np.array([seating.rest_mass(1e9, 0.7, rng) for _ in range(4000)])
    assert abs(draws.mean() - 0.7e9) < 4.5 * np.sqrt(0.21e9 / 4000) and draws.var() == pytest.approx(0.21e9, rel=0.12)
    assert seating.rest_mass(0.0, 0.5, rng) == 0


def test_numbers_by_one_sort_are_those_of_unique():
    """With no value, with values whose upper bits agree, and with pairs too wide to be sorted as one number."""
    rng = np.random.default_rng(9)
    close = (np.uint64(1) << np.uint64(60)) + rng.integers(0, 40, 500).astype(np.uint64)
    for hashes in (np.zeros(0, np.uint64), np.array([2**64 - 1], np.uint64), close, rng.choice(rng.integers(0, 2**63, 90).astype(np.uint64) * np.uint64(2), 700)):
        for got, want in zip(blobs.numbered(hashes), np.unique(hashes, return_inverse=True), strict=True):
            assert got.tolist() == want.tolist()
    for top in (5, 2**31 - 1):
        high, low = rng.integers(0, top, 800), rng.integers(0, top + 1, 800)
        high[:2], low[:2] = top, top
        at, pair = blobs.ordered(high, low)
        assert pair.tolist() == sorted((high << 32 | low).tolist()) and (high << 32 | low)[at].tolist() == pair.tolist()
    part, value = rng.integers(0, 6, 300) // 2 * 2, rng.integers(0, 50, 300)
    own, bounds, code = blobs.numbered_within(part, value, 7)
    for k in range(7):
        assert own[bounds[k] : bounds[k + 1]].tolist() == np.unique(value[part == k]).tolist()
    assert own[bounds[part] + code].tolist() == value.tolist()
