"""Hashes, words and what is confirmed beyond a first hash."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import blobs, hashing, packing, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def hashes(texts, kind=0, lower=False):
    return hashing.Words(pa.array(texts)).hashes(kind, lower).tolist()


@pytest.mark.parametrize("kind", [0, 1])
def test_patterned_words_differ(kind):
    """Sequences and their complements that collide under polynomials modulo a power of two."""
    words = [thue_morse(n, *pair) for n in (64, 128, 129, 512, 1024, 4096) for pair in (("a", "b"), ("b", "a"))]
    words += ["".join(x) for x in itertools.product("ab", repeat=6)] + ["a" * n for n in range(1, 300)]
    words = list(dict.fromkeys(words))
    assert len(set(hashes(words, kind))) == len(words)
    assert not set(hashes(words, 0)) & set(hashes(words, 1))


def test_words_are_those_of_the_pattern():
    """Equal words, and only they, share a hash, wherever they stand; bytes beyond a word don't matter."""
    texts = ["one two  three", "two", None, "", "\tTWO\n two\x0b", "x" * 127 + " " + "x" * 128 + " " + "x" * 129, "é\xa0é é"]
    want = [w for t in texts for w in WORD.findall(t or "")]
    w = hashing.Words(pa.array(texts))
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    got = w.hashes().tolist()
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(want)) for j in range(len(want)))
    low = w.hashes(0, True).tolist()
    assert low[want.index("TWO")] == got[want.index("two")]
    sliced = hashing.Words(pa.array(texts).slice(1, 4)).hashes().tolist()
    assert sliced == hashes(texts[1:5])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 8, 25, 50])
def test_windows(size):
    """Windows share a hash if and only if their words agree in order."""
    rng = np.random.default_rng(size)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    h = hashing.windows(hashing.mix(words), size)
    assert len(h) == 401 - size
    by = {}
    for i, x in enumerate(h.tolist()):
        by.setdefault(tuple(words[i : i + size]), set()).add(x)
    assert all(len(x) == 1 for x in by.values()) and len({min(x) for x in by.values()}) == len(by)
    assert len(hashing.windows(words[: size - 1], size)) == 0
    pattern = hashing.mix(np.array([bin(i).count("1") % 2 for i in range(64)], np.uint64))
    other = hashing.mix(np.array([1 - bin(i).count("1") % 2 for i in range(64)], np.uint64))
    if size <= 50:
        assert hashing.windows(pattern, 50)[0] != hashing.windows(other, 50)[0]


def test_arrays_pack():
    arrays = [np.arange(n, dtype=k) for n, k in ((0, np.uint8), (3, np.uint16), (2, np.uint64), (5, np.int64), (1, np.float32), (4, np.float64))]
    back = blobs.unpack(blobs.pack(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, back, strict=True))
    assert [blobs.narrow(np.array([0]), n).dtype.itemsize for n in (256, 257, 65536, 65537)] == [1, 2, 2, 4]


def test_groups_follow_bytes():
    """More partitions give no more groups, and messages, a row for each group and bucket, stay in proportion to the input."""
    from stratalens.llm.storage import groups_of

    for size in (10**8, 10**9, 10**12, 10**14):
        n = groups_of(size, 200)
        assert n * n <= max(40_000, size / 4096 * 1.01 + 2 * n) and size / n <= max(4e6, 1.01 * (size * 4096) ** 0.5)
    assert groups_of(10**12, 200) == groups_of(10**12, 5000)
    assert groups_of(0, 200) == 1


def test_passages_that_share_a_first_hash(monkeypatch):
    """Windows whose first hash clashes are told apart by the second."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)]
    docs = pa.table({"doc_id": pa.array([0, 1, 2], pa.int64()), "text": pa.array([texts[0], texts[1], texts[0]]), "pid": pa.array([0, 0, 0], pa.int32())})
    real = substrings._rolling

    def clashing(texts_, size, kind):
        h, at, owner, first = real(texts_, size, kind)
        return h % np.uint64(7) if size == 50 else h, at, owner, first

    monkeypatch.setattr(substrings, "_rolling", clashing)
    probes = substrings._probes(25, 1)(docs)
    hits = substrings._hits(probes)
    found = substrings._candidates(50, 25, 1)(docs, hits)
    answers = substrings._smallest(found)
    schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out = substrings._remover(50, schema)(docs, answers).to_pylist()
    assert [r["n_removed"] for r in out] == [0, 0, 60]


def test_stretches_that_share_a_first_hash(monkeypatch):
    """The token cache confirms by a second hash."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    real = packing.byte_hash
    monkeypatch.setattr(packing, "byte_hash", lambda data, a, b, kind=0: real(data, a, b, 0) % np.uint64(5) if kind == 0 else real(data, a, b, 1))
    texts = ["the cat sat on the mat", "a dog, a log; a frog", thue_morse(1024, "a", "b") + " " + thue_morse(1024, "b", "a"), "", "the log"]
    encoder, library = packing.Encoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        data, bounds = hashing.text_bytes(pa.array(texts))
        ids, first = encoder.encode(data, bounds)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_keeps_stretches(monkeypatch):
    """Kept stretches are not encoded again, a full cache or another stretch under a kept hash changes no id, and ids are held flat."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    texts = [f"some words{i} and w{i * 7} again, again\n{i}" for i in range(60)]

    def agrees(encoder, texts):
        col = pa.array(texts)
        ids, first = encoder.encode(*hashing.text_bytes(col))
        for i, t in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids

    encoder = packing.Encoder(path)
    agrees(encoder, texts)
    real, asked = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, some, **how):
            asked.extend(some)
            return real.encode_batch_fast(some, **how)

    encoder.tokenizer = Counting()
    agrees(encoder, texts[::-1])
    assert not asked and (np.diff(encoder.names) > 0).all() and int(encoder.size.sum()) == len(encoder.flat)
    encoder.checks[::2] ^= np.uint64(1)  # as if another stretch had the first hash
    agrees(encoder, texts)
    assert asked
    monkeypatch.setattr(packing, "_CACHE_ENTRIES", 10)
    small = packing.Encoder(path)
    for _ in range(2):
        agrees(small, texts)
    assert len(small.names) == 10
