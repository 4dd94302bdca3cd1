"""Very long values, clashing columns and records that look like others."""

import collections
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stratalens.llm import classifier, jaccard, mixing, packing, pitman_yor, queries, rules, substrings, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def long_docs(spark):
    """A text of 300,000 words, a near copy of it, one word of 200,000 letters, and short texts."""
    rng = random.Random(8)
    long = [f"v{rng.randrange(5000)}" for _ in range(300_000)]
    near = list(long)
    for i in range(0, 300_000, 3000):
        near[i] = f"z{i}"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "x" * 200_000), (4, "short text"), (5, None), (6, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(0).cast("long"))


def test_long_texts_are_whole(spark, long_docs):
    by = {r["doc_id"]: r for r in jaccard.near_duplicates(long_docs).collect()}
    assert by[2]["component_id"] == 1 and by[1]["n_shingles"] > 290_000 and by[3]["n_shingles"] == 1 and by[5]["n_shingles"] == 0
    by = {r["doc_id"]: r for r in substrings.dedup_substrings(long_docs).collect()}
    # All but the changed words lie in windows of the first text.
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] == 300_000 - 100 and by[3]["n_words"] == 1
    counts = {r["doc_id"]: r for r in rules.signals(long_docs, "lang").collect()}
    assert counts[1]["n_words"] == 300_000 and counts[3]["word_chars"] == 200_000 and counts[5]["n_words"] == 0
    assert classifier.score(long_docs, np.zeros((1 << classifier.BITS) + 1)).where("score = 0.5").count() == 6
    pieces = packing.pack_documents(long_docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("start").alias("s")).collect()
    assert {r["doc_id"] for r in pieces} == {1, 2, 3, 4, 5, 6} and max(r["s"] for r in pieces) > 500_000


def test_long_texts_are_scored(spark, long_docs):
    model = pitman_yor.train(long_docs, burn_in=1, keep=1)
    got = {r["doc_id"]: r for r in pitman_yor.score(model, long_docs).collect()}
    assert got[1]["n_tokens"] == 300_001 and got[5]["n_tokens"] == got[6]["n_tokens"] == 1
    assert got[1]["score"] > got[1]["base_score"]


def test_next_tokens_sum_to_one(spark):
    """All training words, the unknown word and the end after a word, after an unknown word and at the start."""
    train = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c a b", "b c", "a a a a d", "", None] * 4)], "doc_id long, text string")
    model = pitman_yor.train(train, keep=2)
    words, after = ["a", "b", "c", "d", "unseen"], ["", "a", "c", "unseen"]
    texts = sorted({f"{x} {w}".strip() for x in after for w in ["", *words]})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, open_ = ({t: 10 ** r["score"] for t, r in zip(texts, pitman_yor.score(model, df, end=end).orderBy("doc_id").collect(), strict=True)} for end in (True, False))
    for x in after:
        total = whole[x] + sum(open_[f"{x} {w}".strip()] for w in words)
        assert total == pytest.approx(open_[x] if x else 1.0)


def test_urls_of_any_depth(spark):
    """A URL of 100,000 slashes and labels costs what a short one does."""
    deep = "http://" + "a." * 100_000 + "example.com/en/" + "x/" * 100_000
    rows = [(1, deep), (2, "http://x.net/es/" + "y" * 500_000), (3, "http://" + "/" * 100_000), (4, "http://a.example.com")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("net/es/", "block"), 3: (None, "allow"), 4: (None, "allow")}
    rule = [("block", "example.com", ""), ("allow", "example.com", "/a/b/c/")]
    rows = [(1, "http://example.com/a/b/c/d"), (2, "http://example.com/a/b/c"), (3, "http://example.com"), (4, "http://sub.example.com/a/b/c/")]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rule).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow"}


def test_records_that_hold_records(spark, tmp_path):
    """Blocks with blank lines and a version line come back whole, by their length."""
    inner = "a\r\n\r\nWARC/1.0\r\nb: c\r\n\r\nd\r\n\r\nWARC/1.0\r\n"
    blocks = ["plain", inner, "", "é\r\n\r\n", "\r\n\r\nWARC/1.0\r\n\r\n\r\n", "last"]
    rows = [({"WARC-Type": "response", "Content-Length": str(len(b.encode()))}, b) for b in blocks]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "headers map<string,string>, block string").coalesce(1), path)
    back = warc.read_warc(spark, path).collect()
    assert [r["headers"]["Content-Length"] for r in back] == [str(len(b.encode())) for b in blocks] if len(back) == len(blocks) else False
    assert [r["block"] for r in back] == blocks


@pytest.mark.parametrize("piece", ["<a ", "<title", "<script ", "<a href='", '<a "', "<!--", "<p title=\"x'", "<"])
def test_unclosed_tags_take_linear_time(piece):
    page = piece * 60_000
    began = time.time()
    warc.derive({}, page)
    assert time.time() - began < 10


def test_links_and_titles():
    page = "<title>A &amp; B</title><A HREF='/x'>x</A><img alt=\"a > b\" src=i.png><!-- <a href=no> --><link rel=r href=\"/s\"></a href=never><a name=q>"
    assert warc.links(page) == [{"path": "a", "url": "/x"}, {"path": "img", "url": "i.png"}, {"path": "link", "url": "/s"}]
    assert warc.title_of(page) == "A & B" and warc.title_of("<title>no end") is None


def test_columns_of_any_name(spark, corpus):
    """Columns that stages use themselves come back as they were."""
    names = ["rid", "size", "pieces", "turn", "whole", "begin", "words", "times", "sid", "blk", "pid", "bucket", "share", "kind", "blob", "node", "token"]
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    stages = {
        "mix": mixing.mixed_documents(df, block=16, shard_slots=64),
        "passages": substrings.dedup_substrings(df).select(*df.columns),
        "copies": jaccard.keep_first(df),
        "quality": classifier.keep(df, np.zeros((1 << classifier.BITS) + 1), 0.0),
    }
    for label, out in stages.items():
        assert out.columns == df.columns, label
        for r in out.collect():
            assert all(r[n] == f"{n} of {'none' if r['doc_id'] is None else r['doc_id']}" for n in names), label
    parts = packing.pieces(df, PATH, 64).withColumn("share", F.lit("kept")).withColumn("base", F.lit(7))
    assert {(r["share"], r["base"]) for r in packing.pack(parts, 64).collect()} == {("kept", 7)}


def test_labels_of_absent_and_repeated_documents(spark):
    """The sample is of ids that have documents, and a repeated id is learnt once."""
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else f"## bad {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    absent = labels.union(spark.createDataFrame([(1000 + i, 1) for i in range(500)], "doc_id long, quality int"))
    assert np.array_equal(classifier.train(docs, labels, 60), classifier.train(docs, absent, 60))
    assert np.array_equal(classifier.train(docs, labels), classifier.train(docs.union(docs), labels))


def test_tokens_of_texts_without_words():
    import pyarrow as pa

    token, context, n = pitman_yor._tokens(pa.chunked_array([pa.array(["", None, " \n", "a"])]))
    assert n.tolist() == [1, 1, 1, 2] and collections.Counter(token.tolist())[int(pitman_yor._END)] == 4
    assert (context[:3] == pitman_yor._START).all()


def test_blocks_lose_no_link(spark):
    """A chain in which only neighbours link, and texts that share shingles with it without linking, in blocks of a few."""
    from test_dedup import brute_components

    word = [f"c{i}" for i in range(600)]
    rows = [(i, " ".join(word[3 * i : 3 * i + 100])) for i in range(40)]
    rows += [(100 + i, " ".join([*word[12 * i : 12 * i + 60], *(f"own{i}x{j}" for j in range(40))])) for i in range(12)]
    rows += [(200 + i, " ".join([*word[:98], f"near{i}"])) for i in range(15)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, block_rows=6).collect())
    assert got == brute_components(rows, 3, 90)
    assert len({c for *_, c in got}) > 3
