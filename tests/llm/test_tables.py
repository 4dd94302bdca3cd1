"""Search, URL filters, mixing, packing, WARC and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratalens.llm import mixing, packing, queries, storage, topk, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.01, -0.3, 0.5]) for _ in range(6)]) for i in range(120)]
    rows += [(200, None), (201, [0.1, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, []), (205, [0.5]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("lane", F.lit("x"))
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {i: v for i, v in good if i % 50 == 0}
    want = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    got = [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), block=50, query_block=2).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e15]), (1, [1e15]), (2, [-1e15])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in topk.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [2**63 - 1, -(2**63)]


def test_top_k_grid():
    """Copies of either side stay within a few times the candidates, however many partitions there are."""
    for candidates, many, partitions in [(20_000_000, 400_000, 600), (20_000_000, 400_000, 12), (1000, 1000, 600), (500, 10, 12), (0, 0, 12), (5, 0, 12)]:
        lanes, groups = topk.grid(candidates, many, partitions)
        assert lanes >= 1 and groups >= 1 and lanes * many + groups * candidates <= 6 * candidates
        assert candidates <= lanes << 20


def test_top_k_neither_copies_queries_by_partition_nor_broadcasts(spark):
    df = spark.range(400).selectExpr("id vec_id", "array(cast(id % 7 as float), cast(id % 11 as float)) embedding")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        out = topk.top_k(df, df.where("vec_id % 2 = 0"), query_block=50)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and "499" not in plan


def test_top_k_kinds_of_sums():
    """Floats, 64-bit and Python integers give the same best, over blocks seen one after another."""
    rng = np.random.default_rng(5)
    for top in (3, 300, 100_000, 2**24, 2**30, 2**40):
        data = rng.integers(-top, top, (90, 7)) * (rng.random((90, 7)) < [1, 1, 1, 0.3, 0.1, 0, 1])
        data[40:60] = data[3]
        ids, asked = rng.permutation(90), data[[0, 3, 45, 89], :5]
        best = topk._Best(ids[[0, 3, 45, 89]], asked, 5)
        for at in (0, 4, 30, 64, 90):
            if at < 90:
                to = {0: 4, 4: 30, 30: 64, 64: 90}[at]
                best.see(topk._Block(ids[at:to], np.ascontiguousarray(data[at:to].T)))
        for n, (q, (scores, names)) in enumerate(zip([0, 3, 45, 89], best.held, strict=True)):
            sums = [sum(int(a) * int(b) for a, b in zip(asked[n], v, strict=False)) for v in data]
            want = sorted((-s, int(i)) for s, i, j in zip(sums, ids, range(90), strict=True) if j != q)[:5]
            assert [(-int(s), int(i)) for s, i in zip(scores, names, strict=True)] == want


URLS = [
    "https://Www.Example.com/en/1?q", "http://example.com/en/", "http://example.com/en", "http://badexample.com/en/x", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/",
    None, "no scheme", "://com/", "http://x.com", "http://x.com/", "http://com/?x#y", "ftp://a.b.c.example.com/en/deep/er", "",
]


def test_urls(spark):
    df = spark.createDataFrame([*enumerate(URLS), (None, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    want = sorted((str(i), *map(str, judge(u))) for i, u in [*enumerate(URLS), (None, URLS[0]), (0, URLS[0])])
    assert sorted(tuple(map(str, r)) for r in urls.filter_urls(df, queries.URL_RULES).collect()) == want
    assert urls.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    assert urls.filter_urls(df, []).where("verdict = 'allow' and rule is null").count() == len(URLS) + 2
    with pytest.raises(ValueError):
        urls.filter_urls(df, [("allow", "a", "/"), ("block", "a", "/")])


def test_url_rule_of_a_whole_host(spark):
    df = spark.createDataFrame([(0, "http://example.com/x"), (1, "http://a.example.com"), (2, "http://example.com/en/y"), (3, "http://badexample.com/x")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, [("block", "example.com", ""), ("allow", "example.com", "/en/")]).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def water_fill(sizes, weights, cap=3):
    total, target, live = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while live and left > 1e-9:
        w = sum(weights[i] for i in live)
        over = {i for i in live if target[i] + left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in live:
                target[i] += left * weights[i] / w
            break
        share = {i: left * weights[i] / w for i in live}
        left = 0.0
        for i in live:
            room = cap * sizes[i] - target[i]
            left += max(0.0, share[i] - room)
            target[i] += min(share[i], room)
        live -= over
    return target


def test_mixing(docs, corpus, empty):
    rows = mixing.mix(docs, block=8, shard_slots=256).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(d), size(t)) for d, t, *_ in corpus)
    by = collections.Counter()
    for _, t, _, s, _ in corpus:
        by[s] += size(t)
    names = sorted((s for s in by if s is not None)) + [None]
    want = dict(zip(names, water_fill([by[s] for s in names], [1, 2, 3, 1])))
    source = {str(d): s for d, _, _, s, _ in corpus}
    taken = collections.Counter()
    for r in rows:
        s = source[str(r["doc_id"])]
        assert r["source_size"] == by[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.06 * want[s] + 40
    again = mixing.mix(docs.repartition(3), block=8, shard_slots=256).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(empty).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 64, 101):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r["p"] for r in got) == list(range(n))


def test_mixed_documents(docs, corpus):
    plan = collections.Counter()
    for r in mixing.mix(docs, block=8, shard_slots=256).collect():
        plan[str(r["doc_id"])] += r["taken"]
    out = mixing.mixed_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"), block=8, shard_slots=256)
    got = collections.Counter()
    for r in out.collect():
        got[str(r["doc_id"])] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == +plan


def test_tokens_equal_the_library(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    odd = ["a  b   c\n \n d", "é è\xa0ü ñ<|endoftext|> x", " 's don't it's  'll", "  x \x1c y  ", "x \n\n  y\t z 漢字 かな   ", "é b", "ß é"]
    rows = [(d, t) for d, t, *_ in corpus] + [(900 + i, t) for i, t in enumerate(odd)]
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        begin, stop = 0, len(ids) - 64 * ((len(ids) - 1) // 64)
        k = 0
        while begin < len(ids):
            want.append((str(d), k, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes())))
            begin, stop, k = stop, stop + 64, k + 1
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = [(str(r["doc_id"]), *list(r)[1:]) for r in packing.pieces(df, PATH, 64).collect()]
    assert sorted(got) == sorted(want)


def check_packed(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, PATH, 128).collect()
    n = check_packed(rows, 128)
    assert n <= 1.1 * math.ceil(sum(r["length"] for r in rows) / 128) + 1
    assert packing.pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs.sparkSession.createDataFrame([(1, 0, 300)], "doc_id long, piece int, length long"), 128)


@pytest.mark.parametrize("seed", range(3))
def test_configurations_cover(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 50): rng.randint(1, 400) for _ in range(25)}
    plan = packing.configurations(histogram, 50, rounds=200)
    used = collections.Counter()
    for content, many in plan.items():
        assert sum(content) <= 50 and many > 0
        for x in content:
            used[x] += many
    assert used == histogram
    small = packing.price(np.array([3.0, 4.0, 7.5]), np.array([3, 4, 8]), 11)
    assert small == {3: 1, 4: 2} or sum({3: 3.0, 4: 4.0, 8: 7.5}[k] * v for k, v in small.items()) == 11.0


def test_warc(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><p>One <b>bold</b> word<p>Two<br>Three <a href=\"/x?a=1&amp;b\">go</a><!-- no --></body></html>"
    rows = [(1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "x < y"), (1, "http://a/", page), (5, "http://d/", "<p>" * 5000 + "end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("headers", F.lit("h"))
    source = warc.responses(df)
    out = warc.derivatives(source).collect()
    assert len(out) == 2 * len(rows)
    first = next(r for r in out if r["page_id"] == 1 and r["headers"]["WARC-Type"] == "conversion")
    assert first["block"] == "A & B\nOne bold word\nTwo\nThree go"
    origin = source.where("page_id = 1").first()["headers"]
    assert first["headers"]["WARC-Refers-To"] == origin["WARC-Record-ID"]
    assert first["headers"]["WARC-Refers-To-Payload-Digest"] == origin["WARC-Payload-Digest"] == warc.digest(page.encode())
    meta = next(r for r in out if r["page_id"] == 1 and r["headers"]["WARC-Type"] == "metadata")
    assert '"url": "/x?a=1&b"' in meta["block"] and '"Title": "A & B"' in meta["block"] and origin["WARC-Record-ID"] in meta["block"]
    for r in out:
        assert r["headers"]["WARC-Block-Digest"] == warc.digest(r["block"].encode()) and int(r["headers"]["Content-Length"]) == len(r["block"].encode())
    assert warc.derivatives(source.limit(0)).count() == 0
    other = spark.createDataFrame([({"WARC-Type": "request"}, "GET"), (None, None)], "headers map<string,string>, block string")
    assert warc.derivatives(other).count() == 2
    # Round trip through files.
    path = str(tmp_path / "w")
    warc.write_warc(source.select("headers", "block"), path)
    back = warc.read_warc(spark, path).select("headers", "block").collect()
    key = lambda r: (sorted(r["headers"].items()), r["block"])
    assert sorted(map(key, back)) == sorted(map(key, source.select("headers", "block").collect()))


def test_pipeline(spark, tmp_path, corpus):
    """Stages keep the columns of documents and the result packs exactly what the last mix held."""
    folder = str(tmp_path)
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(20)] + [(63, 0, 0), (64, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        kept = storage.stage(function(spark, kept, folder), name)
        assert sorted(kept.columns) == sorted(docs.columns), name
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "ngram_jaccard_join":
            assert 40 in ids and not {41, 42, 43, 44, 45, 50, 51} & set(ids)
        if name == "substring_dedup":
            text = {r["doc_id"]: r["text"] for r in kept.collect()}
            assert len(WORD.findall(text[31])) == 60 and len(WORD.findall(text[32])) == 20 and len(WORD.findall(text[30])) == 70
    got = corpus_pipeline.run(spark, folder).collect()
    check_packed(got, 2048)
    assert sum(r["length"] for r in got) == packing.pieces(kept, PATH).agg(F.sum("length")).first()[0]
