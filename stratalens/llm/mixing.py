"""Mixing sources to target weights, in DataFrame operations only.

The words of each source form one stream, cut into fixed-length blocks. The
output is dealt in shards; each shard draws how many of its slots go to which
source (residual multinomial: whole parts are given, the rest is drawn). The
slots of a source run through pseudorandom permutations of its block indexes,
one per pass over the source, and blocks meet the documents by index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 16
_RID, _TAKEN, _WORDS = "row of the mix", "taken by the mix", "words of the row"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    marked = F.regexp_replace(F.translate(text, "x", "y"), WORD, "x")
    return F.coalesce((F.length(marked) - F.length(F.replace(marked, F.lit("x"), F.lit("")))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """source, size -> sid, source_size, target for each source.

    Sources in code-point order, null last, take the weights in turn. Shares of
    the total stop at cap times the source's size; the excess goes to the
    others by weight. Sorted by cap over weight, the capped sources are a
    prefix, so running sums find them without iterating.
    """
    every = Window.partitionBy(F.lit(0))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = src.withColumn("sid", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    src = src.withColumn("most", F.col("source_size") * float(cap)).withColumn("total", F.sum("source_size").over(every))
    before = every.orderBy(F.col("most") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    src = src.withColumn("capped", left * F.col("w") >= F.col("most") * open_w)
    rest = F.col("total") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(every)
    open_all = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(every)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", rest * F.col("w") / open_all))
    return src.select("source", "sid", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """A keyed pseudorandom permutation of 0..size-1: swap-or-not rounds of a hash."""

    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), size) - x, size)
        return F.when(F.xxhash64(*key, r, F.lit("swap"), F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), index.cast("long"), turn)


def _block_takes(src: DataFrame, block: int, shard_slots: int, cap: int, seed: int) -> DataFrame:
    """sid, blk, times: how often each block of each source is taken."""
    every = Window.partitionBy(F.lit(0))
    live = src.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    live = live.withColumn("want", F.col("target") * F.col("n_blocks") / F.col("source_size"))
    live = live.withColumn("all", F.sum("want").over(every))
    live = live.withColumn("slots", F.greatest(F.lit(float(shard_slots)), F.ceil(F.col("all") / 1e6).cast("double")))
    # One plan row for full shards and one for the last, short one.
    kind = F.explode(F.array(F.struct(F.lit(True).alias("full"), F.col("slots").alias("m")), F.struct(F.lit(False).alias("full"), F.round(F.col("all") - F.floor(F.col("all") / F.col("slots")) * F.col("slots")).alias("m"))))
    part = live.withColumn("kind", kind).select("sid", "n_blocks", "all", "slots", "kind.full", "kind.m", (F.col("kind.m") * F.col("want") / F.col("all")).alias("share"))
    part = part.withColumn("base", F.floor("share").cast("long")).withColumn("frac", F.col("share") - F.floor("share"))
    upto = Window.partitionBy("full").orderBy("sid")
    part = part.withColumn("cum", F.sum("frac").over(upto))
    plan = part.groupBy("full", "all", "slots", "m").agg(
        F.array_sort(F.collect_list(F.struct("sid", "cum"))).alias("cdf"),
        (F.col("m") - F.sum("base")).cast("int").alias("draws"),
        F.max("cum").alias("mass"),
    )
    # n whole shards numbered 0..n-1 and a last one n.
    whole = F.floor(F.col("all") / F.col("slots")).cast("long")
    shards = plan.withColumn("shard", F.explode(F.when(F.col("full") & (whole > 0), F.sequence(F.lit(0).cast("long"), whole - 1)).when(~F.col("full"), F.array(whole))))
    unit = (F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(1 << 53)) + F.lit(0.5)) / float(1 << 53)
    drawn = shards.withColumn("draw", F.explode(F.when(F.col("draws") > 0, F.sequence(F.lit(1), F.col("draws")))))
    drawn = drawn.withColumn("u", unit * F.col("mass"))
    drawn = drawn.select("shard", F.expr("coalesce(filter(cdf, c -> c.cum > u)[0].sid, element_at(cdf, -1).sid)").alias("sid"), F.lit(1).cast("long").alias("n"))
    given = shards.select("shard", "full").join(part.select("sid", "full", "base"), "full").select("shard", "sid", F.col("base").alias("n"))
    counts = given.unionByName(drawn).groupBy("shard", "sid").agg(F.sum("n").alias("n")).where("n > 0")
    run = Window.partitionBy("sid").orderBy("shard")
    counts = counts.withColumn("stop", F.sum("n").over(run)).join(live.select("sid", "n_blocks"), "sid")
    # A row here becomes thousands of slots: dealt out first, and by number, so that it stays dealt out.
    counts = counts.repartition(int(src.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "sid")
    slots = counts.withColumn("slot", F.explode(F.sequence(F.col("stop") - F.col("n"), F.col("stop") - 1)))
    slots = slots.where(F.col("slot") < F.col("n_blocks") * cap)
    turn = F.floor(F.col("slot") / F.col("n_blocks")).cast("long")
    slots = slots.select("sid", "n_blocks", turn.alias("turn"), (F.col("slot") - turn * F.col("n_blocks")).alias("i"))
    slots = slots.select("sid", permuted(F.col("i"), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("turn")).alias("blk"))
    return slots.groupBy("sid", "blk").agg(F.count("*").alias("times"))


def mix_plan(docs: DataFrame, block: int = 128, shard_slots: int = 4096, cap: int = 3, weights: tuple[float, ...] = (1, 2, 3), seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix of `docs(doc_id, source, text)`.

    documents: rid, doc_id, sid, size, source_size, target, one row per input
    row. pieces: rid, doc_id, sid, size, begin, words, times: for each stretch
    of a document inside one block, its first word, its words and how often the
    mix takes it. Shards have `shard_slots` slots, or as many as make a million
    shards of the whole; slots drawn beyond `cap` passes over a source are left.
    """
    rid = F.col(_RID).alias("rid") if _RID in docs.columns else F.monotonically_increasing_id().alias("rid")
    sized = stage(docs.select(rid, "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    rows = sized.count()
    groups = max(1, math.ceil(rows / 1000))
    src = stage(source_targets(sized, weights, cap), "mix-sources")
    # Sources of equal name, null included, meet by name: a hot one is split by AQE or, small, broadcast.
    known = sized.join(src, sized["source"].eqNullSafe(src["source"])).select("rid", "doc_id", "sid", "size", "source_size", "target")
    # Position in the source's stream by running sums in two levels, so no task orders a whole source.
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(groups)))
    sums = known.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    sums = sums.select("sid", "bucket", (F.sum("s").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("base"))
    inner = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    known_at = known.join(sums, ["sid", "bucket"]).withColumn("at", F.col("base") + F.sum("size").over(inner) - F.col("size"))
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("at") / block).cast("long"), F.floor((F.col("at") + F.col("size") - 1) / block).cast("long")))
    pieces = known_at.select("rid", "doc_id", "sid", "size", "source_size", "target", "at", F.explode_outer(blocks).alias("blk"))
    left = F.greatest(F.col("at"), F.col("blk") * block)
    right = F.least(F.col("at") + F.col("size"), (F.col("blk") + 1) * block)
    pieces = pieces.select("rid", "doc_id", "sid", "size", "source_size", "target", "blk", (left - F.col("at")).alias("begin"), F.coalesce(right - left, F.lit(0).cast("long")).alias("words"))
    pieces = pieces.join(_block_takes(src, block, shard_slots, cap, seed), ["sid", "blk"], "left")
    return known, pieces.withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes.

    One row per input row. Null texts and texts without words have size 0 and
    are never taken; null sources form one source, ordered last; null doc_ids
    are mixed like others; repeated rows are separate documents; an empty table
    gives no rows; extra columns are ignored. Very long texts span many blocks,
    each drawn on its own. Equal input, partitioning included or not, gives
    equal results, as only hashes of values are drawn.
    """
    _, pieces = mix_plan(docs.select("doc_id", "source", "text"), **how)
    return pieces.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.col("times")).alias("taken")).drop("rid")


def mixed_documents(docs: DataFrame, cap: int = 3, **how) -> DataFrame:
    """The mix as documents: the columns of `docs(doc_id, source, text, n_chars, ...)`, up to `cap` rows for each.

    The k-th row of a document holds its words that the mix takes k times or
    more, in order; its text is unchanged if that is all of them, else the words
    joined by one space. n_chars is the new length, other columns are copied.
    Documents of which nothing is taken give no row. Cases are as in mix().
    """
    docs = stage(docs.withColumn(_RID, F.monotonically_increasing_id()), "mix-docs")
    _, pieces = mix_plan(docs.select(_RID, "doc_id", "source", "text"), cap=cap, **how)
    taken = pieces.where("times > 0").groupBy("rid", "size").agg(F.array_sort(F.collect_list(F.struct("begin", "words", "times"))).alias("pieces"))
    taken = taken.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("pieces.times"))))
    taken = taken.withColumn("pieces", F.filter("pieces", lambda p: p["times"] >= F.col("turn")))
    whole = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["words"]) == F.col("size")
    # What the mix adds stands in one column of a name of its own, so that columns of any other name are copied.
    taken = taken.select(F.col("rid").alias(_RID), F.struct("pieces", whole.alias("whole")).alias(_TAKEN))
    mine = F.col(_TAKEN)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.join(taken, _RID).withColumn(_WORDS, F.when(~mine["whole"], words))
    some = F.array_join(F.flatten(F.transform(mine["pieces"], lambda p: F.slice(F.col(_WORDS), (p["begin"] + 1).cast("int"), p["words"].cast("int")))), " ")
    rows = rows.withColumn("text", F.when(mine["whole"], F.col("text")).otherwise(some))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns if c != _RID])
