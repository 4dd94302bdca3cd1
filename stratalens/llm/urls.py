"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL yields the (host suffix, path prefix) expressions that a rule of the
deepest rules' labels and path could be written as. Rules and expressions meet by an equi-join on the first bytes
of a SHA-256 digest; the full digest confirms a match and the longest matching
rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8  # hex digits of the digest used as join key: 4 bytes


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://' or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Host suffixes of up to `labels` labels, each with the empty prefix and the path prefixes that end in one of the first `depth` slashes.

    Their number is bounded by the rules, whatever the URL's length.
    """
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    ends = [F.when(slashes >= k, F.concat(F.substring_index(path, "/", k), F.lit("/"))) for k in range(1, depth + 1)]
    prefixes = F.array_compact(F.array(F.lit(""), *ends))
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Judge `pages(page_id, url)` by (verdict, host, path) rules.

    Returns page_id, host, path, rule and verdict, one row per input row.
    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path; the longest rule wins and `default` applies where none fits.

    Rule paths are empty or end in '/', so that prefixes can be enumerated.
    Null URLs and URLs without '://' have an empty host and path and fit no
    rule. Repeated rows each come back; null page_ids are kept; other columns
    of `pages` are neither read nor returned; an empty table gives no rows;
    an empty rule list gives `default` everywhere. Equal rules with different
    verdicts raise ValueError.
    """
    if len({(h, p) for _, h, p in rules}) < len(set(rules)):
        raise ValueError("a rule is given with two verdicts")
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or (path and not (path[0] == path[-1] == "/")):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    depth = max((p.count("/") for _, _, p in rules), default=0)
    spark = pages.sparkSession
    table = spark.createDataFrame([(f"{h}{p}", v) for v, h, p in sorted(set(rules))], "rule string, rule_verdict string")
    table = table.withColumn("rule_digest", F.sha2("rule", 256)).withColumn(
        "key", F.substring("rule_digest", 1, PREFIX_HEX)
    )
    host, path = url_parts(F.col("url"))
    # Equal (page_id, url) rows are judged once and handed back `copies` times.
    judged = (
        pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("copies"))
        .select("page_id", "copies", host.alias("host"), path.alias("path"))
    )
    judged = judged.groupBy("page_id", "host", "path").agg(F.sum("copies").alias("copies"))
    asked = (
        judged.withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), labels, depth)))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("key", F.substring("digest", 1, PREFIX_HEX))
    )
    met = asked.join(table, "key", "left").withColumn("fits", F.col("digest") == F.col("rule_digest"))
    best = met.groupBy("page_id", "host", "path", "copies").agg(
        F.max(F.when(F.col("fits"), F.struct(F.length("rule"), "rule", "rule_verdict"))).alias("best")
    )
    return best.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")
