"""URL filters: a blocked Bloom filter of listed URL keys, then an exact hash join.

Everything is DataFrame functions. A rule is (host, path, verdict): it fits its host and all
subdomains if the URL's path starts with the rule's path; the longest rule wins (ties: the longer
host). Keys that the Bloom filter passes go to an exact equi-join, which removes false positives.

Defined results: a null URL or one without `://` has an empty host and path and no rule; without a
rule the verdict is `default`; repeated rows and null ids are kept as they are; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BLOCKS = 1 << 17
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL, empty strings where there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A small literal rule list as a local relation; its size is known to the planner."""
    named = {f"p{3 * k + i}": x for k, rule in enumerate(rules) for i, x in enumerate(rule)}
    if not named:
        return spark.createDataFrame([], "host string, path string, verdict string")
    rows = ", ".join(f"(:p{k}, :p{k + 1}, :p{k + 2})" for k in range(0, len(named), 3))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)", args=named)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _blocks(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and its bits in the block's four 64-bit words, two in each."""
    h = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")

    def bit(k: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))

    return F.pmod(F.xxhash64(key), F.lit(n_blocks)), [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(4)]


def bloom_filter(rules: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3): at most n_blocks rows of 40 bytes, whatever the list's length."""
    block, words = _blocks(_key(F.col("host"), F.col("path")), n_blocks)
    return rules.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def blocks_for(rules: int) -> int:
    """A power of two of blocks that gives each rule 16 bits or more, of 4 MB in all at most."""
    return min(MOST_BLOCKS, 1 << max(6, (rules // 16).bit_length()))


def filter_urls(pages: DataFrame, rules: DataFrame, *, n_blocks: int | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages(page_id, url).

    Each row's host suffixes with the listed lengths of its path's prefixes meet the filter by a broadcast of
    5 MB at most, sized by the number of rules; a longer list passes more to the exact join. Hits are grouped
    by page and URL, so a URL that many pages have is no group. The rules are joined as the planner sees fit.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("path")).alias("lengths")).first()  # the listed paths' lengths are few
    n_blocks, lengths = n_blocks or blocks_for(shape["n"]), sorted(shape["lengths"])
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("u_host"), path.alias("u_path"))
    labels = F.split("u_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("u_path") >= n, F.substring("u_path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    probes = rows.where("u_host <> ''").select("page_id", "url", F.explode(suffixes).alias("host"), prefixes.alias("_p")).select("page_id", "url", "host", F.explode("_p").alias("path"))
    block, words = _blocks(_key(F.col("host"), F.col("path")), n_blocks)
    probes = probes.select("page_id", "url", "host", "path", block.alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)])
    hit = functools.reduce(Column.__and__, [F.col(f"m{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"m{i}") for i in range(4)])
    possible = probes.join(F.broadcast(bloom_filter(rules, n_blocks)), "block").where(hit).select("page_id", "url", "host", "path")
    key = _key(F.col("host"), F.col("path"))
    best = possible.join(rules, ["host", "path"]).groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url")).agg(F.max(F.struct(F.length(key).alias("n"), F.length("host").alias("h"), key.alias("rule"), "verdict")).alias("best"))
    joined = rows.join(best, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("url") == F.col("_url")), "left")
    return joined.select("page_id", F.col("u_host").alias("host"), F.col("u_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
