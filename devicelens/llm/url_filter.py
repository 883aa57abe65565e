"""Operator 7: URL rules through a blocked Bloom filter and an exact hash join.

A URL's possible rules are its host's suffixes with its path's prefixes.  A blocked Bloom filter
of the listed ones lets few others pass, and a join with the list removes those.  Every block is 256 bits
in eight words, and a key sets one bit in each.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys a block is planned for; the chance of a false hit is then below one in a thousand.
KEYS_PER_BLOCK = 12
WORDS = 8
#: Blocks up to which the filter (some 100 bytes each) is broadcast; beyond, it is joined by block.
MAX_BROADCAST_BLOCKS = 200_000


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> list[Column]:
    spread = F.xxhash64(key, F.lit("bits"))
    places = [F.shiftright(spread, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1), place) for place in places]


def bloom_filter(keys: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, word0 ... word7) of the blocks that hold a key; built by partial aggregation."""
    bits = [bit.alias(f"word{i}") for i, bit in enumerate(_bits(F.col(key)))]
    return (
        keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *bits)
        .groupBy("block")
        .agg(*[F.bit_or(f"word{i}").alias(f"word{i}") for i in range(WORDS)])
    )


def may_contain(probes: DataFrame, bloom: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """The rows of ``probes`` whose key the filter may contain."""
    if blocks <= MAX_BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col(key))):
        hit = hit & (F.col(f"word{i}").bitwiseAND(bit) != 0)
    return (
        probes.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
        .join(bloom, "block")
        .where(hit)
        .select(probes.columns)
    )


def candidates(host_name: Column, path_name: Column, lengths: list[int]) -> Column:
    """host suffix + path prefix for every suffix at a dot and every one of the prefix lengths."""
    labels = F.split(host_name, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.length(path_name) >= n, F.substring(path_name, 1, n)) for n in lengths])
    )
    pairs = F.transform(
        suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))
    )
    return F.flatten(pairs)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of these names.

    ``rules`` has (host, path, verdict).  A rule fits its host and all subdomains if the URL's path
    starts with the rule's; of those that fit the longest wins (then the longer host; of rules
    listed twice the smaller verdict).  A URL that none fits is not listed: ``rule`` is null
    and the verdict is ``default``.  A null URL and one without ``://`` have empty host and path.
    Equal URLs are judged once, so a common one costs no more than a rare one.
    """
    listed = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.struct("host", "path"))
    )
    # One number per length of a rule's path, and the number of rules.
    count, lengths = listed.agg(F.count("*"), F.collect_set(F.length("path"))).first()
    blocks = 1 << max(0, math.ceil(math.log2(max(1, count) / KEYS_PER_BLOCK)))
    base = pages.drop("host", "path", "rule", "verdict")
    # The rows travel as one struct, so no column name can clash.
    place = F.struct(host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    split = base.select(place.alias("place"), F.struct("*").alias("row"))
    if not count:
        nothing = F.lit(None).cast("string")
        return split.select("row.*", "place.*", nothing.alias("rule"), F.lit(default).alias("verdict"))
    probes = (
        split.select("place")
        .distinct()
        .select(
            "place",
            F.explode(candidates(F.col("place.host"), F.col("place.path"), sorted(lengths))).alias("key"),
        )
    )
    passed = may_contain(probes, bloom_filter(listed, blocks), blocks)
    length = F.length("host") + F.length("path")
    best = (
        passed.join(listed, "key")
        .groupBy("place")
        .agg(
            F.max_by(
                F.struct(F.concat("host", "path").alias("rule"), "verdict"),
                F.struct(length, F.length("host"), "host", "path"),
            ).alias("best")
        )
    )
    return split.join(best, "place", "left").select(
        "row.*",
        "place.*",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
