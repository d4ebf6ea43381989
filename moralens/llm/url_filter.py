"""URL filtering: host/path rules, then a list of canonical URLs behind a blocked Bloom filter.

Everything is Spark SQL functions. The filter is a table of at most ``MAX_BLOCKS`` rows of four
64-bit lanes, so its broadcast is bounded whatever the list's size; a larger list only lets more
candidates through, and the exact hash join after it removes them. URLs that the filter rules out
never reach a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moralens.staging import row_count, stage

LANES = 4
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18  # times 40 bytes: at most 10 MB to every executor

#: Fixed values: (verdict, rule) in the published form host/path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; '' without one and for NULL."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without slashes at its end, query without tracking parameters.

    Scheme and fragment go. URLs without a host have no canonical form: NULL.
    """
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(query, "(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    kept = F.regexp_replace(kept, "^&+", "")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (NULL: none fits).

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    rule = verdict = None
    for decision, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, tail = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + tail)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(decision)) if verdict is None else verdict.when(fits, F.lit(decision))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each of the block's lanes, from a hash independent of the block's."""
    bits = F.xxhash64(key, F.lit("lane"))
    return [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * lane).bitwiseAND(F.lit(63)).cast("int"))
        for lane in range(LANES)
    ]


def bloom_filter(listed: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """Blocked Bloom filter of ``listed[key]``: one row per non-empty block, one column per lane."""
    wanted = max(1, math.ceil(n_keys / KEYS_PER_BLOCK))
    n_blocks = min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())
    lanes = [mask.alias(f"_lane{i}") for i, mask in enumerate(_masks(F.col(key)))]
    filled = listed.select(_block(F.col(key), n_blocks).alias("_block"), *lanes)
    return filled.groupBy("_block").agg(*[F.bit_or(f"_lane{i}").alias(f"_lane{i}") for i in range(LANES)]), n_blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by the rules, else by the list.

    ``listed`` has one column of canonical URLs to block; repeats and NULLs in it are ignored. The
    result has page_id, host, path, rule, verdict, canonical, listed; one row per input row, so
    repeated rows stay. NULL or hostless URLs fit no rule and are on no list: they are allowed.
    """
    name = listed.columns[0]
    keys = stage(listed.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("_key")).distinct(), "urls")
    blocks, n_blocks = bloom_filter(keys, "_key", row_count(keys))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(host, path, rules)
    judged = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        rule.alias("rule"),
        verdict.alias("_ruled"),
        canonical_url(F.col("url")).alias("canonical"),
    )
    probed = judged.withColumn("_block", _block(F.col("canonical"), n_blocks)).join(F.broadcast(blocks), "_block", "left")
    hit = F.lit(True)
    for lane, mask in enumerate(_masks(F.col("canonical"))):
        hit = hit & (F.col(f"_lane{lane}").bitwiseAND(mask) == mask)
    hit = F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False))
    columns = [*judged.columns]
    missed = probed.where(~hit).select(*columns, F.lit(False).alias("listed"))
    found = (
        probed.where(hit)
        .select(*columns)
        .join(keys, F.col("canonical") == F.col("_key"), "left")
        .select(*columns, F.col("_key").isNotNull().alias("listed"))
    )
    by_list = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return missed.unionByName(found).select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", by_list).alias("verdict"), "canonical", "listed"
    )


def crawled_twice(pages: DataFrame) -> DataFrame:
    """Canonical URLs under which more than one page was fetched: the list that the query blocks."""
    canonical = pages.select(canonical_url(F.col("url")).alias("canonical")).where(F.col("canonical").isNotNull())
    return canonical.groupBy("canonical").count().where(F.col("count") > 1).select("canonical")
