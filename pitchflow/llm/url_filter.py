"""URL rules: a blocked Bloom filter of listed URLs in front of an exact hash join.

A listed URL is a host and the start of a path; it fits that host and its subdomains. A page's
candidates are its host's suffixes joined to the prefixes of its path that are as long as some listed
path, so their number depends on the list's shapes and not on its length. The Bloom filter holds the
listed URLs and their hosts: a page none of whose suffixes passes is judged where it is, and only the
suffixes that pass are tried with prefixes. What passes as a whole goes to a hash join with the list,
which removes false positives.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, join_counted

#: Bits and probes for each listed URL; the filter is one BIGINT array whose elements are its blocks.
BITS_PER_URL, PROBES, BLOCK_BITS = 16, 5, 64
#: The filter is sent to every executor, so it has at most so many bytes; a longer list gets fewer bits for each URL,
#: and more candidates reach the exact join.
MAX_FILTER_BYTES = 16 << 20
#: Blocks that are put in order together while the filter is built.
CHUNK = 4096
#: A list of at most so many bytes is joined where the pages are.
SHORT_LIST = 16 << 20
RESULT = ("host", "path", "rule", "verdict")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url) -> tuple:
    """Host (after the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased) and path (then up to ``?`` or ``#``)."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key):
    """The probe bits of a key inside its block."""
    h = F.xxhash64(key, F.lit(1))
    return reduce(lambda a, b: a.bitwiseOR(b), [_shift(h, i) for i in range(PROBES)])


def _shift(h, i: int):
    place = F.shiftright(h, 6 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def blocked_bloom(keys: DataFrame, n: int):
    """The filter of ``keys(key)``, about ``n`` of them, as a scalar array of 64-bit blocks, and their number."""
    blocks = max(1, min(MAX_FILTER_BYTES // 8, math.ceil(n * BITS_PER_URL / BLOCK_BITS)))
    filled = keys.select(_block(F.col("key"), blocks).cast("bigint").alias("block"), _mask(F.col("key")).alias("mask"))
    empty = keys.sparkSession.range(blocks).select(F.col("id").alias("block"), F.lit(0).cast("bigint").alias("mask"))
    dense = filled.unionByName(empty).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    in_order = lambda by, what: F.transform(F.sort_array(F.collect_list(F.struct(by, what))), lambda x: x[what])
    parts = dense.groupBy(F.expr(f"block div {CHUNK}").alias("chunk")).agg(in_order("block", "mask").alias("words"))
    return parts.agg(F.flatten(in_order("chunk", "words")).alias("words")), blocks


def may_hold(bloom, blocks: int, key):
    """Whether the filter's key may be ``key``; never false for one that is."""
    return F.element_at(bloom, _block(key, blocks) + 1).bitwiseAND(_mask(key)) == _mask(key)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """Judges each page by ``rules(host, path, verdict)``.

    Returns the columns ``keep`` and ``host``, ``path``, ``rule`` (host and path of the longest rule
    that fits, or null) and ``verdict`` (the rule's, else ``default``: the URL is not listed), one row
    per input row.

    * A null URL or one without ``://`` has an empty host and path and fits no rule with a host.
    * Among rules that fit, the longest host and path together wins, then the longer host. Repeated
      rules count once; if they disagree the verdict that sorts last holds. Rules with a null are left out.
    * Columns of the four result names in ``keep`` are replaced; other columns of ``pages`` aren't read.
    * An empty list gives every page the default; an empty table gives an empty result.
    """
    host, path = canonical(F.col(url_col).cast("string"))
    keep = tuple(c for c in keep if c not in RESULT)
    urls = pages.select(F.struct(*keep, F.lit(0).alias("_")).alias("page"), host.alias("host"), path.alias("path"))
    out = lambda df, rule, verdict: df.select(*(F.col(f"page.`{c}`") for c in keep), "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    unlisted = (F.lit(None).cast("string"), F.lit(default))
    listed = rules.dropna(subset=["host", "path", "verdict"])
    shape = listed.agg(F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path") + 48).alias("bytes"), F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels")).first()
    if not shape["n"]:
        return out(urls, *unlisted)
    listed = listed.withColumns({"key": F.concat("host", "path"), "host_len": F.length("host")}).select("key", "host_len", "host", "verdict")
    keys = listed.select("key").unionByName(listed.select(F.col("host").alias("key"))).distinct()
    listed = listed.groupBy("key", "host_len").agg(F.max("verdict").alias("verdict"))
    words, blocks = blocked_bloom(keys, 2 * shape["n"])
    bloom = words.scalar()

    labels = F.size(F.split("host", r"\."))
    suffix = {k: F.substring_index("host", ".", -k) for k in sorted(shape["labels"])}  # a host has at most 127 labels
    known = F.array_compact(F.array(*(F.when((labels >= k) & may_hold(bloom, blocks, x), x) for k, x in suffix.items())))
    # Written, so that the number of a page with a listed host stays its own.
    tried = Table(urls.withColumns({"hosts": known, "row": F.monotonically_increasing_id()}), "urls").df
    some = tried.filter(F.size("hosts") > 0)
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape["paths"]))))
    pairs = F.flatten(F.transform("hosts", lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("key"), F.length(s).alias("host_len")))))
    hits = some.select("row", F.explode(pairs).alias("c")).select("row", "c.*").filter(may_hold(bloom, blocks, F.col("key")))
    if shape["bytes"] <= SHORT_LIST:
        exact = hits.join(F.broadcast(listed), ["key", "host_len"])
    else:  # a listed URL may be that of many pages
        exact = join_counted(hits, hits.groupBy("key", "host_len").agg(F.count("*").alias("n")).join(listed, ["key", "host_len"]), ["key", "host_len"], "n")
    best = exact.groupBy("row").agg(F.max(F.struct(F.length("key").alias("len"), "host_len", "key", "verdict")).alias("best"))
    judged = out(some.join(best, "row", "left"), F.col("best.key"), F.coalesce("best.verdict", unlisted[1]))
    return out(tried.filter(F.size("hosts") == 0), *unlisted).unionByName(judged)
