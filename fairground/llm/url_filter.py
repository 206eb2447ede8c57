"""URL filtering by explicit rules, then by a Bloom filter cascade over hosts.

The cascade gives exact membership of a listed key within the corpus's own key universe: the first
filter encodes the listed keys, the second the unlisted keys that the first lets through, the third the
listed keys that the second lets through, and so on until nothing is wrongly let through.  A key is
listed if the first level that rejects it is an even one (counting from 1).

Keys are dealt by hash into segments of about ``SEGMENT_KEYS`` distinct keys, and each task builds the
cascade of one segment.  Listed keys whose 64-bit hash an unlisted key shares are in no filter: they are kept
beside it as they are (``exact``), so that membership is exact and building ends.  A key that is given both as listed and
as unlisted is listed.  The finished cascades are broadcast only if their measured size is at most ``BROADCAST_BYTES``;
beyond that rows meet their segment's cascade in groups of at most about ``GROUP_ROWS``, a hot segment in many.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
cascade as the empty key (unlisted).  Repeated rows each get their verdict; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairground.llm._shared import cut, table
from fairground.llm._words import Block, utf8

#: (verdict, host, path).  Fixed values of the task.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: The parts of hosts (split at dots and hyphens) that the query lists; ``listed_hosts`` takes any table of such words.
UNWANTED = ["ads", "adult", "bets", "casino", "pills", "spam"]
GROUP_ROWS = 100_000
SEGMENT_KEYS = 20_000
BROADCAST_BYTES = 32 << 20
BITS_A_KEY = 8
HASHES = 4


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def _key_hashes(keys) -> np.ndarray:
    data, offsets = utf8(pa.array(keys, pa.string()))
    offsets = offsets - offsets[0]
    return Block(data, offsets).hashes(offsets[:-1], offsets[1:])


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    salt = hashes * np.uint64(2 * level + 3) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    salt ^= salt >> np.uint64(29)
    return ((salt[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(16)) % np.uint64(bits)


def _holds(level: int, packed: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    return bits[_positions(hashes, level, len(bits))].all(axis=1)


def build_levels(listed: np.ndarray, others: np.ndarray) -> list[bytes]:
    """Filters of one segment from the keys' 64-bit hashes, which must differ between the sides."""
    levels, inside, outside = [], listed, others
    while len(inside):
        size = 64 * math.ceil(max(64, BITS_A_KEY * len(inside)) / 64)
        bits = np.zeros(size, np.uint8)
        bits[_positions(inside, len(levels), size).ravel()] = 1
        packed = np.packbits(bits).tobytes()
        wrong = outside[_holds(len(levels), packed, outside)] if len(outside) else outside
        levels.append(packed)
        inside, outside = wrong, inside
    return levels


def build_segment(keys: pd.Series, listed: np.ndarray) -> tuple[list[bytes], list[str]]:
    """(levels, exact) of the distinct keys of one segment."""
    hashes = _key_hashes(keys)
    shared = np.isin(hashes, np.intersect1d(hashes[listed], hashes[~listed]))
    return build_levels(hashes[listed & ~shared], hashes[~listed & ~shared]), keys[listed & shared].tolist()


def members(levels: list[bytes], hashes: np.ndarray) -> np.ndarray:
    listed = np.full(len(hashes), len(levels) % 2 == 1)
    undecided = np.arange(len(hashes))
    for k, packed in enumerate(levels):
        held = _holds(k, packed, hashes[undecided])
        listed[undecided[~held]] = k % 2 == 1
        undecided = undecided[held]
    return listed


def listed_in(levels: list[bytes], exact: list[str], keys: pd.Series) -> np.ndarray:
    """Which of the keys, all of the universe, a segment lists."""
    hashes = _key_hashes(keys)
    found = members(levels, hashes)
    if len(exact):
        unsure = np.isin(hashes, _key_hashes(exact))
        found[unsure] = keys[unsure].isin(exact)
    return found


def build_cascade(keys: DataFrame, segments: int) -> DataFrame:
    """(segment, levels, exact) from the universe (key, listed)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        levels, exact = build_segment(group["key"], group["listed"].to_numpy(bool))
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "levels": [levels], "exact": [exact]})

    keys = keys.groupBy("key").agg(F.max("listed").alias("listed"))
    return keys.withColumn("segment", segment_of(F.col("key"), segments)).groupBy("segment").applyInPandas(build, "segment int, levels array<binary>, exact array<string>")


def segment_of(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def unwanted_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in UNWANTED], "word string")


def listed_hosts(pages: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(key, listed): the universe of hosts, and whether one of the words (by default ``unwanted_words``) is among a host's parts."""
    words = (unwanted_words(pages.sparkSession) if words is None else words).select("word").distinct()
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.select("key", F.explode(F.split("key", r"[.-]")).alias("word")).join(words, "word", "left_semi").select("key").distinct().withColumn("found", F.lit(True))
    return hosts.join(listed, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, keys: DataFrame | None = None, rules=RULES, segment_keys: int = SEGMENT_KEYS, broadcast_bytes: int = BROADCAST_BYTES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict); ``keys`` (key, listed) is the universe, by default ``listed_hosts``."""
    keys = cut(listed_hosts(pages) if keys is None else keys)
    segments = max(1, math.ceil(keys.count() / segment_keys))
    cascade = cut(build_cascade(keys, segments))
    size = cascade.agg(F.sum(F.expr("aggregate(levels, 0L, (n, x) -> n + length(x) + 64) + aggregate(exact, 0L, (n, x) -> n + octet_length(x) + 64)"))).first()[0] or 0

    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", fit.getField("rule").alias("rule"), fit.getField("verdict").alias("ruled"), segment_of(F.col("host"), segments).alias("segment"))

    if size <= broadcast_bytes:
        known = pages.sparkSession.sparkContext.broadcast({r.segment: ([bytes(x) for x in r.levels], list(r.exact)) for r in cascade.collect()})

        @F.pandas_udf("boolean")
        def listed(host: pd.Series, segment: pd.Series) -> pd.Series:
            out = np.zeros(len(host), bool)
            for s in segment.unique():
                at = np.flatnonzero(segment == s)
                out[at] = listed_in(*known.value.get(s, ([], [])), host.iloc[at])
            return pd.Series(out)

        judged = judged.withColumn("listed", listed("host", "segment"))
    else:
        # Hosts repeat, so each segment's distinct hosts are few; rows are split only where their segment has many.
        shares = judged.groupBy("segment").agg(F.ceil(F.count("*") / group_rows).alias("shares"))
        salted = judged.join(shares, "segment").withColumn("share", F.pmod(F.xxhash64("page_id", "path"), F.col("shares")))
        filters = cascade.join(shares, "segment").withColumn("share", F.explode(F.expr("sequence(0L, shares - 1)"))).select("segment", "share", "levels", "exact")

        def decide(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
            known = ([bytes(x) for x in filters["levels"].iloc[0]], list(filters["exact"].iloc[0])) if len(filters) else ([], [])
            return rows[["page_id", "host", "path", "rule", "ruled"]].assign(listed=listed_in(*known, rows["host"]))

        judged = salted.groupBy("segment", "share").cogroup(filters.groupBy("segment", "share")).applyInPandas(decide, "page_id long, host string, path string, rule string, ruled string, listed boolean")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(verdict, rule, h, p) as (values ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
                                  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
f as (select page_id, host, path, rule, verdict, row_number() over (partition by u.page_id, u.host, u.path, u.n order by length(rule) desc) as k
      from (select *, row_number() over () as n from u) u left join r on (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p))
select page_id, host, path, rule, coalesce(verdict, case when len(list_intersect(regexp_split_to_array(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'spam'])) > 0 then 'block' else 'allow' end) as verdict
from f where k = 1
"""
