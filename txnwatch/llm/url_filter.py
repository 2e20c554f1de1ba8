"""URL filters by a Bloom filter cascade [DataFrame functions only].

A rule or listed entry is a key: host + path prefix (``example.net/en/``, or a bare
host).  A URL's possible keys are its host and parent domains, each with the path
prefixes of the lengths that listed keys have.  All possible keys of all URLs are
the universe.  Level 0 of a cascade holds the listed keys, level 1 the universe's
false positives of level 0, level 2 the listed keys that level 1 lets through by
mistake, and so on until a level makes no mistake: on the universe the first level
that rejects a key tells exactly whether it is listed, and no row is joined.

A level takes about 1.44 * log2(1/p) bits a key; level 0's p is chosen so that about
as many false positives remain as keys are listed.  The levels are literals of the
plan, so their total is checked against ``max_bits``; a larger list is looked up by
a semi join on the exploded keys instead, with the same result.

A URL that is null or has no ``://`` has an empty host and path and fits no rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import free_name, table, written

MAX_BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Hosts (with their subdomains) that the method blocks where no rule speaks.
BLOCKED_HOSTS = ("ads-track.example.com", "ads-track.example.net", "ads-track.example.org")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_key(key: str) -> tuple[str, str]:
    host, slash, path = key.partition("/")
    return host.lower(), slash + path


def possible_keys(host: Column, path: Column, listed: list[str]) -> Column:
    """The keys of a URL that could be listed: domain depths and prefix lengths as in the list."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p in map(split_key, listed)})
    labels = F.split(host, r"\.")
    each = [F.when((F.size(labels) >= d) & (F.char_length(path) >= n) & (host != ""),
                   F.concat(F.array_join(F.slice(labels, -d, d), "."), F.substring(path, 1, n))) for d, n in shapes]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")     # folds to a literal
        tests = [F.call_function("getbit", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
                 for p in positions(key, self.bits, self.hashes, self.seed)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 1000 + j), key), F.lit(bits)) for j in range(hashes)]


def shape(keys: int, others: int) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for ``keys`` keys, leaving about that many of ``others``."""
    p = min(0.5, max(keys, 1) / max(others, 1))
    hashes = max(1, round(math.log2(1 / p)))
    return max(64, -(-math.ceil(1.4427 * max(keys, 1) * hashes) // 64) * 64), hashes


def _level(keys: DataFrame, n: int, others: int, seed: int) -> Level:
    bits, hashes = shape(n, others)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    set_bits = at.select(F.shiftright("p", 6).cast("int").alias("w"),
                         F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = dict(set_bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect())        # at most bits / 64 rows
    return Level(bits, hashes, seed, tuple(found.get(w, 0) for w in range(bits // 64)))


class TooLarge(Exception):
    """The cascade would not fit ``max_bits``."""


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> list[Level]:
    """Levels that tell exactly which ``key`` of ``universe`` is one of ``listed`` (both distinct)."""
    member = written(universe.join(listed.withColumn("is_listed", F.lit(True)), "key", "left")
                     .select("key", F.coalesce("is_listed", F.lit(False)).alias("is_listed")), "url-universe")
    inside, outside = member.where("is_listed").select("key"), member.where(~F.col("is_listed")).select("key")
    levels: list[Level] = []
    n_in, n_out, used = inside.count(), outside.count(), 0
    while n_in:
        used += shape(n_in, n_out)[0]
        if used > max_bits:
            raise TooLarge(used)
        levels.append(_level(inside, n_in, n_out, seed=len(levels)))
        passed = outside.where(levels[-1].has(F.col("key")))
        inside, outside, n_in, n_out = passed, inside, passed.count(), n_in
    return levels


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that rejects it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(df: DataFrame, url: str = "url", rules: dict | None = None, blocked=BLOCKED_HOSTS,
                max_bits: int = MAX_BITS, out: str = "u") -> DataFrame:
    """``df`` and one struct column ``out`` (under a longer name where ``df`` has that one): host,
    path, rule (or null), verdict.

    The longest rule that fits a URL decides; without one, ``block`` if a key of
    ``blocked`` fits, else ``allow``.  Rule hosts are compared in lower case.
    """
    rules, out = RULES if rules is None else rules, free_name(df, out)
    named = {"".join(split_key(k)): k for k in rules}
    blocked = sorted({"".join(split_key(k)) for k in blocked} - set(named))
    keys = [*named, *blocked]
    spark = df.sparkSession
    parts = df.withColumn(out, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    host, path = F.col(out)["host"], F.col(out)["path"]
    universe = parts.select(F.explode(possible_keys(host, path, keys)).alias("key")).distinct()
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    try:
        levels = build_cascade(universe, listed, max_bits)
        hits, rows = F.filter(possible_keys(host, path, keys), lambda k: in_cascade(levels, k)), parts
    except TooLarge:
        hits_name, row = free_name(df, "hits"), free_name(df, "row")
        numbered = written(parts.withColumn(row, F.monotonically_increasing_id()), "url-rows")      # stored once with its key
        found = numbered.select(row, F.explode(possible_keys(host, path, keys)).alias("key")) \
            .join(listed, "key", "left_semi").groupBy(row).agg(F.collect_list("key").alias(hits_name))
        rows = numbered.join(found, row, "left")
        hits = F.coalesce(F.col(hits_name), F.array().cast("array<string>"))
    action = F.create_map(*[F.lit(x) for k in named for x in (k, named[k] + "\t" + rules[named[k]])]) if named else None

    def longest(found):
        if action is None:
            return F.lit(None).cast("string")
        ruled = F.filter(F.transform(found, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))),
                         lambda x: F.map_contains_key(action, x["k"]))
        return F.element_at(action, F.get(F.sort_array(ruled, asc=False), 0)["k"])

    def decide(found):
        rule = longest(found)
        other = F.when(F.size(found) > 0, F.lit("block")).otherwise(F.lit("allow"))
        return F.struct(host.alias("host"), path.alias("path"), F.split_part(rule, F.lit("\t"), F.lit(1)).alias("rule"),
                        F.coalesce(F.split_part(rule, F.lit("\t"), F.lit(2)), other).alias("verdict"))

    judged = rows.withColumn(out, F.element_at(F.transform(F.array(hits), decide), 1))
    return judged.select(*df.columns, out)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "u.*")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, '(^|\.)ads-track\.example\.(com|net|org)$') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
