"""URL filter by a Bloom filter cascade over the corpus's complete key universe.

Keys: a rule (host, path) fits a host and its subdomains and paths that start with its
path. A URL's keys are all its host suffixes and path prefixes of the shapes (number of
labels, path length) that occur in the rules; the universe is every distinct key of
every URL. Level 0 of the cascade encodes the listed keys, level 1 the keys of the
universe that pass level 0 without being listed, level 2 the listed keys that pass
level 1, and so on until a level has no wrong keys left. A key is listed exactly when
the number of levels it passes before the first miss is odd, so membership is exact
for every key of the universe and the lookup needs no join: filters are bit arrays held
as literals, whose size is bounded by `max_bits`.

Null URLs and URLs without `://` have empty host and path and no rule. Repeated rows
are judged one by one. Only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm.common import lower_ascii, materialize, query, table

#: Fixed rules of the registered query: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
         ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def shapes(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, int]]:
    return sorted({(host.count(".") + 1, len(path)) for _, host, path in rules})


def url_keys(host: Column, path: Column, shape: Sequence[tuple[int, int]]) -> Column:
    """Array of the distinct keys of a URL, host suffix and path prefix side by side, of the given shapes."""
    return F.array_distinct(F.array(*[
        F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length) if length else F.lit(""))
        for labels, length in shape]))


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


class Level:
    """One Bloom filter: `bits` is a list of longs of 64 bits each."""

    def __init__(self, keys: DataFrame, seed: int, per_key: int, hashes: int, max_bits: int):
        count = keys.count()
        self.seed, self.hashes = seed, hashes
        self.size = max(64, count * per_key)
        if self.size > max_bits:
            raise ValueError(f"{count} keys need {self.size} bits; max_bits is {max_bits}")
        at = F.explode(F.array(*self.places(F.col("key"))))
        words = keys.select(at.alias("p")).groupBy((F.col("p").cast("long") / 64).cast("int").alias("w")).agg(
            F.bit_or(bit(F.col("p"))).alias("v"))
        bits = [0] * (self.size // 64 + 1)
        for row in words.collect():  # at most max_bits / 64 rows
            bits[row.w] = row.v
        self.bits = F.lit(bits).cast("array<bigint>")

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 31 + i), key), F.lit(self.size)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        tests = [F.get(self.bits, (p / 64).cast("int")).bitwiseAND(bit(p)) != 0
                 for p in self.places(key)]
        return reduce(lambda a, b: a & b, tests)


def cascade(listed: DataFrame, universe: DataFrame, first: tuple[int, int] = (8, 3), later: tuple[int, int] = (2, 1),
            max_bits: int = 1 << 25, most: int = 64) -> list[Level]:
    """Levels for the listed keys (column key) that decide every key of the universe (column key, distinct) exactly.

    first, later: bits per key and hash functions of level 0 and of the others.
    """
    levels: list[Level] = []
    inside = materialize(listed.select("key").distinct())
    if inside.isEmpty():
        return levels
    outside = None
    for n in range(most):
        levels.append(Level(inside, n, *(later if n else first), max_bits))
        passed = levels[-1].passes(F.col("key"))
        if outside is None:  # the only pass over the universe
            wrong = universe.where(passed).join(inside, "key", "left_anti")
        else:
            wrong = outside.where(passed)
        inside, outside = materialize(wrong), inside
        if inside.isEmpty():
            return levels
    raise RuntimeError("the cascade did not end")


def member(levels: Sequence[Level], key: Column) -> Column:
    """True for listed keys: the first level that misses has an odd number (or none misses and the last is even)."""
    verdict: Column = F.lit(len(levels) % 2 == 1)
    for n, level in reversed(list(enumerate(levels))):
        verdict = F.when(~level.passes(key), F.lit(n % 2 == 1)).otherwise(verdict)
    return verdict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict): the longest fitting rule decides, else `default` for unlisted keys.

    The rules are exact keys: allow and block keys have a cascade each, so every key of a
    URL is known to be allowed, blocked or unlisted; the longest listed key is the rule.
    """
    spark = pages.sparkSession
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       F.col("url").contains("://").alias("_ok"))
    if not rules:
        return cut.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shape = shapes(rules)
    keyed = cut.withColumn("_keys", F.when(F.col("_ok"), url_keys(F.col("host"), F.col("path"), shape)).otherwise(F.array().cast("array<string>")))
    universe = materialize(keyed.select(F.explode("_keys").alias("key")).distinct())
    both = spark.createDataFrame([(v, h + p) for v, h, p in rules], "verdict string, key string")
    sides = {v: cascade(both.where(F.col("verdict") == v), universe) for v in ("allow", "block")}

    def side(key: Column) -> Column:
        return F.when(member(sides["block"], key), F.lit("block")).when(member(sides["allow"], key), F.lit("allow"))

    found = F.filter(F.transform("_keys", lambda k: F.struct(F.length(k).alias("len"), k.alias("key"), side(k).alias("v"))),
                     lambda s: s["v"].isNotNull())
    best = F.array_max(found)
    return keyed.withColumn("_best", best).select(
        "page_id", "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id,
  translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, contains(url, '://') AS ok FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC) AS k
  FROM h, rules WHERE ok AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN (SELECT DISTINCT * FROM m WHERE k = 1) m ON h.page_id IS NOT DISTINCT FROM m.page_id AND h.host = m.host AND h.path = m.path
"""


@query("op6_url_cascade", SQL)
def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
