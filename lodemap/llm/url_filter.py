"""URL rules by a Bloom filter cascade, in DataFrame functions only.

A rule is a host and a path prefix; its key is `host` + path. The candidate keys of a URL are
every suffix of its host by labels with every prefix of its path that is as long as some rule's.
The candidate keys of all pages are the key universe. Level 1 of the cascade encodes the listed
keys; level 2 the keys of the universe that level 1 takes for listed although they aren't; level
3 the listed keys that level 2 takes in; and so on until a level makes no mistake. The first level
that refuses a key decides, so membership is exact for every key of the universe, and no page is
ever joined with the list.

Levels are small: the first is sized so that about as many others pass as keys are listed,
whatever the size of the universe. Their bits travel as literals of the plan.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lodemap.scratch import Scratch

#: Levels after which a build gives up; the expected number grows with the logarithm of the list.
MOST_LEVELS = 40


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


class Level(NamedTuple):
    seed: int
    hashes: int
    bits: int
    words: list[int]  # the bits, 32 to a number

    def has(self, key: Column) -> Column:
        """Whether all bits of the key are set."""
        words = F.lit(self.words)
        tests = []
        for h in range(self.hashes):
            at = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(h), key), F.lit(self.bits))
            word = F.get(words, F.floor(at / 32).cast("int"))
            tests.append(F.getbit(word, (at % 32).cast("int")) == 1)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade(NamedTuple):
    """Levels in order; without levels nothing is listed."""

    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Exact membership of a key of the universe: the first level without it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidates(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Array of (key, host length) of what a rule could be to fit: host suffixes with path prefixes."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."))
    lengths = sorted({len(r.path) for r in rules})
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>"),
        lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(F.concat(h, p).alias("key"), F.length(h).alias("host")))))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of `n` keys with the given rate of false positives; its bits come from one aggregate."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(32, math.ceil(n * hashes / math.log(2)))
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(h), F.col("key")), F.lit(bits)) for h in range(hashes)]))
    words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits")).collect()
    out = [0] * math.ceil(bits / 32)
    for r in words:  # bounded by the size of the filter
        out[r["word"]] = r["bits"]
    return Level(seed, hashes, bits, out)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for the keys of `universe`; only the filters' bits reach the driver.

    Both have a column `key` without repeats or nulls.
    """
    scratch = Scratch(universe.sparkSession, "cascade")
    inside = scratch.table(universe.join(listed, "key", "left_semi"), "inside")
    outside = scratch.table(universe.join(listed, "key", "left_anti"), "outside")
    levels, n, rest = [], inside.count(), outside.count()
    if not n:
        return Cascade([])
    now, other = inside, outside
    rate = min(0.5, n / max(rest, 1) / math.sqrt(2))
    while n:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError(f"{n} keys are still undecided after {MOST_LEVELS} levels")
        level = _level(now, n, rate, len(levels))
        levels.append(level)
        wrong = scratch.table(other.where(level.has(F.col("key"))), f"wrong{len(levels)}")
        now, other, n, rate = wrong, now, wrong.count(), 0.5
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict; rule is null and the verdict `default` where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule
    wins, then the longest host, then `block`. Null, empty and odd URLs have an empty host, which
    no rule fits. Repeated rows get a row each. Columns of these names in `pages` are replaced.
    """
    spark = pages.sparkSession
    host, path = parts(url)
    rows = pages.withColumn("host", host).withColumn("path", path)
    keys = rows.select("host", "path").distinct().select(F.explode(candidates(F.col("host"), F.col("path"), rules)).alias("c")).select("c.key").distinct()
    universe = Scratch(spark, "urls").table(keys, "universe")
    cascades = {v: build(_listed(spark, [r for r in rules if r.verdict == v]), universe) for v in ("allow", "block")}
    fits = F.transform(candidates(F.col("host"), F.col("path"), rules), lambda c: F.struct(
        F.length(c["key"]).alias("n"), c["host"].alias("host"),
        F.when(cascades["block"].lists(c["key"]), F.lit("block")).when(cascades["allow"].lists(c["key"]), F.lit("allow")).alias("verdict"),
        c["key"].alias("rule")))
    best = F.array_max(F.filter(fits, lambda c: c["verdict"].isNotNull()))
    return (rows.withColumn("_best", best).withColumn("rule", F.col("_best.rule"))
            .withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default))).drop("_best"))


def _listed(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    keys = [F.lit(k) for k in sorted({r.key for r in rules})]
    return spark.range(1).select(F.explode(F.array(*keys).cast("array<string>")).alias("key"))
