"""URL filter: rules compiled into one projection, and a cascade of Bloom filters for listed hosts.

The cascade answers "is this key listed?" without a join and without error for
every key of the corpus. Level 1 encodes the listed keys; level 2 the unlisted
keys of the corpus that pass level 1; level 3 the listed keys that pass level 2;
and so on, until a level lets nothing wrong through. All levels are built from
distinct keys by distributed aggregation (the bits of a word are combined before
the shuffle); the words of a level come to the driver and go into the projection
as one literal.

A level takes `LEVEL_BYTES` bytes at most. Keys are dealt by hash into as many shards
as that takes (one for some millions of listed hosts), each with a cascade of its own,
and the pages are judged by one shard after the other, in one projection each, so the
method and its result are the same for a list of any length; a longer list takes
more passes over the pages.

Defined results
* host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
  end, with A-Z in lower case; path: what follows, up to ``?``, ``#`` or the
  end. Null, or no ``://``: both are empty;
* an empty host is never listed, so such a row is allowed unless a rule fits;
* listed keys are trimmed of spaces, and A-Z is taken in lower case; null and empty ones
  list nothing;
* nulls elsewhere, repeated rows and extra columns are carried through; the
  verdict is one struct column, ``out``, which replaces a column of that name;
* empty table in, empty table out; with an empty list nothing is listed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.common import pin
from papyrion.session import stage

# The rules of the production query, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Hosts of unwanted trade; a listed host stands for its subdomains too.
LISTED_HOSTS = tuple(
    f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org")
)

#: The words of one level take this many bytes of a plan, at most.
LEVEL_BYTES = 4 << 20
#: More levels than this do not occur unless hashing is broken: each halves what is left.
MAX_LEVELS = 64

_WORD_BITS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, labels: int) -> Column:
    """The last 1..``labels`` labels of a host. No listed key has more, so no more can match."""
    parts = F.split(host, "\\.")
    n = F.least(F.size(parts), F.lit(labels))
    return F.when(
        (F.lit(labels) > 0) & (host != ""),
        F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), ".")),
    ).otherwise(F.array().cast("array<string>"))


def _positions(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(hashes)]


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: tuple[int, ...] = field(repr=False)

    def contains(self, key: Column) -> Column:
        # A constant cast of a constant string: the optimiser folds it into one array literal.
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        places = F.array(*_positions(key, self.number, self.hashes, self.bits))
        return F.forall(places, lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(_WORD_BITS - 1)).cast("int")) == 1)


@dataclass(frozen=True)
class Cascade:
    """Exact for every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        # Passing all levels means what the last one encodes: listed keys at odd levels.
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.contains(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def _sized(n: int, p: float) -> tuple[int, int]:
    bits = max(_WORD_BITS, math.ceil(-n * math.log(p) / math.log(2) ** 2 / _WORD_BITS) * _WORD_BITS)
    return bits, max(1, round(bits / n * math.log(2)))


def _level(number: int, keys: DataFrame, n: int, p: float) -> Level:
    bits, hashes = _sized(n, p)
    made = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), number, hashes, bits))).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word"))
    )
    words = [0] * (bits // _WORD_BITS)
    for row in made.collect():  # at most bits / 64 rows, which the number of shards keeps below LEVEL_BYTES / 8
        words[row["at"]] = row["word"]
    return Level(number, bits, hashes, tuple(words))


def _cascade(inside: DataFrame, outside: DataFrame, n: int, p: float) -> Cascade:
    """Over the keys ``inside`` (``n`` of them) and ``outside``, distinct and apart."""
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade does not end")
        level = _level(len(levels) + 1, inside, n, p)
        levels.append(level)
        wrong = stage(outside.where(level.contains(F.col("key"))), f"cascade-level-{level.number}")
        inside, outside, n, p = wrong, inside, wrong.count(), 0.5
    return Cascade(tuple(levels))


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(shards))


def build_cascades(listed: DataFrame, universe: DataFrame, first: float | None = None, level_bytes: int = LEVEL_BYTES) -> list[Cascade]:
    """One cascade for each shard of the keys; ``listed`` and ``universe`` have one column ``key``, which may repeat and be null.

    ``first`` is the false-positive rate of level 1; by default it leaves about
    as many false positives as there are listed keys. All further levels use 1/2.
    """
    inside = stage(listed.where(F.col("key").isNotNull()).distinct(), "cascade-listed")
    outside = stage(universe.where(F.col("key").isNotNull()).distinct().join(inside, "key", "left_anti"), "cascade-others")
    n, others = inside.count(), outside.count()
    p = first or min(0.5, max(1e-9, n / max(others, 1) / math.sqrt(2)))
    # Half a level is left free, as shards are not quite equal and level 2 may be larger than planned.
    shards = max(1, math.ceil(_sized(n, p)[0] / 4 / level_bytes)) if n else 1
    if shards == 1:
        return [_cascade(inside, outside, n, p)]
    own = F.col("shard")
    inside, outside = (stage(x.select("key", shard(F.col("key"), shards).alias("shard")), "cascade-shards", ["shard"]) for x in (inside, outside))
    counts = {r["shard"]: r["count"] for r in inside.groupBy("shard").count().collect()}  # one row a shard
    return [_cascade(inside.where(own == k).select("key"), outside.where(own == k).select("key"), counts.get(k, 0), p) for k in range(shards)]


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", out: str = "url_verdict", rules=RULES, level_bytes: int = LEVEL_BYTES) -> DataFrame:
    """``pages`` with a struct of host, path, rule, listed and verdict.

    ``listed`` has one column ``key`` of host names. The longest rule that fits
    decides; without one, a listed host (or a subdomain of one) is blocked.
    """
    listed = listed.select(F.translate(F.trim(F.col("key").cast("string")), _UPPER, _LOWER).alias("key")).where("key <> ''")
    labels = listed.agg(F.max(F.size(F.split("key", "\\.")))).first()[0] or 0
    names = [c for c in pages.columns if c != out]
    df = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{url}`").cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    df = pin(df, __host=host, __path=path)
    # Hosts first, so that a hot host is one row before its suffixes are spelt out.
    hosts = df.select(F.col("__host").alias("host")).distinct()
    universe = hosts.select(F.explode(suffixes(F.col("host"), labels)).alias("key"))
    cascades = build_cascades(listed, universe, level_bytes=level_bytes)
    df = pin(df, __keys=suffixes(F.col("__host"), labels)).withColumn("__listed", F.lit(False))
    for k, cascade in enumerate(cascades):
        if not cascade.levels:
            continue
        mine = F.filter("__keys", lambda x: shard(x, len(cascades)) == k) if len(cascades) > 1 else F.col("__keys")  # noqa: B023
        df = df.withColumn("__listed", F.col("__listed") | F.exists(mine, cascade.contains))
        if k + 1 < len(cascades):  # a plan holds one cascade
            df = stage(df, "judged-by-shard")
    rule = F.lit(None).cast("string")
    decided = F.when(F.col("__listed"), "block").otherwise("allow")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = _fits(F.col("__host"), F.col("__path"), rule_host, rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        decided = F.when(fits, F.lit(verdict)).otherwise(decided)
    made = F.struct(
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        rule.alias("rule"),
        F.col("__listed").alias("listed"),
        decided.alias("verdict"),
    )
    return df.select("__row.*", made.alias(out))


def listed_hosts(spark, hosts=LISTED_HOSTS) -> DataFrame:
    """A short list given in code, as the table that `judge_urls` takes."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, hosts))).alias("key"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, listed_hosts(spark))
    return judged.select("page_id", *[F.col(f"url_verdict.{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


#: DuckDB SQL of the same rows.
OP10_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
rules(verdict, h, s) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
listed AS (SELECT n || '.example.' || t AS k FROM (VALUES ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets')) a(n),
                                                 (VALUES ('com'), ('net'), ('org')) b(t)),
fit AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(rules.verdict, length(h || s)) AS verdict
  FROM p, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id),
bad AS (SELECT DISTINCT host FROM (SELECT DISTINCT host FROM p), listed WHERE host = k OR ends_with(host, '.' || k))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit ON fit.page_id = p.page_id LEFT JOIN bad ON bad.host = p.host
"""
