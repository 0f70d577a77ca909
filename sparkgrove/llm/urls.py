"""URL filters: longest-suffix rules, then a Bloom filter cascade that gives exact membership without a join.

The cascade is built over the corpus's complete key universe: level 0 encodes the listed keys, level 1 the universe's keys
that level 0 wrongly accepts, level 2 the listed keys that level 1 wrongly accepts, and so on until no error is left. A
key of the universe is listed exactly if the first level that refuses it is odd. Keys whose levels would take more than MAX_BITS
are dealt into shards by hash, each with a cascade of its own; rows are then judged shard by shard, so an executor holds
the bits of one shard at a time. Ties cannot occur: a key is listed or not, and of equally long rules only one fits a url.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bits that each key of a level gets, and hash functions: a level wrongly accepts about 2 % of the keys it should refuse.
BITS, HASHES = 8, 4
#: Bits of all levels of a shard, which are broadcast, at most: 64 MB. More keys make more shards.
MAX_BITS = 1 << 29
#: The hosts that count as listed hold one of these words between dots and hyphens.
LISTED_WORDS = ("adult", "bets", "bet", "casino", "gambling", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "xxx")
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url) -> F.Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null url or no `://`: empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    """What follows the host up to `?`, `#` or the end; null url or no `://`: empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule (by host, then path) as `host/path` text and its verdict; null and null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return text, verdict


def _slots(bits: int, level: int) -> F.Column:
    """The HASHES bit positions of column `key` at a level, by double hashing of one 64-bit hash."""
    h = _hash(level, F.col("key"))
    a, b = F.shiftrightunsigned(h, 32), h.bitwiseAND(0xFFFFFFFF).bitwiseOR(1)
    return F.array(*[F.pmod(a + i * b, F.lit(bits)) for i in range(HASHES)])


class Cascade:
    """Levels (bits, bytes) of a built cascade of one shard; each has its own broadcast."""

    def __init__(self, levels: list[tuple[int, bytes]]):
        self.levels = levels

    @property
    def bits(self) -> int:
        return sum(n for n, _ in self.levels)

    def holds(self, key) -> F.Column:
        """Exact membership of a string column's value, if it is in the universe: an Arrow batch at a time; null: false."""
        if not self.levels:
            return F.lit(False)
        held = SparkSession.active().sparkContext.broadcast(self.levels)

        @F.pandas_udf("boolean")
        def probe(hashes: pd.Series) -> pd.Series:
            h = np.stack(hashes.to_numpy()) if len(hashes) else np.zeros((0, 1), np.int64)
            levels = held.value
            out, open_ = np.full(len(h), len(levels) % 2 == 1), np.ones(len(h), bool)  # what every level accepts
            for i, (bits, raw) in enumerate(levels):
                refused = open_ & ~_accepted(h[:, i], bits, np.frombuffer(raw, np.uint8))
                out[refused] = i % 2 == 1
                open_ &= ~refused
            return pd.Series(out)

        return F.when(key.isNull(), F.lit(False)).otherwise(probe(F.array(*[_hash(i, key) for i in range(len(self.levels))])))

    def accepts_last(self, key) -> F.Column:
        """Whether the last level accepts a key, right or wrong."""
        held, level = SparkSession.active().sparkContext.broadcast(self.levels[-1]), len(self.levels) - 1

        @F.pandas_udf("boolean")
        def probe(h: pd.Series) -> pd.Series:
            bits, raw = held.value
            return pd.Series(_accepted(h.to_numpy(), bits, np.frombuffer(raw, np.uint8)))

        return probe(_hash(level, key))


class Sharded:
    """Cascades of keys that are dealt by hash."""

    def __init__(self, shards: list[Cascade]):
        self.shards = shards

    @property
    def levels(self) -> list[tuple[int, bytes]]:
        return [level for shard in self.shards for level in shard.levels]

    def holds(self, key) -> F.Column:
        """Exact membership, as in Cascade; the bits of all shards are broadcast, so judge() takes them one by one."""
        out = F.lit(False)
        for i, shard in enumerate(self.shards):
            out = F.when(_shard(key, len(self.shards)) == i, shard.holds(key)).otherwise(out)
        return F.when(key.isNull(), F.lit(False)).otherwise(out)

    def marked(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with `name`: whether the key is listed. One pass over df for each shard."""
        n = len(self.shards)
        if n == 1:
            return df.withColumn(name, self.shards[0].holds(F.col(key)))
        at = F.coalesce(_shard(F.col(key), n), F.lit(0))
        parts = [df.where(at == i).withColumn(name, shard.holds(F.col(key))) for i, shard in enumerate(self.shards)]
        return functools.reduce(DataFrame.unionByName, parts)


def _hash(level: int, key) -> F.Column:
    return F.xxhash64(F.lit(level), key)


def _shard(key, n: int) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(n)).cast("int")


def _accepted(h: np.ndarray, bits: int, raw: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set: the slots of _slots()."""
    h = h.astype(np.int64).view(np.uint64)
    a, b = (h >> np.uint64(32)).astype(np.int64), ((h & np.uint64(0xFFFFFFFF)) | np.uint64(1)).astype(np.int64)
    yes = np.ones(len(h), bool)
    for i in range(HASHES):
        at = (a + i * b) % bits
        yes &= (raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return yes


def _level(keys: DataFrame, count: int, level: int) -> tuple[int, bytes]:
    """The bitmap of one level: tasks set bits in blocks of 4,096, which aggregate by OR."""
    bits = max(64, 8 * -(-count * BITS // 8))
    slot = keys.select(F.explode(_slots(bits, level)).alias("s")).groupBy("s").agg(F.lit(1).alias("one"))
    blocks = slot.groupBy(F.floor(F.col("s") / 4096).cast("long").alias("w")).agg(F.bitmap_construct_agg(F.col("s") % 4096).alias("m")).collect()  # bits / 4,096 rows
    out = bytearray(bits // 8 + 512)
    for r in blocks:
        out[r["w"] * 512 : r["w"] * 512 + 512] = bytes(r["m"])[:512]
    return bits, bytes(out[: bits // 8])


def build(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Sharded:
    """The cascades of `listed` (key) over `universe` (key). Null keys are left out; listed keys outside it are added to it.

    An empty list gives a cascade that refuses all. Where a shard's levels need more than max_bits, all keys are dealt into twice as many
    shards, until every shard fits.
    """
    listed = listed.select("key").where("key is not null").distinct()
    other = cut(universe.select("key").where("key is not null").distinct().join(listed, "key", "left_anti"))
    yes = cut(listed)
    n = 1
    while True:
        shards = []
        for i in range(n):
            mine = _shard(F.col("key"), n) == i
            shard = _cascade(yes.where(mine), other.where(mine), max_bits)
            if shard is None:
                break
            shards.append(shard)
        if len(shards) == n:
            return Sharded(shards)
        n *= 2


def _cascade(yes: DataFrame, other: DataFrame, max_bits: int) -> Cascade | None:
    """The cascade of one shard; None if its levels need more than max_bits."""
    levels: list[tuple[int, bytes]] = []
    sides = [yes, other]
    while True:
        level = len(levels)
        keys = sides[level % 2]
        count = keys.count()
        if not count:
            return Cascade(levels)
        if level and sum(n for n, _ in levels) + count * BITS > max_bits or not level and count * BITS > max_bits and count > 1:
            return None
        levels.append(_level(keys, count, level))
        wrong = sides[1 - level % 2]
        sides[1 - level % 2] = cut(wrong.where(Cascade(levels).accepts_last(F.col("key"))))


def listed_hosts(hosts: DataFrame, words_=LISTED_WORDS) -> DataFrame:
    """The keys of a host list: hosts (key) with a listed word between dots and hyphens."""
    return hosts.where(F.exists(F.split("key", r"[.\-]"), lambda x: x.isin(*words_)))


def judge(df: DataFrame, cascade: Sharded, url: str = "url", rules=RULES) -> DataFrame:
    """df with host, path, rule and verdict: the longest rule's verdict, else block if the host is listed, else allow.

    Null, empty and odd urls have empty host and path, fit no rule and are allowed. Columns of df with these names are
    replaced. Row-wise: no join, no shuffle.
    """
    host, path = host_of(df[url]), path_of(df[url])
    out = df.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    (listed,) = fresh(out, "listed")
    out = cascade.marked(out.withColumns({"rule": rule, "verdict": verdict}), "host", listed)
    method = F.when(F.col(listed), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("verdict", method)).drop(listed)
