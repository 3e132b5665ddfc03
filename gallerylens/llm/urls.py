"""URL filters by a Bloom filter cascade.

Level 0 holds the listed keys; level 1 the keys of the corpus that level 0 takes wrongly for listed; level 2
the listed keys that level 1 holds wrongly, and so on until a level errs on no key of the corpus.  Membership
is then exact for every key of the corpus, listed or not, and is looked up without a join.

Keys are dealt to shards by their hash and each shard has a cascade of its own, built in one task; with more
keys there are more shards.  Where all cascades together are larger than a size that may be broadcast, keys
are looked up in groups by shard instead.
"""

from __future__ import annotations

import math
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import kept, stored

#: Fixed rules, (action, host, path prefix); a host without a dot is a top-level domain.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Listed domains; a host is listed when it or a parent domain is.
LISTED = ["casino-bonus.example.com", "cheap-pills.example.com", "spam-farm.example.org", "free-prizes.example.net"]
SHARD_KEYS, BROADCAST_BYTES = 200_000, 32 << 20


def hashed(keys: list[str]) -> np.ndarray:
    """Two numbers of 64 bits for each key."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64).reshape(-1, 2)


class Bloom:
    """A set of hashed keys that may seem to hold a few others."""

    def __init__(self, keys: np.ndarray, seed: int, rate: float) -> None:
        self.seed, self.probes = seed, max(1, round(-math.log2(rate)))
        self.size = max(64, int(len(keys) * self.probes / math.log(2)) + 1)
        on = np.zeros(self.size, bool)
        for at in self._at(keys):
            on[at] = True
        self.bits = np.packbits(on, bitorder="little")

    def _at(self, keys: np.ndarray):
        """The places of all keys, a probe at a time; a level's seed makes them others."""
        a = (keys[:, 0] ^ np.uint64((self.seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
        a, b = a ^ (a >> np.uint64(32)), keys[:, 1] | np.uint64(1)
        for i in range(self.probes):
            yield (a + np.uint64(i) * b) % np.uint64(self.size)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def packed(self) -> tuple:
        return self.seed, self.probes, self.size, self.bits.tobytes()

    @classmethod
    def unpacked(cls, state: tuple) -> Bloom:
        """The bits stay packed."""
        own = cls.__new__(cls)
        own.seed, own.probes, own.size, bits = state
        own.bits = np.frombuffer(bits, np.uint8)
        return own


class Cascade:
    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    @classmethod
    def build(cls, listed: np.ndarray, others: np.ndarray, first: float = 0.1, later: float = 0.5) -> Cascade:
        """Exact for every hashed key of listed and of others, which have none in common."""
        holds, errs, levels = listed, others, []
        while len(holds):
            levels.append(Bloom(holds, len(levels), first if not levels else later))
            holds, errs = errs[levels[-1].holds(errs)], holds
        return cls(levels)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """The last level that holds a key one after another tells: an even one, listed."""
        out, at = np.full(len(keys), len(self.levels) % 2 == 1), np.arange(len(keys))
        for n, level in enumerate(self.levels):
            own = level.holds(keys[at])
            out[at[~own]] = n % 2 == 1
            at = at[own]
        return out

    def dump(self) -> bytes:
        return pickle.dumps([x.packed() for x in self.levels], 5)

    @classmethod
    def load(cls, data: bytes) -> Cascade:
        return cls([Bloom.unpacked(x) for x in pickle.loads(data)])


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _domains(host: Column, longest: int) -> Column:
    """Of the host and its parent domains those of at most longest characters; of a longer host only its end is looked at."""
    labels = F.split(F.right(host, F.lit(longest + 1)), r"\.")
    first = F.when(F.length(host) > longest, 2).otherwise(1)  # a label that is cut off begins no domain
    whole = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.slice(whole, first, F.size(labels))


def build_cascades(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """(shard, cascade) of columns key, stored, and the number of shards, which follows from the keys of both; each key counts once."""
    both = universe.select("key", F.lit(0).alias("l")).unionAll(listed.select("key", F.lit(1))).where("key is not null").groupBy("key").agg(F.max("l").alias("l"))
    both = stored(both, "keys")
    shards = max(1, -(-both.count() // SHARD_KEYS))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        on = (pdf.l == 1).to_numpy()
        keys = hashed(pdf.key.tolist())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "cascade": [Cascade.build(keys[on], keys[~on]).dump()]})

    dealt = both.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInPandas(build, "shard int, cascade binary"), "cascades"), shards


def listed_hosts(hosts: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """hosts (column host, any others) with a boolean column listed: the host or a parent domain is a key of listed.

    The universe of the cascades is every host of hosts and every parent domain, each once, that is no longer than the
    longest key of listed: what is longer is never looked up, so that a host of very many labels has few domains.  If the cascades are
    larger than may be broadcast, each key of the universe is looked up once, in its shard, and hosts are joined
    with the keys that are listed.
    """
    longest = listed.agg(F.max(F.length("key"))).first()[0] or 0
    universe = hosts.select("host").distinct().select(F.explode(_domains(F.col("host"), longest)).alias("key")).distinct()
    cascades, shards = build_cascades(universe, listed)
    shard = lambda k: F.pmod(F.xxhash64(k), F.lit(shards)).cast("int")
    if (cascades.agg(F.sum(F.length("cascade"))).first()[0] or 0) <= broadcast_bytes:
        shared = hosts.sparkSession.sparkContext.broadcast({r.shard: r.cascade for r in cascades.collect()})  # its size was checked
        name = ("cascades", uuid.uuid4().hex)

        def look(batches):
            made = kept(name, lambda: {k: Cascade.load(v) for k, v in shared.value.items()})
            for batch in batches:
                column = batch.column("keys")
                own, at = hashed(column.flatten().to_pylist()), batch.column("shards").flatten().to_numpy(zero_copy_only=False)
                hit = np.zeros(len(own), bool)
                for s in np.unique(at).tolist():
                    if s in made:
                        hit[at == s] = made[s].holds(own[at == s])
                row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
                found = np.bincount(row, weights=hit, minlength=batch.num_rows) > 0
                names = [n for n in batch.schema.names if n not in ("keys", "shards")]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], [*names, "listed"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hosts.schema) + ", listed boolean"
        return hosts.withColumn("keys", _domains(F.col("host"), longest)).withColumn("shards", F.transform("keys", shard)).mapInArrow(look, schema)

    def look_up(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(keys) or not len(own):
            return keys[["key"]].iloc[:0]
        return keys[["key"]][Cascade.load(own["cascade"].iloc[0]).holds(hashed(keys.key.tolist()))]

    hits = universe.withColumn("shard", shard("key")).groupBy("shard").cogroup(cascades.groupBy("shard")).applyInPandas(look_up, "key string")
    each = hosts.select("host").distinct().select("host", F.explode(_domains(F.col("host"), longest)).alias("key"))
    found = each.join(hits, "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
    return hosts.join(found, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge_urls(pages: DataFrame, listed: list[str] | DataFrame = LISTED, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    listed: domains, or a table of any size with them in column key.

    A rule fits its host and all subdomains when the path starts with the rule's; the rule with the longest
    host and path decides, else whether the host is listed.  A null url or one without :// has an empty host
    and path, which no rule fits.  Repeated rows are repeated; an empty table gives an empty result.
    """
    df = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    spark = pages.sparkSession
    keys = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(k,) for k in listed], "key string")
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    rule = F.coalesce(*(F.when(fits(h, p), F.lit(h + p)) for _, h, p in ordered), F.lit(None).cast("string"))
    action = F.coalesce(*(F.when(fits(h, p), F.lit(a)) for a, h, p in ordered), F.when(F.col("listed"), F.lit("block")).otherwise("allow"))
    return listed_hosts(df, keys).select("page_id", "host", "path", rule.alias("rule"), action.alias("verdict"))
