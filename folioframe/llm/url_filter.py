"""URL filters by a cascade of Bloom filters.

The key universe is complete and known: all rule keys that any url of the corpus could
fit.  Level 0 encodes the listed keys, level 1 the other keys of the universe that level
0 lets through by mistake, level 2 the listed keys that level 1 lets through, and so on
until a level makes no mistake.  A key's class is told by the first level that turns it
away, exactly, for every key of the universe, so no url is joined with any list.

One cascade is built for each verdict.  A url's key is a host suffix and a path prefix;
only suffix and prefix lengths that occur in a rule make keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Fewest bits per key of a level (about 2 % mistakes), and hash functions.
BITS_PER_KEY, HASHES = 8, 5
BUCKET_BITS = 32768
#: Largest level, in bytes, that is sent to the tasks; a longer list must be split by host first.
MOST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys a url fits, longest first: for each shape (labels of the host, length of the path) that it is large enough for."""
    labels = F.split(host, r"\.")

    def key(labels_n: int, path_n: int) -> Column:
        suffix = F.substring_index(host, ".", -labels_n)
        enough = (F.size(labels) >= labels_n) & (F.length(path) >= path_n) & (F.length(suffix) > 0)
        prefix = F.substring(path, 1, path_n)
        return F.when(enough, F.struct((F.length(suffix) + path_n).alias("n"), F.concat(suffix, prefix).alias("key")))

    found = F.filter(F.array(*[key(*s) for s in shapes]), lambda k: k.isNotNull())
    return F.reverse(F.array_sort(found))


def places(key: Column, level: int, bits: int) -> Column:
    """Bits of a key in a level."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * HASHES + h)), F.lit(bits)) for h in range(HASHES)])


def level_bits(n: int, others: int) -> int:
    """Bits of a level of ``n`` keys that ``others`` are held against: so many that about n of these pass by mistake.

    So the next level has about as many keys, and no level grows with the universe but by the logarithm of its size.
    """
    rate = (n / max(n, others)) ** (1 / HASHES)
    per_key = HASHES / -math.log(1 - rate) if rate < 1 else 0
    return max(64, math.ceil(n * max(BITS_PER_KEY, per_key)))


def level_bitmap(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The level's bytes: built by the tasks, of the size that was checked before."""
    bit = keys.select(F.explode(places(F.col("key"), level, bits)).alias("bit"))
    rows = (
        bit.groupBy(F.floor(F.col("bit") / BUCKET_BITS).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("bit") % BUCKET_BITS).alias("bytes"))
        .toLocalIterator()
    )
    out = np.zeros(math.ceil(bits / BUCKET_BITS) * BUCKET_BITS // 8, np.uint8)
    for row in rows:
        at = row["bucket"] * BUCKET_BITS // 8
        out[at : at + len(row["bytes"])] = np.frombuffer(row["bytes"], np.uint8)
    return out


@dataclass
class Cascade:
    """Levels as (bits, bytes in a broadcast variable)."""

    levels: list[tuple[int, object]]

    def passes(self, key: Column, level: int) -> Column:
        """Whether a level lets the key through."""
        bits, sent = self.levels[level]

        @F.pandas_udf("boolean")
        def test(at: pd.Series) -> pd.Series:
            if not len(at):
                return pd.Series([], dtype=bool)
            spots = np.stack(at.to_numpy()).astype(np.int64)
            return pd.Series((sent.value[spots >> 3] >> (spots & 7) & 1).all(axis=1))

        return test(places(key, level, bits))

    def listed(self, keys: Column) -> Column:
        """For an array of keys (strings), an array of booleans: is the key one of the listed."""
        levels = self.levels

        @F.pandas_udf("array<boolean>")
        def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                sizes = batch.map(len).to_numpy()
                spots = np.array([p for key in batch for p in key], np.int64).reshape(-1, len(levels) * HASHES) if sizes.sum() else None
                open_keys = np.ones(int(sizes.sum()), bool)
                inside = np.zeros(int(sizes.sum()), bool)
                for level, (_, sent) in enumerate(levels):
                    if spots is None:
                        break
                    own = spots[:, level * HASHES : (level + 1) * HASHES]
                    through = (sent.value[own >> 3] >> (own & 7) & 1).all(axis=1)
                    inside[open_keys & ~through] = level % 2 == 1
                    open_keys &= through
                inside[open_keys] = len(levels) % 2 == 1  # the last level makes no mistake
                yield pd.Series(np.split(inside, np.cumsum(sizes)[:-1]))

        return test(F.transform(keys, lambda k: F.concat(*[places(k, i, bits) for i, (bits, _) in enumerate(levels)])))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade that tells ``listed`` (column key) from the rest of ``universe`` (distinct column key)."""
    spark = universe.sparkSession
    cascade = Cascade([])
    encoded, other = listed.select("key").distinct(), universe.join(listed.select("key").distinct(), "key", "left_anti")
    others = universe.count()
    while True:
        encoded = written(encoded, "cascade-keys")
        n = encoded.count()
        if n == 0:
            break
        bits, others = level_bits(n, others), n
        if bits > MOST_BYTES * 8:
            raise ValueError(f"{n} keys make a level too large to send; split the list")
        level = len(cascade.levels)
        cascade.levels.append((bits, spark.sparkContext.broadcast(level_bitmap(encoded, level, bits))))
        mistaken = other.where(cascade.passes(F.col("key"), level))
        encoded, other = mistaken, encoded
    return cascade


def filter_urls(
    pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows of ``pages`` with host, path, rule (the longest that fits, or null) and verdict.

    Rules (host, path, verdict) must differ in host and path.  Urls that no rule fits get
    ``default``.  Null and urls without ``://`` have empty host and path, which no rule fits.
    Columns named like a result are replaced.
    """
    spark = pages.sparkSession
    pages = pages.drop("host", "path", "rule", "verdict")
    if any(not r.path.startswith("/") or not r.host for r in rules):
        raise ValueError("a rule needs a host and a path from its slash on")
    # Hosts hold no slash and paths start with one, so a key tells both.
    listed = {v: [(r.key,) for r in rules if r.verdict == v] for v in sorted({r.verdict for r in rules})}
    shapes = sorted({(len(r.host.split(".")), len(r.path)) for r in rules})
    out = pages.withColumn("host", host_of(F.col(f"`{url_col}`"))).withColumn("path", path_of(F.col(f"`{url_col}`")))
    if not rules:
        return out.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    keys = keys_of(F.col("host"), F.col("path"), shapes)
    universe = written(out.select(F.explode(F.transform(keys, lambda k: k["key"])).alias("key")).distinct(), "url-keys")
    cascades = {v: build_cascade(spark.createDataFrame(k, "key string"), universe) for v, k in listed.items()}
    given, listing = free_name(out, "__keys"), [free_name(out, f"__in{i}") for i in range(len(cascades))]
    out = out.withColumn(given, keys)
    for name, cascade in zip(listing, cascades.values(), strict=True):
        out = out.withColumn(name, cascade.listed(F.transform(given, lambda k: k["key"])))
    # The longest key that some cascade lists.
    verdicts = [F.transform(given, _hit(name, v)) for name, v in zip(listing, cascades, strict=True)]
    best = F.array_max(F.filter(F.concat(*verdicts), lambda h: h.isNotNull()))
    longest = free_name(out, "__best")
    return (
        out.withColumn(longest, best)
        .withColumn("rule", F.col(longest)["key"])
        .withColumn("verdict", F.coalesce(F.col(longest)["verdict"], F.lit(default)))
        .drop(given, longest, *listing)
    )


def _hit(column: str, verdict: str):
    """For the key at a place: (length, key, verdict) if the cascade of ``verdict`` lists it, else null."""

    def at(key: Column, i: Column) -> Column:
        return F.when(F.get(F.col(column), i), F.struct(key["n"].alias("n"), key["key"].alias("key"), F.lit(verdict).alias("verdict")))

    return at
