"""Sharding: a uniform random shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into source partitions by a hash. The counts that each source partition sends to each shard are drawn exactly
(multivariate hypergeometric, row after row of the matrix against the capacity left), each partition is permuted locally and
dealt out by its row of the matrix, and each shard is permuted again. Every random choice is a keyed hash of the row, so a
rerun or a retried task gives the same shards. Ranks are counted within hash buckets, whose number follows the number of rows, plus bucket
offsets, so no task ever sorts a whole shard.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import cut, table

SHARDS, PARTS = 24, 64
#: Rows in a bucket, about: what one window sorts.
BUCKET_ROWS = 50_000
#: Urns of this size and more are beyond numpy's generator.
URN = 10**9


def _log_factor(a: int, d: int) -> float:
    """ln((a + d)! / a!) without the cancellation that a difference of two lgamma values has."""
    if a < 1000 or a + d < 1000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    x, y = a + 1, a + d + 1  # Stirling's series for gamma
    return (y - 0.5) * math.log1p(d / x) + d * math.log(x) - d + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360


def _ratio(good: int, bad: int, n: int, m: int, k: int) -> float:
    """p(k) / p(m) of the hypergeometric law."""
    if not max(0, n - bad) <= k <= min(good, n):
        return 0.0
    d = k - m
    # C(good, k) C(bad, n - k) against the same at m; terms of d ln x are taken together, as they nearly cancel.
    xs = (m, good - m, n - m, bad - n + m)
    if min(xs) < 1000 or min(xs[0] + d, xs[1] - d, xs[2] - d, xs[3] + d) < 1000:
        return math.exp(-_log_factor(xs[0], d) - _log_factor(xs[1], -d) - _log_factor(xs[2], -d) - _log_factor(xs[3], d))
    out = d * math.log(Fraction((xs[1] + 1) * (xs[2] + 1), (xs[0] + 1) * (xs[3] + 1)))
    for x, e in zip(xs, (d, -d, -d, d), strict=True):
        out -= _log_factor(x, e) - e * math.log(x + 1)
    return math.exp(min(out, 0.0))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from an urn are good; the law holds at any size.

    Small urns go to numpy. For others the law is log-concave, and Devroye's rejection for such laws (flat around the mode m, exponential
    beyond) needs only p(k) / p(m), which _ratio has to nine digits, and a lower bound of p(m).
    """
    total = good + bad
    if total < URN:
        return int(rng.hypergeometric(good, bad, n)) if total else 0
    if 2 * n > total:  # count those that stay
        return good - hypergeometric(rng, good, bad, total - n)
    if 2 * good > total:
        return n - hypergeometric(rng, bad, good, n)
    if n > good:  # draws and good ones change places without changing the law
        good, bad, n = n, total - n, good
    if not n or not good:
        return 0
    m = (n + 1) * (good + 1) // (total + 2)
    var = n * (good / total) * (bad / total) * ((total - n) / (total - 1))
    if var > 1e6:
        top = 0.98 / math.sqrt(2 * math.pi * var)
    else:
        top = 0.98 * math.exp(_log_factor(good - m, m) - math.lgamma(m + 1) + _log_factor(bad - (n - m), n - m) + math.lgamma(n + 1) - math.lgamma(n - m + 1) - _log_factor(total - n, n))
    w = 1 + top / 2
    while True:
        y = rng.random() * w / top if rng.random() <= w / (1 + w) else (w + rng.standard_exponential()) / top
        k = m + (round(y) if rng.random() < 0.5 else -round(y))
        if rng.random() * min(1.0, math.exp(w - top * y)) <= _ratio(good, bad, n, m, k):
            return k


def matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Exact counts from each part to each shard: rows sum to counts, columns to capacities.

    Each row is drawn by splitting its count over the shards one after another by univariate hypergeometric draws.
    """
    assert sum(counts) == sum(capacities)
    rng, left = np.random.default_rng(seed), np.array(capacities, dtype=np.int64)
    out = np.zeros((len(counts), len(left)), dtype=np.int64)
    for i, c in enumerate(counts):
        rest, pool = int(c), int(left.sum())
        for j, cap in enumerate(left.tolist()):
            if rest == 0:
                break
            pool -= cap
            k = hypergeometric(rng, cap, pool, rest)
            out[i, j] = k
            left[j] -= k
            rest -= k
    return out


def _key(cols: list[str], salt: str) -> Column:
    """A 64-bit key of the row: nulls count as a value of their own."""
    return F.xxhash64(F.lit(salt), *[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def shuffle_into_shards(df: DataFrame, key: list[str], shards: int = SHARDS, parts: int = PARTS, seed: int = 7, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """df plus `shard` (0 to shards - 1, counts at most one apart) and `slot` (its place there, gapless from 0).

    key: scalar columns that tell rows apart; rows equal in them are interchangeable and each still gets its own slot. Null
    keys are values; an empty table gives an empty result; fewer rows than shards leave the last shards empty. All columns
    pass through, however long their texts; an input column named like `shard` or `slot` is replaced; names that begin with __ are taken.
    Two exchanges carry the rows: by (part, bucket) and by (shard, bucket). A group of a third of all rows that are equal in key falls into one
    bucket, so key should tell rows apart; copies under different ids do not meet.
    """
    spark = df.sparkSession
    df = df.drop(shard, slot)
    n = df.count()
    buckets, buckets2 = (max(1, -(-n // (k * BUCKET_ROWS))) for k in (parts, shards))
    bucket = lambda k, m: F.pmod(F.shiftrightunsigned(k, 20), F.lit(m)).cast("long")
    ahead = lambda by, b: F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = df.withColumn("__k", _key(key, f"{seed}:deal")).withColumn("__part", F.pmod("__k", F.lit(parts)).cast("int")).withColumn("__b", bucket(F.col("__k"), buckets))
    sizes = cut(a.groupBy("__part", "__b").agg(F.count("*").alias("__n")))  # a row for each BUCKET_ROWS rows, about
    of = dict(sizes.groupBy("__part").agg(F.sum("__n")).collect())  # one row per part
    counts = [of.get(p, 0) for p in range(parts)]
    m = matrix(counts, [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = spark.createDataFrame([(p, [int(x) for x in row]) for p, row in enumerate(np.cumsum(m, axis=1))], "__part int, __ends array<bigint>")
    deal = sizes.select("__part", "__b", ahead("__part", "__b").alias("__from"))
    local = Window.partitionBy("__part", "__b").orderBy("__k", *key)
    b = a.withColumn("__r", F.row_number().over(local)).join(deal, ["__part", "__b"]).join(F.broadcast(ends), "__part")  # parts x shards numbers
    rank = F.col("__from") + F.col("__r")
    b = b.withColumn(shard, F.size(F.filter("__ends", lambda e: e < rank)).cast("int")).withColumn("__s", rank).drop("__from", "__ends", "__r")
    # The second permutation: ordered by a key of the source rank, which is unique within a part.
    c = b.withColumn("__k2", F.xxhash64(F.lit(f"{seed}:settle"), "__part", "__s")).withColumn("__b2", bucket(F.col("__k2"), buckets2))
    by = c.groupBy(shard, "__b2").agg(F.count("*").alias("__n"))
    settle = Window.partitionBy(shard, "__b2").orderBy("__k2", "__part", "__s")
    out = c.withColumn("__r2", F.row_number().over(settle)).join(by.select(shard, "__b2", ahead(shard, "__b2").alias("__before")), [shard, "__b2"])
    return out.withColumn(slot, (F.col("__before") + F.col("__r2") - 1).cast("long")).select(*df.columns, shard, slot)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    out = shuffle_into_shards(docs, ["doc_id", "size", "text_crc32", "h"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
