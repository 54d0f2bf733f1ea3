"""Mixing sources to target weights.

Each source is one long stream of words, packed into blocks of fixed length. A source's number of output slots follows its
target; how many slots of each source an output shard gets is a multinomial draw (conditioned on the sources' slot totals, so
that the targets are met exactly: shard after shard, multivariate hypergeometric). Slot j of a source takes block perm(j mod blocks), where
perm is the source's own pseudorandom permutation of indices (a keyed Feistel network with cycle walking), and slots meet
blocks in a join by (source, block). All keys are fine-grained, so a source with a third of all rows is spread evenly. All is planned on
keys and sizes; texts are joined at the end. The driver holds one row per source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import cut, table, words_of
from gridspark.llm.sharding import matrix

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Words in a block of the query; a training run takes its context length.
BLOCK = 32
SHARDS = 16
#: Rows that one window puts into a source's stream, about, and slots that one task expands.
BUCKET_ROWS, SPREAD = 2_000, 1 << 16


def targets(sizes: list[int], weights=WEIGHTS, most: int = MAX_EPOCHS) -> list[float]:
    """Sources in order share the sum of sizes by weight (cycled); none gets over `most` times its size, the excess is
    shared again by weight until none is above."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    size = np.array(sizes, dtype=float)
    out, open_, rest = np.zeros(len(size)), size > 0, size.sum()
    while open_.any():
        share = np.where(open_, rest * w / w[open_].sum(), 0.0)
        full = open_ & (share > most * size)
        if not full.any():
            out[open_] = share[open_]
            break
        out[full] = most * size[full]
        rest -= out[full].sum()
        open_ &= ~full
    return out.tolist()


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    x = (x ^ key) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Index i of [0, n) under the keyed pseudorandom permutation of [0, n): four Feistel rounds over the next even number of
    bits, repeated while the value lies outside."""
    n = n.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2)).astype(np.uint64)
    # log2 of numbers near a power of two may round down
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < n, half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        a, b = v >> h, v & m
        for r in range(4):
            a, b = b, a ^ (_mix(b, k + np.uint64(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    with np.errstate(over="ignore"):
        return pd.Series(permute(index.to_numpy(), n.to_numpy(), key.to_numpy()))


def _row_key(columns: list[str]) -> Column:
    return F.xxhash64(F.lit("mix"), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def plan_mix(docs: DataFrame, source: str, size: str, key: list[str], weights=WEIGHTS, most: int = MAX_EPOCHS, block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(placed, drawn): placed is docs plus __source (index), __from (the row's first word in its source's stream),
    source_size and target; drawn has one row per slot: (__shard, __slot, __source, __block, __epoch).

    docs is read several times and should be narrow and cut. Reruns agree: streams are ordered by hashes of `key`, draws are seeded; rows
    equal in key are interchangeable. A row of size 0 takes no room; a null source is a source of its own, last in order; an empty table
    gives no slots. The streams' hash buckets, and the tasks that expand slots, follow the input.
    """
    spark = docs.sparkSession
    found = docs.groupBy(F.col(source).alias("__name")).agg(F.sum(size).alias("n"), F.count("*").alias("rows")).collect()  # one row per source
    found.sort(key=lambda r: (r["__name"] is None, [ord(c) for c in r["__name"] or ""]))
    sizes = [int(r["n"] or 0) for r in found]
    goal = targets(sizes, weights, most)
    of = [(r["__name"], i, -(-r["rows"] // BUCKET_ROWS), n, float(g)) for i, (r, n, g) in enumerate(zip(found, sizes, goal, strict=True))]
    sources = spark.createDataFrame(of, "__name string, __source int, __buckets long, source_size long, target double")
    rows = docs.withColumn("__h", _row_key(key)).join(sources, F.col(source).eqNullSafe(F.col("__name"))).drop("__name")
    rows = rows.withColumn("__bucket", F.pmod(F.shiftrightunsigned("__h", 9), F.col("__buckets"))).drop("__buckets")
    sums = rows.groupBy("__source", "__bucket").agg(F.sum(size).alias("__n"))
    ahead = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__source", "__bucket", ahead(Window.partitionBy("__source").orderBy("__bucket")).alias("__start"))
    within = Window.partitionBy("__source", "__bucket").orderBy("__h", *key)
    before = F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("__before", before).join(offsets, ["__source", "__bucket"]).withColumn("__from", F.col("__start") + F.col("__before")).drop("__start", "__before")
    blocks = [-(-s // block) for s in sizes]
    # A full round of a source is all its blocks, the last of which may be short; the rest of the target is in full blocks.
    slots = [min(most * n, n * int(g // s) + round((g % s) / block)) if s else 0 for s, n, g in zip(sizes, blocks, goal, strict=True)]
    total = sum(slots)
    draws = matrix([total // shards + (k < total % shards) for k in range(shards)], slots, seed) if slots else np.zeros((shards, 0), dtype=np.int64)
    ahead = np.cumsum(draws, axis=0) - draws
    runs = [(k, i, int(ahead[k, i]), int(draws[k, i]), blocks[i]) for k in range(shards) for i in range(len(of)) if draws[k, i]]
    runs = spark.createDataFrame(runs, "__shard int, __source int, __ahead long, __n long, __blocks long")
    runs = runs.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / F.lit(SPREAD)).cast("long"))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SPREAD))
    runs = runs.repartition(tasks, "__shard", "__source", "__c").withColumn("__slot", F.explode(F.sequence(F.col("__c") * SPREAD, F.least((F.col("__c") + 1) * SPREAD, F.col("__n")) - 1)))
    j = F.col("__ahead") + F.col("__slot")
    salt = F.xxhash64(F.lit(f"{seed}:source"), "__source")
    drawn = runs.select("__shard", "__slot", "__source", _permuted(F.pmod(j, F.col("__blocks")), F.col("__blocks"), salt).alias("__block"), F.floor(j / F.col("__blocks")).cast("int").alias("__epoch"))
    # Slots are many more than the runs they come from, so joins with them are never broadcasts.
    return placed, drawn.hint("merge")


def pieces_of(placed: DataFrame, size: str, block: int) -> DataFrame:
    """One row per (row, block) with the words of the row that lie in it: __block, __lo, __hi (within the row, end exclusive)."""
    first, last = F.floor(F.col("__from") / block), F.floor((F.col("__from") + F.col(size) - 1) / block)
    out = placed.where(F.col(size) > 0).withColumn("__block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo, hi = F.greatest(F.col("__block") * block - F.col("__from"), F.lit(0)), F.least((F.col("__block") + 1) * block - F.col("__from"), F.col(size))
    return out.withColumn("__lo", lo).withColumn("__hi", hi)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.coalesce(F.size(words_of(text)), F.lit(0)).cast("long").alias("size"), F.xxhash64(text).alias("h"))
    docs = cut(docs.withColumn("size", F.when(F.col("size") < 0, 0).otherwise(F.col("size"))))
    placed, drawn = plan_mix(docs, "source", "size", ["doc_id", "h"])
    placed = cut(placed)
    # (source, first word) tells rows with words apart.
    times = drawn.groupBy("__source", "__block").agg(F.count("*").alias("__t"))
    pieces = pieces_of(placed.select("__source", "__from", "size"), "size", BLOCK)
    taken = pieces.join(times.hint("merge"), ["__source", "__block"]).groupBy("__source", "__from").agg(F.sum((F.col("__hi") - F.col("__lo")) * F.col("__t")).alias("taken"))
    full = placed.where("size > 0").join(taken.hint("merge"), ["__source", "__from"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none)


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", block: int = 512, n_chars: str | None = "n_chars", **options) -> DataFrame:
    """The mixture as rows of docs' columns: each row is a run of a document's words that one round of the mix takes, in
    consecutive blocks, words parted by single spaces (whole documents keep their text as it is). Documents that no slot takes go, documents
    taken in several rounds come several times, at most three. Null and wordless texts take no room in the mix and go. Rows
    that repeat in full each take their own room; ties in the order of a stream do not occur but among them. A very long text is split into
    words where a run is cut from it, one text at a time. Columns whose names begin with __ are taken.

    Runs are planned on keys and sizes alone; texts move once, to meet their runs.
    """
    keys = [c for c, kind in docs.dtypes if c != text and kind in ("bigint", "int", "string")]
    wide = docs.withColumn("__text_hash", F.xxhash64(text)).withColumn("__key", _row_key([*keys, "__text_hash"]))
    size = F.greatest(F.coalesce(F.size(words_of(F.col(text))), F.lit(0)), F.lit(0)).cast("long")
    rows = cut(wide.select("__key", "__text_hash", F.col(source).alias("__name_of"), size.alias("__size")).where("__size > 0"))
    placed, drawn = plan_mix(rows, "__name_of", "__size", ["__key", "__text_hash"], block=block, **options)
    placed = cut(placed.select("__key", "__text_hash", "__source", "__from", "__size"))
    narrow = pieces_of(placed.select("__source", "__from", "__size"), "__size", block)
    got = narrow.join(drawn.select("__source", "__block", "__epoch").hint("merge"), ["__source", "__block"])
    # Consecutive blocks of one round are joined into runs, within the document and round.
    w = Window.partitionBy("__source", "__from", "__epoch").orderBy("__lo")
    runs = got.withColumn("__new", F.when(F.lag("__hi").over(w).eqNullSafe(F.col("__lo")), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    spans = runs.groupBy("__source", "__from", "__epoch", "__run").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    spans = cut(spans.join(placed, ["__source", "__from"]).select("__key", "__text_hash", "__lo", "__hi", "__size"))
    # A row's key meets one text: of rows that repeat in full one brings the text for the runs of all.
    both = ["__key", "__text_hash"]
    twice = cut(rows.groupBy(*both).count().where("count > 1").select(*both))
    if not twice.isEmpty():
        one = wide.join(twice, both, "left_semi").groupBy(*both).agg(F.first(F.struct(*docs.columns)).alias("__row"))
        wide = wide.join(twice, both, "left_anti").unionByName(one.select(*(F.col(f"__row.{c}").alias(c) for c in docs.columns), *both))
    out = wide.join(spans, both)
    part = F.array_join(F.slice(words_of(F.col(text)), (F.col("__lo") + 1).cast("int"), (F.col("__hi") - F.col("__lo")).cast("int")), " ")
    out = out.withColumn(text, F.when(F.col("__hi") - F.col("__lo") == F.col("__size"), F.col(text)).otherwise(part))
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast("long"))
    return out.select(*docs.columns)
