"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes all that its predecessor kept and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontam, langid, mixing, ngram_join, sharding
from gridspark.llm.common import cut, fresh_path, table

#: A document stays if its language covers at least this share of its letters; `und` documents go.
MIN_LANGUAGE_SHARE = 0.5
#: Words in a block of the mix.
MIX_BLOCK = 512


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters most of which one language covers.

    A null, empty or letterless text goes; a null lang only takes no part in learning; where no row has one, no language is known and all go. Very long texts are
    judged whole, repeated rows alike, ties between languages by code point. Other columns pass through; `__language` is taken.
    """
    out = langid.identify(docs, langid.fit(docs), out="__language")
    return out.where((F.col("__language.lang") != "und") & (F.col("__language.score") >= MIN_LANGUAGE_SHARE)).drop("__language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; rows without a doc_id, and texts without words, stay.

    Of rows that repeat the doc_id and link, one stays, the least by its text's hash; very long texts are compared whole; an empty table stays empty. Other columns
    pass through; names that begin with __ are taken.
    """
    found = cut(ngram_join.grouped(docs))
    # Of the rows that share the least doc_id of a component, those of its least class stay.
    stay = found.where("component_id = doc_id and class is not null")
    twice = cut(stay.groupBy("doc_id", "root").agg(F.count("*").alias("n"), F.min("class").alias("least")).where("n > 1"))
    other = stay.join(twice, ["doc_id", "root"]).where("class <> least").select("doc_id", F.col("class").alias("__class"))
    gone = found.where("component_id < doc_id").select("doc_id", F.col("class").alias("__class")).union(other).distinct()
    left = ngram_join.without(docs, gone)
    if twice.isEmpty():
        return left
    # Rows that share the doc_id and the class are seldom; only they are compared again: the least row by its text's hash stays.
    again = twice.select("doc_id").distinct()
    rows = cut(ngram_join.with_class(left.join(again, "doc_id", "left_semi").select(left.columns)))
    one = rows.where("__class is not null").groupBy("doc_id", "__class").agg(F.min(F.struct(F.xxhash64("text").alias("__text"), *left.columns)).alias("__row"))
    kept = one.select(*(F.col(f"__row.{c}") for c in left.columns)).unionByName(rows.where("__class is null").drop("__class"))
    return left.join(again, "doc_id", "left_anti").unionByName(kept)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and wordless texts have no window and stay; very long texts are searched whole; repeated rows stay or go together; an empty table or benchmark
    changes nothing. Other columns pass through; `__hits` is taken.
    """
    return decontam.find_overlaps(docs, table(spark, sf_dir, "benchmark"), out="__hits").where(F.size("__hits.spans") == 0).drop("__hits")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: runs of documents' words, as often as the mix takes them.

    Null and wordless texts take no room and go; a null source is a source of its own; rows that repeat in full each take their own room, and ties in a stream's
    order occur among them alone; very long texts are cut where blocks end; an empty table gives an empty one. Other columns pass through; names that
    begin with __ are taken.
    """
    return mixing.mix_documents(docs, block=MIX_BLOCK)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in shards: docs' columns plus shard and slot.

    Every row gets a slot, whatever is null, empty, very long or repeated in it; rows that repeat in full are interchangeable. An empty table gives an empty
    one. Columns named shard or slot are replaced; names that begin with __ are taken.
    """
    keyed = docs.withColumn("__t", F.xxhash64("text"))
    return sharding.shuffle_into_shards(keyed, ["doc_id", "n_chars", "__t"]).drop("__t")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
#: No SQL: language models, seeded draws and permutations are beyond it. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
