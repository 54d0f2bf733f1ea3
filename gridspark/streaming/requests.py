"""Request-log statistics that run alike on a table and on a stream: windows, first requests, sessions, running summaries.

Each function takes a DataFrame, batch or streaming; on a stream add the watermark first (`watermarked`), so that late rows
are dropped and state is bounded.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def watermarked(df: DataFrame, late: str = "2 hours", ts: str = "cached_at") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def hits_by_window(df: DataFrame, size: str, slide: str | None = None, ts: str = "cached_at") -> DataFrame:
    """(start, requests, hits) per tumbling or sliding window."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(w.alias("w")).agg(F.count("*").alias("requests"), F.count_if("hit").alias("hits")).select(F.col("w.start").alias("start"), "requests", "hits")


def first_requests(df: DataFrame, ts: str = "cached_at") -> DataFrame:
    return df.groupBy("key", "namespace").agg(F.min(ts).alias("first"))


def misses_within(df: DataFrame, ttl_seconds: int, ts: str = "cached_at") -> DataFrame:
    """(key, namespace, at): the requests of a table that no stored answer serves, a key's first and each that comes at least the ttl after the last such one.

    Rows stream through each task in order of key and time, and a task holds one key's last miss only. A null time takes no part."""
    rows = df.select("key", "namespace", F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("t is not null")

    def walked(batches):
        key = last = None
        for b in batches:
            keep = []
            for i, (*k, t) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if k != key or t - last >= ttl_seconds * 1_000_000:
                    key, last = k, t
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(parts, "key", "namespace").sortWithinPartitions("key", "namespace", "t").mapInArrow(walked, rows.schema)
    return out.select("key", "namespace", F.timestamp_micros("t").alias("at"))


def misses(df: DataFrame) -> DataFrame:
    """On a watermarked stream: the first request per key and namespace within the watermark."""
    return df.dropDuplicatesWithinWatermark(["key", "namespace"])


def sessions(df: DataFrame, gap: str, ts: str = "cached_at") -> DataFrame:
    """(key, start, n): requests of a key less than the gap apart."""
    return df.groupBy("key", F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "n")


def running_summary(df: DataFrame) -> DataFrame:
    """Per namespace: rows, least and greatest size; in update mode a stream emits what changed."""
    return df.groupBy("namespace").agg(F.count("*").alias("n"), F.min("size_bytes").alias("lo"), F.max("size_bytes").alias("hi"))


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Drives a stream over what is there now into a memory table and returns it; for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
