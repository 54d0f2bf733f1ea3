"""Cache misses of a request stream with a time to live, as a stateful operator on event time."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys share so many states by their hash, so that the calls to the state store do not grow with the keys. A checkpoint belongs to one number.
BUCKETS = 2048


class Misses(StatefulProcessor):
    """Of a key's requests, in the order of their time: the first, and each that comes ttl or more after the last such one. A state holds the keys of a bucket.

    Requests wait in state until the watermark has passed them, so their order of arrival is of no matter. A timer at the next waiting request works off all that are due; a
    last miss is forgotten once the watermark is ttl past it, as whatever comes then is a miss anyway. A quiet bucket leaves nothing behind.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "held binary")  # {(key, namespace): micros}
        self.waiting = handle.getListState("waiting", "held binary")  # lists of (micros, key, namespace)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        got = [(r["micros"], r["key"], r["namespace"]) for r in rows]
        self.waiting.appendValue((pickle.dumps(got),))
        self.handle.registerTimer(min(r[0] for r in got) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((r for held in self.waiting.get() for r in pickle.loads(held[0])), key=itemgetter(0))
        last = pickle.loads(self.last.get()[0]) if self.last.exists() else {}
        out, due = [], bisect_left(rows, now, key=itemgetter(0))
        for t, k, space in rows[:due]:
            before = last.get((k, space))
            if before is None or t - before >= self.ttl:
                out.append(Row(key=k, namespace=space, at=t))
                last[k, space] = t
        self.waiting.clear()
        if due < len(rows):
            self.waiting.appendValue((pickle.dumps(rows[due:]),))
            self.handle.registerTimer(rows[due][0] // 1000 + 1)
        last = {k: t for k, t in last.items() if t + self.ttl >= now}
        if last:
            self.last.update((pickle.dumps(last),))
            self.handle.registerTimer((max(last.values()) + self.ttl) // 1000 + 1)
        else:
            self.last.clear()
        return iter(out)

    def close(self) -> None:
        pass


def misses_within_ttl(requests: DataFrame, ttl_seconds: int, late: str = "0 seconds", ts: str = "cached_at") -> DataFrame:
    """(key, namespace, at) of a stream of requests: requests.misses_within as a stream, a row once the watermark (`late` behind the latest request) has passed its time.

    Requests that come later than the watermark are dropped; those without a time take no part. The session needs the RocksDB state store (use_rocksdb).
    """
    rows = requests.where(F.col(ts).isNotNull()).select(F.col("key").cast("long").alias("key"), "namespace", F.col(ts).cast("timestamp").alias("at"))
    rows = rows.withColumn("micros", F.unix_micros("at")).withColumn("bucket", F.pmod(F.xxhash64("key", "namespace"), F.lit(BUCKETS)).cast("int")).withWatermark("at", late)
    out = rows.groupBy("bucket").transformWithState(Misses(ttl_seconds), "key long, namespace string, at long", "Append", "EventTime")
    return out.select("key", "namespace", F.timestamp_micros("at").alias("at"))


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Works off what is there now, into Parquet files; called again with the same checkpoint it goes on where it ended."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
