"""Streams with state over restarts, and batches merged once."""

import pytest
from pyspark.sql import functions as F

from gridspark.plans import fixtures
from gridspark.streaming import merge, state
from gridspark.streaming import requests as live

TTL = 36 * 3600


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_ttl_stream_gives_the_batch_rows_over_restarts(spark, sf, tmp_path):
    state.use_rocksdb(spark)
    df = fixtures.requests(spark, sf).select("key", "namespace", F.col("cached_at").cast("timestamp").alias("cached_at"))
    df = df.where("key % 5 < 2").orderBy("cached_at")
    cuts = [r[0] for r in df.selectExpr("percentile_approx(unix_micros(cached_at), array(0.3, 0.7))").collect()][0]
    at = F.unix_micros("cached_at")
    parts = [df.where(at < cuts[0]), df.where((at >= cuts[0]) & (at < cuts[1])), df.where(at >= cuts[1])]
    end = spark.sql("SELECT -1L AS key, 'end' AS namespace, timestamp'2030-01-01' AS cached_at")
    stream = lambda: state.misses_within_ttl(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), TTL, "1 hour")
    for k, part in enumerate([*parts, end]):  # each run is a restart from the checkpoint
        part.orderBy(F.desc("cached_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (0, 2, 3):
            state.run_to_files(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got) == rows(live.misses_within(df, TTL))


def test_ttl_states_are_no_more_than_buckets(spark, tmp_path, monkeypatch):
    """Keys that share a state keep their own last miss."""
    state.use_rocksdb(spark)
    monkeypatch.setattr(state, "BUCKETS", 2)
    df = spark.range(120).selectExpr("id % 40 AS key", "CASE WHEN id % 3 > 0 THEN 'n' END AS namespace", "timestamp_seconds(1704067200 + id * 1500) AS cached_at")
    df.write.parquet(f"{tmp_path}/in")
    spark.sql("SELECT -1L AS key, 'end' AS namespace, timestamp'2030-01-01' AS cached_at").write.mode("append").parquet(f"{tmp_path}/in")
    stream = state.misses_within_ttl(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), TTL)
    state.run_to_files(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(live.misses_within(df, TTL))
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/checkpoint").count() <= 2


@pytest.fixture
def kept(spark, tmp_path):
    r = merge.registry_at(spark, str(tmp_path), parts=4)
    first = spark.createDataFrame([("a", 1, "put", 10), ("b", 2, "put", 20), ("c", 3, "put", 30)], "name string, seq long, op string, v long")
    r.apply(first, 0)
    r.settings.apply(spark.createDataFrame([("a", "{}"), ("b", "{1}")], r.settings.schema), 100, lambda old, new: old.unionByName(new))
    return r


def test_changes_are_merged_and_reported(spark, kept):
    batch = spark.createDataFrame(
        [("b", 5, "delete", None), ("c", 6, "update", 33), ("d", 7, "update", 1), ("e", 8, "delete", None), ("f", 9, "put", 5), ("f", 10, "update", 6), ("g", 11, "put", 1), ("g", 12, "delete", None), ("g", 13, "update", 2)],
        "name string, seq long, op string, v long",
    )
    kept.apply(batch, 1)
    assert rows(kept.regions.read()) == [("a", "10"), ("c", "33"), ("f", "6")]
    assert rows(kept.settings.read()) == [("a", "{}")]
    told = {r["name"]: (r["op"], r["found"], r["affected"]) for r in kept.report.read().where("batch = 1").collect()}
    assert told == {"b": ("delete", True, True), "c": ("update", True, True), "d": ("update", False, False), "e": ("delete", False, False), "f": ("update", True, True), "g": ("update", False, False)}


def test_replayed_batches_change_nothing(spark, kept):
    batch = spark.createDataFrame([("a", 5, "delete", None), ("z", 6, "put", 1)], "name string, seq long, op string, v long")
    kept.apply(batch, 1)
    before = [(rows(t.read()), t.version()) for t in (kept.regions, kept.settings, kept.report)]
    kept.apply(batch, 1)
    kept.apply(batch.withColumn("v", F.lit(9).cast("long")), 0)
    assert [(rows(t.read()), t.version()) for t in (kept.regions, kept.settings, kept.report)] == before
    assert rows(kept.regions.read(1)) == [("a", "10"), ("b", "20"), ("c", "30")]


def test_a_batch_that_died_is_done_again(spark, kept, monkeypatch):
    batch = spark.createDataFrame([("a", 5, "delete", None)], "name string, seq long, op string, v long")
    real = merge.VersionedTable.commit

    def dies(self, *a):
        if self.path.endswith("regions"):
            raise RuntimeError("lost")
        return real(self, *a)

    monkeypatch.setattr(merge.VersionedTable, "commit", dies)
    with pytest.raises(RuntimeError):
        kept.apply(batch, 1)
    monkeypatch.setattr(merge.VersionedTable, "commit", real)
    kept.apply(batch, 1)
    assert rows(kept.regions.read()) == [("b", "20"), ("c", "30")]
    assert rows(kept.settings.read()) == [("b", "{1}")]
    assert kept.report.read().where("batch = 1").count() == 1


def test_stream_of_batches(spark, sf, tmp_path):
    df = fixtures.requests(spark, sf).select("namespace", "size_bytes")
    for k in range(2):
        df.where(F.pmod(F.col("size_bytes"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t = merge.VersionedTable(spark, f"{tmp_path}/summary", merge.SUMMARY, "namespace", 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    put = lambda batch, k: t.apply(batch, k, merge.add_summary)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert t.version() == 2
    assert rows(t.read()) == rows(live.running_summary(df))
