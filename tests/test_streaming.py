import pytest
from pyspark.sql import functions as F

from gridspark.plans import fixtures
from gridspark.streaming import requests as live


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log"))
    df = fixtures.requests(spark, sf).withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    df.orderBy("cached_at").coalesce(1).write.mode("overwrite").parquet(f"{path}/in")
    return df, path


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_update_stream_equals_batch(spark, stored):
    df, path = stored
    s = live.running_summary(live.read_stream(spark, f"{path}/in", df.schema))
    assert rows(live.run_once(s, "running", "complete", f"{path}/c1")) == rows(live.running_summary(df))


def test_windows_close_behind_the_watermark(spark, stored):
    df, path = stored
    s = live.hits_by_window(live.watermarked(live.read_stream(spark, f"{path}/in", df.schema)), "6 hours")
    got, want = rows(live.run_once(s, "windows", "append", f"{path}/c2")), rows(live.hits_by_window(df, "6 hours"))
    assert set(got) <= set(want) and len(got) >= len(want) - 2


def test_first_request_within_watermark(spark, stored):
    df, path = stored
    s = live.misses(live.watermarked(live.read_stream(spark, f"{path}/in", df.schema), "60 days")).select("key", "namespace")
    assert rows(live.run_once(s, "misses", "append", f"{path}/c3")) == rows(df.select("key", "namespace").distinct())


def test_sliding_windows_hold_each_row_in_each_window(spark, stored):
    df, _ = stored
    assert live.hits_by_window(df, "2 hours", "1 hour").agg(F.sum("requests")).first()[0] == 2 * df.count()
