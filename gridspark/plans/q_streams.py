"""Streams run to their end over the request log: state with a time to live, and batches merged into versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.plans import fixtures as X
from gridspark.plans.fixtures import sql
from gridspark.plans.q_features import fresh
from gridspark.streaming import merge, state

Q, S = {}, {}


def query(name: str, body: str):
    def keep(f):
        Q[name], S[name] = f, sql(body)
        return f

    return keep


@query("t2_ttl_stream", ", o AS (SELECT key, namespace, cached_at, row_number() OVER (PARTITION BY key, namespace ORDER BY cached_at) AS n FROM req), w AS (SELECT key, namespace, cached_at, n, cached_at AS miss FROM o WHERE n = 1 UNION ALL SELECT o.key, o.namespace, o.cached_at, o.n, CASE WHEN o.cached_at >= w.miss + INTERVAL '72 hours' THEN o.cached_at ELSE w.miss END FROM w JOIN o ON o.key = w.key AND o.namespace IS NOT DISTINCT FROM w.namespace AND o.n = w.n + 1) SELECT key, namespace, epoch_us(miss) AS at FROM w WHERE miss = cached_at")
def _(spark, sf):
    state.use_rocksdb(spark)
    path = fresh(spark, "stream")
    log = X.requests(spark, sf).select(F.col("key").cast("long").alias("key"), "namespace", F.col("cached_at").cast("timestamp").alias("cached_at"))
    log.write.parquet(f"{path}/in")
    # A request far ahead lets the watermark pass all others.
    spark.sql("SELECT -1L AS key, 'end' AS namespace, timestamp'2100-01-01' AS cached_at").write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1000).parquet(f"{path}/in")
    state.run_to_files(state.misses_within_ttl(stream, 72 * 3600), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select("key", "namespace", F.unix_micros("at").alias("at"))


CHANGES = """, chg AS (SELECT event_id AS seq, coalesce(n_name, 'R' || (key % 40)) AS name, CASE namespace WHEN 'dem' THEN 'put' WHEN 'osm' THEN 'put' WHEN 'water' THEN 'update' ELSE 'delete' END AS op, size_bytes AS v FROM req LEFT JOIN nation ON n_nationkey = key % 50),
lst AS (SELECT name, arg_max(op, seq) AS op, max(seq) AS s, arg_max(v, seq) AS v FROM chg GROUP BY name),
bef AS (SELECT c.name, arg_max(c.op, c.seq) AS b FROM chg c JOIN lst l ON c.name = l.name AND c.seq < l.s AND c.op <> 'update' GROUP BY c.name),
rep AS (SELECT l.name, l.op, coalesce(b = 'put', r.name IS NOT NULL) AS found, v FROM lst l LEFT JOIN bef USING (name) LEFT JOIN reg r ON r.name = l.name)"""


def merged(spark, sf):
    """A registry of all regions with their settings, after the log's changes, which are delivered twice."""
    r = merge.registry_at(spark, fresh(spark, "registry"))
    regions = X.regions(spark, sf).select("name", F.col("dim").cast("long").alias("v"))
    r.settings.apply(regions.select("name", F.lit("{}").alias("settings")), 0, lambda old, new: old.unionByName(new))
    r.regions.apply(regions, 0, lambda old, new: old.unionByName(new))
    nation = X.table(spark, sf, "nation").select("n_nationkey", "n_name")
    log = X.requests(spark, sf).join(F.broadcast(nation), F.col("key") % 50 == F.col("n_nationkey"), "left")  # 25 rows
    op = F.when(F.col("namespace").isin("dem", "osm"), "put").when(F.col("namespace") == "water", "update").otherwise("delete")
    changes = log.select(F.coalesce("n_name", F.concat(F.lit("R"), F.col("key") % 40)).alias("name"), F.col("event_id").alias("seq"), op.alias("op"), F.col("size_bytes").alias("v"))
    for _ in range(2):
        r.apply(changes, 1)
    return r


@query("k1_merge_report", CHANGES + " SELECT 1::BIGINT AS batch, name, op, found, found OR op = 'put' AS affected FROM rep")
def _(spark, sf):
    return merged(spark, sf).report.read()


@query("k1_merged_regions", CHANGES + " SELECT name, v, name IN (SELECT name FROM reg) AND name NOT IN (SELECT name FROM rep WHERE op = 'delete' AND found) AS has_settings FROM rep WHERE op = 'put' OR (op = 'update' AND found) UNION ALL SELECT name, dim::BIGINT, true FROM reg WHERE name NOT IN (SELECT name FROM rep WHERE op = 'put' OR found)")
def _(spark, sf):
    r = merged(spark, sf)
    return r.regions.read().join(r.settings.read().select("name", F.lit(True).alias("s")), "name", "left").select("name", "v", F.coalesce("s", F.lit(False)).alias("has_settings"))


@query("t4_merged_summary", "SELECT namespace, count(*) AS n, min(size_bytes) AS lo, max(size_bytes) AS hi FROM req GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "summary")
    X.requests(spark, sf).select("namespace", "size_bytes", (F.col("event_id") % 3).alias("b")).write.partitionBy("b").parquet(f"{path}/in")
    t = merge.VersionedTable(spark, f"{path}/table", merge.SUMMARY, "namespace", 4)
    for b in (0, 1, 2, 1):  # as foreachBatch would hand them on, one of them twice
        t.apply(spark.read.parquet(f"{path}/in").where(F.col("b") == b).select("namespace", "size_bytes"), b, merge.add_summary)
    return t.read()
