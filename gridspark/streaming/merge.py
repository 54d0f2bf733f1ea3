"""Change batches merged into versioned tables: each batch once, whatever is replayed, with a report of what it did.

A table lies in `parts` parts by a hash of its key. A version is a list of folders, one a part; a batch rewrites the parts that it touches into folders of its own and then commits by
writing one small file that names the version, the batch and the folders. Readers see whole versions. A batch that died before its commit is done again from
the version before; a batch that is committed is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, batch long, part int, folder string"


@dataclass
class VersionedTable:
    """path must lie where all executors write. schema is the rows' DDL, key its key column."""

    spark: SparkSession
    path: str
    schema: str
    key: str
    parts: int = 16

    def part(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key)), F.lit(self.parts)).cast("int")

    def commits(self) -> DataFrame:
        """All committed versions: a row a part, and one with part -1 for the batch itself. An empty log before the first commit."""
        jvm = self.spark.sparkContext._jvm
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not log.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(log):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/log")

    def version(self) -> int:
        return self.commits().agg(F.max("version")).first()[0] or 0

    def has_batch(self, batch: int) -> bool:
        return not self.commits().where((F.col("batch") == batch) & (F.col("part") == -1)).isEmpty()

    def folders(self, version: int) -> dict[int, str]:
        """The newest folder of each part at a version; `parts` rows at most."""
        rows = self.commits().where((F.col("version") <= version) & (F.col("part") >= 0)).groupBy("part").agg(F.max_by("folder", "version").alias("folder")).collect()
        return {r["part"]: r["folder"] for r in rows}

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        found = self.folders(self.version() if version is None else version)
        paths = [f for p, f in found.items() if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def commit(self, batch: int, rows: DataFrame | None, touched: list[int]) -> int:
        """Writes rows as the new content of the touched parts, then the commit file."""
        version = self.version() + 1
        root = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        if rows is not None and touched:
            rows.withColumn("part", self.part()).repartition(self.parts, "part").write.partitionBy("part").parquet(root)
            filled = self.spark.read.schema(f"{self.schema}, part int").parquet(root).select("part").distinct()
            for p in set(touched) - {r["part"] for r in filled.collect()}:  # a part that lost all its rows
                self.spark.createDataFrame([], self.schema).coalesce(1).write.parquet(f"{root}/part={p}")
        entries = [(version, batch, p, f"{root}/part={p}") for p in touched] + [(version, batch, -1, "")]
        self.spark.createDataFrame(entries, COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def apply(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merges a batch (it has the key column) into the parts that it touches: merge(current rows of those parts, batch) gives their new rows. False if it was committed before."""
        if self.has_batch(batch_id):
            return False
        touched = sorted(r[0] for r in batch.select(self.part().alias("p")).distinct().collect())
        self.commit(batch_id, merge(self.read(only=touched), batch) if touched else None, touched)
        return True


OUTCOME = "batch long, name string, op string, found boolean, affected boolean"


def last_changes(changes: DataFrame, exists: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key of changes (key, seq, op, columns): the last op, its columns, and found: whether the key existed just before it, by the changes before and the keys of exists.

    op is put, update or delete. A key with any number of changes is aggregated, never listed.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", "seq", *columns), "seq").alias("__l"))
    before = changes.join(last.select(F.col(key).alias("__k"), F.col("__l.seq").alias("__s")), F.col(key) == F.col("__k")).where((F.col("seq") < F.col("__s")) & (F.col("op") != "update"))
    before = before.groupBy(F.col(key).alias("__b")).agg(F.max_by("op", "seq").alias("__before"))
    had = exists.select(F.col(key).alias("__h")).distinct()
    j = last.join(before, F.col(key) == F.col("__b"), "left").join(had, F.col(key) == F.col("__h"), "left")
    found = F.coalesce(F.col("__before") == "put", F.col("__h").isNotNull())
    return j.select(key, F.col("__l.op").alias("op"), found.alias("found"), *(F.col(f"__l.{c}").alias(c) for c in columns))


@dataclass
class Registry:
    """Regions with their settings, and a report, kept by change batches (name, seq, op, columns of regions)."""

    regions: VersionedTable
    settings: VersionedTable
    report: VersionedTable

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        """For foreachBatch: puts, updates and deletes by name; settings of deleted regions go with them; the report gets a row for each name.

        Each of the three tables commits the batch on its own, the regions last: what a restart finds done it leaves, and works the rest out from the same regions.
        """
        t, columns = self.regions, [c for c in _names(self.regions.schema) if c != self.regions.key]
        if t.has_batch(batch_id):
            return
        touched = sorted(r[0] for r in changes.select(t.part().alias("p")).distinct().collect())
        current = t.read(only=touched)
        last = last_changes(changes, current, t.key, columns)
        told = last.select(F.lit(batch_id).cast("long").alias("batch"), F.col(t.key).alias("name"), "op", "found", (F.col("found") | (F.col("op") == "put")).alias("affected"))
        self.report.apply(told, batch_id, lambda old, new: old.unionByName(new))
        gone = last.where("op = 'delete' and found").select(F.col(t.key).alias(self.settings.key))
        self.settings.apply(gone, batch_id, lambda old, new: old.join(new, self.settings.key, "left_anti"))
        kept = current.join(last.where("op = 'put' or found").select(t.key), t.key, "left_anti")
        put = last.where("op = 'put' or (op = 'update' and found)").select(current.columns)
        t.commit(batch_id, kept.unionByName(put) if touched else None, touched)

    def follow(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _names(ddl: str) -> list[str]:
    from pyspark.sql import types as T

    return T.DataType.fromDDL(ddl).fieldNames()


def registry_at(spark: SparkSession, path: str, columns: str = "v long", parts: int = 16) -> Registry:
    return Registry(
        VersionedTable(spark, f"{path}/regions", f"name string, {columns}", "name", parts), VersionedTable(spark, f"{path}/settings", "name string, settings string", "name", parts), VersionedTable(spark, f"{path}/report", OUTCOME, "name", parts),
    )


SUMMARY = "namespace string, n long, lo long, hi long"


def add_summary(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Per namespace: stored and new counts and extremes of size_bytes as one."""
    new = batch.groupBy("namespace").agg(F.count("*").alias("n"), F.min("size_bytes").alias("lo"), F.max("size_bytes").alias("hi"))
    return old.unionByName(new).groupBy("namespace").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
