"""What several corpus operators share: table reads, the shared folder, words as bytes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that part words in the corpus contracts.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of texts in an Arrow batch, at most: with Spark's default of 10,000, long texts would take much of an executor's memory.
TEXT_ROWS = 1_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """df as it is; its session's Arrow batches are from now on of TEXT_ROWS rows at most. A smaller setting stays."""
    spark = df.sparkSession
    if int(spark.conf.get(BATCH)) > TEXT_ROWS or int(spark.conf.get(BATCH)) <= 0:
        spark.conf.set(BATCH, TEXT_ROWS)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share; where it is unset (tests), one of our own, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gridspark-"))
            found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def let(value: Column, body) -> Column:
    """Binds value to a lambda variable, so that it is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null for a null text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def folded_table(keep: bytes) -> bytes:
    """A bytes.translate table: A-Z to lower case, bytes of keep and those from 0x80 stay, the others become spaces."""
    out = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in keep:
        out[b] = b
    for b in range(65, 91):
        out[b] = b + 32 if b + 32 in keep else 32
    return bytes(out)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df plus `i`, the place of a row in its group by `order` (from 0, nulls first), and `n`, the rows of the group.

    Rows are dealt by ranges of (group, order), so that a group of any size, and rows equal in all columns, spread over tasks; what is counted centrally is a row for each
    group and range. The result is checkpointed; its columns should be narrow. Columns named i, n, or beginning with __ are taken.
    """
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    told = df.withColumn("__tie", F.monotonically_increasing_id())
    dealt = told.repartitionByRange(*by, F.col("__tie")).sortWithinPartitions(*by, "__tie").drop("__tie")
    held = cut(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    parts = held.groupBy(*group, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    w = Window.partitionBy(*group)
    parts = parts.withColumn("n", F.sum("__rows").over(w)).withColumn("__before", F.sum("__rows").over(w.orderBy("__part")) - F.col("__rows"))
    parts = parts.select(*(F.col(c).alias(f"__g{k}") for k, c in enumerate(group)), F.col("__part").alias("__p"), "__first", "__before", "n")
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"__g{k}"))
    return held.join(parts, same).withColumn("i", F.col("__at") - F.col("__first") + F.col("__before")).select(*df.columns, "i", "n")


def crc_key(key: Column) -> Column:
    """The unsigned CRC-32 of a column written in decimal; null for a null."""
    return F.crc32(key.cast("string").cast("binary"))


#: CRC-32 of a short ASCII text in DuckDB, as a macro body: a CTE with the table of 256 remainders, and an expression that reads it as crc_t.t.
CRC_TABLE_SQL = """crc_t AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, c FROM (WITH RECURSIVE s(k, step, c) AS (SELECT k::BIGINT, 0, k::BIGINT FROM range(256) r(k)
    UNION ALL SELECT k, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM s WHERE step < 8) SELECT k, c FROM s WHERE step = 8)))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL of the CRC-32 of an ASCII text, where crc_t is in scope."""
    codes = f"list_transform(string_split_regex({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(a >> 8, crc_t.t[(xor(a, b) & 255) + 1])), 4294967295)"
