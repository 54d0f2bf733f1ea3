"""Unique names: each row gets its base or the first free `base_2`, `base_3`, ..., as if rows came one by one, without going through them one by one.

A base's rows take its free numbers in order (1 is the base itself). Numbers are not free that existing names hold, or that rows which name `base_k` themselves took in time. So
ranks come from counts of ranges, only the explicitly numbered names are walked, a family of them at a time, and gaps are added by comparing ranks with few limits.
"""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.operators.components import saved

#: Keys drawn for each range.
RANGE_SAMPLE = 50
#: Of the keys, every such one by its hash is enough for ranges if it leaves LEAST_DRAWN a range.
DRAWN, LEAST_DRAWN = 512, 5
NUMBERED = r"^(.*)_([1-9][0-9]*)$"
FAMILY = "(_[1-9][0-9]*)+$"


def bounds_of(df: DataFrame, order: str) -> list:
    """Values of the order column that part it into ranges, from a bounded number of keys that are drawn by their hash: of every DRAWN-th if these suffice, else of all."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(F.col(order).alias("k")).where("k is not null")
    for every in (DRAWN, 1):
        some = keys.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct()
        drawn = [r["k"] for r in some.orderBy(F.xxhash64("k")).limit(parts * RANGE_SAMPLE).orderBy("k").collect()]
        if len(drawn) >= parts * LEAST_DRAWN:
            break
    return sorted({drawn[len(drawn) * i // parts] for i in range(1, parts)}) if drawn else []


def in_ranges(df: DataFrame, order: str, bounds: list) -> DataFrame:
    """df plus __range, the number of bounds below the order column (0 for nulls). A row is compared with every n-th bound, then with those after the last one below it."""
    if not bounds:
        return df.withColumn("__range", F.lit(0))
    n = math.isqrt(len(bounds)) + 1
    kind = df.schema[order].dataType
    lit = lambda b: F.lit(b).cast(kind)
    above = lambda bs: reduce(lambda t, b: t + F.coalesce((F.col(order) > b).cast("int"), F.lit(0)), bs, F.lit(0))
    df = df.withColumn("__block", above([lit(b) for b in bounds[n - 1 :: n]]))
    inner = above([F.get(F.array(*map(lit, bounds[j::n])), F.col("__block")) for j in range(n - 1)])
    return df.withColumn("__range", F.col("__block") * n + inner).drop("__block")


def counted(rows: DataFrame, base: str) -> DataFrame:
    """(b, r, n): rows of each base in each range, saved; a base that is null is left out. Rows whose __row is false count 0."""
    return saved(rows.where(F.col(base).isNotNull()).groupBy(F.col(base).alias("b"), F.col("__range").alias("r")).agg(F.sum(F.col("__row").cast("long")).alias("n")))


def ranks(counts: DataFrame) -> DataFrame:
    """(b, r, lo, hi): the ranks before and at the end of each base's range."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return counts.select("b", "r", before.alias("lo"), (before + F.col("n")).alias("hi"))


def ranked(rows: DataFrame, base: str, order: str, info: DataFrame) -> DataFrame:
    """rows (with __row true for those that count) plus __rank, how many rows of the base come up to and with this one, and the columns of info (b, r, lo, ...)."""
    w = Window.partitionBy(base, "__range").orderBy(F.asc_nulls_first(order), F.desc("__row")).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumn("__inner", F.sum(F.col("__row").cast("long")).over(w))
    info = info.select(*(F.col(c).alias(f"__{c}") for c in info.columns))
    return inner.join(info, (F.col(base) == F.col("__b")) & (F.col("__range") == F.col("__r")), "left").withColumn("__rank", F.col("__inner") + F.col("__lo"))


def taken(held: dict[str, list[int]], claims: dict[str, list[tuple[int, int, str]]]) -> dict[str, list[int]]:
    """Numbers that are not free, sorted, for each base of a family. held: numbers that existing names hold (1 is the base itself); claims: for each base the rows
    that name `base_k` themselves, as (rows of the base before it, k, that name).

    A claim is met unless k is held or the base's rows have used it up by then; a name whose claim fails is not free for its own first row.
    """
    out, failed = {}, set()
    depth = lambda b: (b.count("_"), b)
    for base in sorted({*held, *claims, *(c[2] for cs in claims.values() for c in cs)}, key=depth):
        blocked = sorted({*held.get(base, ()), *([1] if base in failed else [])})
        for before, k, name in sorted(claims.get(base, ())):
            at = bisect_right(blocked, k)
            if (at and blocked[at - 1] == k) or k - at <= before:
                failed.add(name)
            else:
                insort(blocked, k)
        out[base] = blocked
    return out


def unique_names(df: DataFrame, base: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """df plus name, its base or the first free numbered one; existing has a column name. Rows go by order (nulls first); rows equal in base and order are interchangeable.

    A null base stays null. A frequent base is many tasks, and so are equal keys of many bases; one family's explicitly numbered names (`x_2`, `x_2_5`, ...) are walked in one task.
    """
    spark = df.sparkSession
    existing = existing if existing is not None else spark.createDataFrame([], "name string")
    bounds = bounds_of(df, order)
    rows = in_ranges(df.withColumn("__row", F.lit(True)).withColumn("__name", F.lit(None).cast("string")), order, bounds)
    counts = counted(rows, base)
    bases = counts.select("b").distinct()
    parent, number = F.regexp_extract("b", NUMBERED, 1), F.regexp_extract("b", NUMBERED, 2).try_cast("long")
    claims = saved(bases.where(number >= 2).select("b", parent.alias("p"), number.alias("k")).join(bases.select(F.col("b").alias("p")), "p", "left_semi"))
    # What existing names hold: a base itself, or a number of one.
    names = saved(existing.select(F.col("name").alias("b")).where("b is not null").distinct())
    own = names.join(bases, "b", "left_semi").select("b", F.lit(1).cast("long").alias("k"))
    held = names.select(parent.alias("b"), number.alias("k")).where("k >= 2").join(bases, "b", "left_semi").union(own)
    told = None
    if not claims.isEmpty():
        # Claims stand in their base's order before the row that makes them would take a number.
        first = df.select(F.col(base).alias("b"), F.struct(order).alias("t")).join(claims.select("b"), "b", "left_semi").groupBy("b").agg(F.min_by("t", F.struct(F.col(f"t.{order}").isNotNull(), f"t.{order}")).alias("t"))
        made = claims.join(first, "b")
        marks = made.select(*(F.col("t")[order].alias(c) if c == order else F.col("p").alias(c) if c == base else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns), F.lit(False).alias("__row"), F.col("b").alias("__name"))
        marks = saved(in_ranges(marks, order, bounds))
        rows = rows.unionByName(marks)
        counts = saved(counts.union(marks.select(F.col(base), "__range", F.lit(0).cast("long"))).groupBy("b", "r").agg(F.sum("n").alias("n")))
        asked = rows.join(claims.select(F.col("p").alias(base)).distinct(), base, "left_semi")
        told = ranked(asked, base, order, ranks(counts)).where(~F.col("__row")).select(F.col(base).alias("b"), F.regexp_extract("__name", NUMBERED, 2).cast("long").alias("k"), F.col("__rank").alias("m"), F.col("__name").alias("c"))
    blocked = held.select("b", "k") if told is None else _walked(held, told)
    # The rank after which each number is jumped over.
    limits = blocked.distinct().withColumn("f", F.col("k") - F.row_number().over(Window.partitionBy("b").orderBy("k"))).select("b", "f")
    info = ranks(counts)
    jumps = info.join(limits, "b").groupBy("b", "r").agg(F.count_if(F.col("f") <= F.col("lo")).alias("past"), F.collect_list(F.when((F.col("f") > F.col("lo")) & (F.col("f") < F.col("hi")), F.col("f"))).alias("fs"))
    # A row a base and range, with few numbers: rows meet it once, where they are ranked.
    info = saved(info.select("b", "r", "lo").join(jumps, ["b", "r"], "left"))
    j = ranked(rows, base, order, info).where("__row")
    n = F.col("__rank") + F.coalesce(F.col("__past") + F.size(F.filter("__fs", lambda f: f < F.col("__rank"))), F.lit(0))
    return j.withColumn("__at", n).select(*df.columns, F.when(F.col("__at") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("__at").cast("string"))).alias("name"))


def _walked(held: DataFrame, claims: DataFrame) -> DataFrame:
    """(b, k): numbers that are not free, by the walk over each family's claims."""

    def walk(it):
        rows = (r for batch in it for r in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
        for _, family in groupby(rows, key=lambda r: r[0]):
            have: dict[str, list[int]] = {}
            want: dict[str, list[tuple[int, int, str]]] = {}
            for _, b, k, m, c in family:
                if c is None:
                    have.setdefault(b, []).append(k)
                else:
                    want.setdefault(b, []).append((m, k, c))
            out = [(b, k) for b, ks in taken(have, want).items() for k in ks]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64())], names=["b", "k"])

    family = F.regexp_replace("b", FAMILY, "").alias("family")
    rows = held.select(family, "b", "k", F.lit(None).cast("long").alias("m"), F.lit(None).cast("string").alias("c")).unionByName(claims.select(family, "b", "k", "m", "c"))
    return rows.repartition("family").sortWithinPartitions("family").mapInArrow(walk, "b string, k long")


def import_regions(rows: DataFrame, order: str, existing: DataFrame) -> DataFrame:
    """Regions of texts (name, north, south, east, west, and rotation, which may be null or empty) to be added to existing ones (name): (order, name, north, south, east, west, settings).

    Names are trimmed; rows without a name, with a bound or rotation that is no number, or whose north is not above the south are left out. Settings hold a rotation other than 0.
    """
    bounds = {c: F.trim(F.col(c)).try_cast("double") for c in ("north", "south", "east", "west")}
    turn = F.when(F.coalesce(F.trim("rotation"), F.lit("")) == "", F.lit(0.0)).otherwise(F.trim("rotation").try_cast("double"))
    name = F.regexp_replace("name", r"^\s+|\s+$", "")
    r = rows.select(order, name.alias("base"), *(x.alias(c) for c, x in bounds.items()), turn.alias("rotation"))
    r = r.where((F.coalesce("base", F.lit("")) != "") & F.col("rotation").isNotNull()).dropna(subset=["north", "south", "east", "west"])
    r = r.where(~((F.col("north") <= F.col("south")) & ~F.isnan("north") & ~F.isnan("south")))
    settings = F.when(F.col("rotation") != 0, F.concat(F.lit('{"rotation": '), F.col("rotation").cast("string"), F.lit("}"))).otherwise("{}")
    return unique_names(r, "base", order, existing).select(order, "name", "north", "south", "east", "west", settings.alias("settings"))
