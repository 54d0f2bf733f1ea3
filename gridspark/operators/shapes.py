"""Geometry whose rows are vertices and edges, worked on in rounds over all lines or rings at once: simplification with an error bound, outlines of dissolved cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators import components
from gridspark.operators.components import saved


def vertices(lines: DataFrame, key: str, points: str) -> DataFrame:
    """(key, i, x, y) of an array of structs x, y."""
    return lines.select(key, F.posexplode(points).alias("i", "p")).select(key, "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0))), F.lit(0.0))))
    return F.sqrt(F.pow(x - ax - t * dx, F.lit(2)) + F.pow(y - ay - t * dy, F.lit(2)))


def simplified(points: DataFrame, key: str, tolerance: float) -> DataFrame:
    """The vertices (key, i, x, y) that stay: every one that goes lies within the tolerance of the part of its line that replaces it.

    A line begins as one piece from end to end. Each round all open pieces of all lines are split at their farthest vertex (the first of equals) while that lies beyond the
    tolerance: one aggregation and one join by piece, so neither a line nor its number of vertices is bound to a task. Rounds are as many as splits nest, and end in a checkpoint.
    Rings are lines whose ends meet.
    """
    ends = points.groupBy(F.col(key).alias("__k")).agg(*(f(F.struct("i", "x", "y")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))))
    kept = [ends.select(F.col("__k").alias(key), F.inline(F.array_distinct(F.array("a", "b"))))]
    rows = points.join(ends, F.col(key) == F.col("__k")).where((F.col("i") > F.col("a.i")) & (F.col("i") < F.col("b.i"))).drop("__k")
    rows = saved(rows)
    while not rows.isEmpty():
        d = segment_distance(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        far = rows.withColumn("__d", d).groupBy(F.col(key).alias("__k"), F.col("a.i").alias("__i")).agg(F.max_by(F.struct("i", "x", "y"), F.struct("__d", -F.col("i"))).alias("m"), F.max("__d").alias("__d"))
        far = saved(far.where(F.col("__d") > tolerance).drop("__d"))
        kept.append(far.select(F.col("__k").alias(key), "m.i", "m.x", "m.y"))
        j = rows.join(far, (F.col(key) == F.col("__k")) & (F.col("a.i") == F.col("__i"))).where(F.col("i") != F.col("m.i"))
        before = F.col("i") < F.col("m.i")
        rows = saved(j.select(key, "i", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b")))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def as_lines(points: DataFrame, key: str, name: str = "points") -> DataFrame:
    """(key, name): each line's vertices as one array, in order."""
    p = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("__p"))
    return p.select(key, F.transform("__p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias(name))


# Outlines ------------------------------------------------------------------------------------------


def border_edges(cells: DataFrame, label: str) -> DataFrame:
    """(label, x, y, d): unit edges between cells of a label and others, from corner (x, y) east, south, west or north (d 0 to 3; y runs down), the label on the right.

    An edge that two cells of a label share comes twice, and goes.
    """
    r, c = F.col("row"), F.col("col")
    edge = lambda x, y, vertical, d: F.struct(x.alias("x"), y.alias("y"), F.lit(vertical).alias("v"), F.lit(d).alias("d"))
    sides = F.array(edge(c, r, 0, 0), edge(c + 1, r, 1, 1), edge(c, r + 1, 0, 2), edge(c, r, 1, 3))
    e = cells.select(label, "row", "col").distinct().select(label, F.inline(sides)).groupBy(label, "x", "y", "v").agg(F.count("*").alias("n"), F.max("d").alias("d")).where("n = 1")
    return e.select(label, (F.col("x") + (F.col("d") == 2).cast("int")).alias("x"), (F.col("y") + (F.col("d") == 3).cast("int")).alias("y"), "d")


def outlines(cells: DataFrame, label: str) -> DataFrame:
    """The outlines of all labels' cells (label, row, col): (label, ring, k, x, y), the corners of each ring in order. Outer rings run clockwise as y runs down, holes the other way; where
    cells of a label meet at a corner only, the ring keeps to its own cell.

    Edges are chained by their corners, rings found as components, and edges numbered by pointer jumping: as many rounds as the longest ring's length has binary digits.
    """
    d = F.col("d")
    e = saved(border_edges(cells, label).withColumn("id", F.monotonically_increasing_id()))
    to = e.withColumn("__x", F.col("x") + F.when(d == 0, 1).when(d == 2, -1).otherwise(0)).withColumn("__y", F.col("y") + F.when(d == 1, 1).when(d == 3, -1).otherwise(0))
    out = e.select(F.col(label).alias("__l"), F.col("x").alias("__ox"), F.col("y").alias("__oy"), F.col("d").alias("__od"), F.col("id").alias("__oid"))
    j = to.join(out, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__x") == F.col("__ox")) & (F.col("__y") == F.col("__oy")))
    turn = F.pmod(F.col("__od") - d - 1, F.lit(4))  # right, ahead, back, left
    links = saved(j.groupBy("id", "d").agg(F.min_by(F.struct("__oid", "__od"), turn).alias("n")).select("id", F.col("n.__oid").alias("nxt"), (F.col("n.__od") != d).alias("bends")))
    rings = components.label(links.select(F.col("id").alias("u"), F.col("nxt").alias("v"))).select(F.col("node").alias("id"), F.col("root").alias("ring"))
    # A ring is cut before its first edge; left counts the edges behind one.
    at = saved(links.join(rings, "id").select("id", "ring", F.nullif("nxt", F.col("ring")).alias("nxt")).withColumn("left", F.col("nxt").isNotNull().cast("long")))
    while not at.where("nxt is not null").isEmpty():
        ahead = at.select(F.col("id").alias("__id"), F.col("nxt").alias("__n"), F.col("left").alias("__left"))
        at = saved(at.join(ahead, F.col("nxt") == F.col("__id"), "left").select("id", "ring", F.col("__n").alias("nxt"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left")))
    length = at.groupBy("ring").agg(F.count("*").alias("__len"))
    corners = links.where("bends").select(F.col("nxt").alias("id"))
    return e.join(at, "id").join(length, "ring").join(corners, "id", "left_semi").select(label, "ring", (F.col("__len") - 1 - F.col("left")).alias("k"), "x", "y")


def outline_sizes(rings: DataFrame, label: str) -> DataFrame:
    """(label, rings, corners, area, perimeter) out of outlines: signed areas, so that holes take away."""
    from pyspark.sql import Window

    w = Window.partitionBy("ring").orderBy("k")
    whole = Window.partitionBy("ring").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = rings.withColumn("__x", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("__y", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    area = F.sum(F.col("x") * F.col("__y") - F.col("__x") * F.col("y")) / 2
    return s.groupBy(label).agg(F.countDistinct("ring").alias("rings"), F.count("*").alias("corners"), area.cast("long").alias("area"), F.sum(F.abs(F.col("__x") - F.col("x")) + F.abs(F.col("__y") - F.col("y"))).cast("long").alias("perimeter"))


def dissolved(members: DataFrame, label: str, cells: DataFrame, key: str) -> DataFrame:
    """Outlines of dissolved features: members (key, label) say what belongs together, cells (key, row, col) what each covers."""
    return outlines(cells.join(members.select(key, label), key).select(label, "row", "col"), label)
