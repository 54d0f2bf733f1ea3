"""Joins of points and boxes on the leaves of an adaptive quadtree: a crowded place is cut into many leaves, and so into many tasks.

A tree is the set of its inner nodes, those that hold more than a leaf's share of rows. It comes from one aggregation of counts over all levels, has at most depth * LEAVES rows, and
is broadcast; rows then walk down it level by level. Points end in one leaf, boxes in each leaf that they meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.operators.components import saved

#: Leaves that a tree is made for: a leaf may hold this share of all rows whatever was asked for, which bounds the tree's size. An inner node of 16 bytes
#: holds more than that, so there are at most LEAVES on each of 16 levels.
LEAVES = 1 << 16
DEPTH = 16


def interleave(x: Column, y: Column) -> Column:
    """The bits of two whole numbers under 2**16, y's above x's."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


@dataclass
class Tree:
    low: tuple[float, float]
    size: tuple[float, float]
    depth: int
    levels: int
    inner: DataFrame

    def place(self, v: Column, axis: int) -> Column:
        """The fine column (axis 0) or row of a coordinate; beyond the tree's box the first or last."""
        top = (1 << self.depth) - 1
        return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - self.low[axis]) / self.size[axis] * (top + 1)))).cast("int")


def grow(boxes: DataFrame, most: int, x: str | tuple[str, str] = "x", y: str | tuple[str, str] = "y") -> Tree:
    """A tree whose leaves hold `most` rows of boxes or fewer, by the middle of (x0, x1) and (y0, y1), or by the points (x, y).

    Leaves are not cut smaller than the boxes are on average, where most boxes would lie in several. Rows without coordinates take no part. One row of extents and
    one number go to the driver.
    """
    (x0, x1), (y0, y1) = ((c, c) if isinstance(c, str) else c for c in (x, y))
    s = boxes.agg(F.min(x0), F.max(x1), F.min(y0), F.max(y1), F.avg(F.col(x1) - F.col(x0)), F.avg(F.col(y1) - F.col(y0)), F.count("*")).first()
    if s[0] is None or s[2] is None:
        return Tree((0.0, 0.0), (1.0, 1.0), 1, 0, boxes.sparkSession.createDataFrame([], "level int, cell long"))
    low, size = (float(s[0]), float(s[2])), tuple(float(b - a) or 1.0 for a, b in ((s[0], s[1]), (s[2], s[3])))
    depth = DEPTH
    for whole, mean in zip(size, s[4:6], strict=True):
        while depth > 1 and mean and whole / (1 << depth) < mean:
            depth -= 1
    most = max(most, s[6] // LEAVES)
    tree = Tree(low, size, depth, 0, None)
    if s[6] <= most:
        return Tree(low, size, depth, 0, boxes.sparkSession.createDataFrame([], "level int, cell long"))
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    fine = boxes.where(F.col(x0).isNotNull() & F.col(x1).isNotNull() & F.col(y0).isNotNull() & F.col(y1).isNotNull()).groupBy(interleave(tree.place(middle(x0, x1), 0), tree.place(middle(y0, y1), 1)).alias("z")).agg(F.count("*").alias("n"))
    up = fine.select("n", "z", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("level")).groupBy("level", F.expr(f"shiftright(z, 2 * ({depth} - level))").alias("cell")).agg(F.sum("n").alias("n"))
    tree.inner = saved(up.where(F.col("n") > most).select("level", "cell"))
    tree.levels = (tree.inner.agg(F.max("level")).first()[0] + 1) if not tree.inner.isEmpty() else 0
    return tree


def on_leaves(df: DataFrame, tree: Tree, x0: str, x1: str, y0: str, y1: str) -> DataFrame:
    """df with a row for each leaf that a box meets (edges included), plus __leaf, and the fine places __ax .. __by of its ends. Points have x0 = x1."""
    rows = df.withColumns({"__ax": tree.place(F.col(x0), 0), "__bx": tree.place(F.col(x1), 0), "__ay": tree.place(F.col(y0), 1), "__by": tree.place(F.col(y1), 1)})
    rows = rows.withColumns({"__level": F.lit(0), "__cx": F.lit(0), "__cy": F.lit(0)})
    kept = [*df.columns, "__ax", "__bx", "__ay", "__by"]
    for level in range(tree.levels):
        shift = tree.depth - level - 1
        here = F.broadcast(tree.inner.where(F.col("level") == level).select(F.col("cell").alias("__cell")))
        open_ = F.when(F.col("__level") == level, interleave(F.col("__cx"), F.col("__cy")))
        child = lambda c, a, b, shift=shift: F.sequence(F.greatest(F.col(c) * 2, F.shiftright(a, shift)), F.least(F.col(c) * 2 + 1, F.shiftright(b, shift)))
        hit = F.col("__cell").isNotNull()
        stay = lambda c: F.array(F.col(c))
        rows = rows.withColumn("__open", open_).join(here, F.col("__open") == F.col("__cell"), "left")
        rows = rows.withColumn("__xs", F.when(hit, child("__cx", F.col("__ax"), F.col("__bx"))).otherwise(stay("__cx"))).withColumn("__ys", F.when(hit, child("__cy", F.col("__ay"), F.col("__by"))).otherwise(stay("__cy")))
        rows = rows.select(*kept, F.when(hit, level + 1).otherwise(F.col("__level")).alias("__level"), "__ys", F.explode("__xs").alias("__cx")).select(*kept, "__level", "__cx", F.explode("__ys").alias("__cy"))
    leaf = F.col("__level").cast("long") * (1 << 32) + interleave(F.col("__cx"), F.col("__cy"))
    return rows.select(*kept, leaf.alias("__leaf"), "__level", "__cx", "__cy")


def met(a: DataFrame, b: DataFrame, tree: Tree, a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str], equal: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of rows of a and b whose closed boxes (x0, x1, y0, y1) meet and that are equal in pairs of columns; column names are different. A pair
    comes once, in the leaf that holds the lower left corner of what the boxes share."""
    p = on_leaves(a, tree, *a_box)
    q = on_leaves(b, tree, *b_box)
    q = q.select(*b.columns, "__leaf", *(F.col(c).alias(f"__o{c}") for c in ("__ax", "__ay")))
    j = p.join(q.withColumnRenamed("__leaf", "__q"), (F.col("__leaf") == F.col("__q")) & _equal(equal))
    (ax0, ax1, ay0, ay1), (bx0, bx1, by0, by1) = a_box, b_box
    j = j.where((F.col(ax0) <= F.col(bx1)) & (F.col(bx0) <= F.col(ax1)) & (F.col(ay0) <= F.col(by1)) & (F.col(by0) <= F.col(ay1)))
    s = F.lit(tree.depth) - F.col("__level")
    cell = lambda u, v: F.floor(F.greatest(F.col(u), F.col(v)) / F.pow(F.lit(2.0), s)).cast("int")
    home = (cell("__ax", "__o__ax") == F.col("__cx")) & (cell("__ay", "__o__ay") == F.col("__cy"))
    return j.where(home).select(*a.columns, *b.columns)


def _equal(pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(True)
    for x, y in pairs:
        out &= F.col(x) == F.col(y)
    return out
