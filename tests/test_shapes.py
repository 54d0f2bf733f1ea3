"""Simplification against recursion, its error bound, and outlines of cells with holes and corners."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import shapes


def off(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def split(line, lo, hi, tolerance):
    if hi - lo < 2:
        return set()
    far = max(range(lo + 1, hi), key=lambda i: (off(line[i], line[lo], line[hi]), -i))
    if off(line[far], line[lo], line[hi]) <= tolerance:
        return set()
    return {far} | split(line, lo, far, tolerance) | split(line, far, hi, tolerance)


def frame(spark, lines):
    return spark.createDataFrame([(k, i, *p) for k, line in lines.items() for i, p in enumerate(line)], "k long, i int, x double, y double")


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 3.0])
def test_simplified_lines(spark, tolerance):
    rnd = random.Random(1)
    lines = {}
    for k in range(12):
        x = y = 0.0
        lines[k] = []
        for _ in range(rnd.randint(1, 80)):
            x, y = x + rnd.uniform(-1, 2), y + rnd.uniform(-1, 1)
            lines[k].append((x, y))
    lines[99] = [(0.0, 0.0), (4.0, 0.1), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    got = {}
    for r in shapes.simplified(frame(spark, lines), "k", tolerance).collect():
        got.setdefault(r["k"], []).append(r["i"])
    for k, line in lines.items():
        stay = sorted(got[k])
        assert stay == sorted({0, len(line) - 1} | split(line, 0, len(line) - 1, tolerance))
        for a, b in zip(stay, stay[1:], strict=False):
            assert all(off(line[i], line[a], line[b]) <= tolerance for i in range(a + 1, b))


def test_lines_again(spark):
    lines = {1: [(0.0, 0.0), (1.0, 5.0), (2.0, 0.0)]}
    assert [(p["x"], p["y"]) for p in shapes.as_lines(shapes.simplified(frame(spark, lines), "k", 1.0), "k").first()["points"]] == lines[1]
    assert shapes.simplified(frame(spark, {1: []}).where("false"), "k", 1.0).count() == 0


def test_outlines_with_a_hole_and_a_corner(spark):
    solid = [(r, c) for r in range(5) for c in range(5) if not (r in (1, 2) and c in (1, 2))]
    corner = [(10, 10), (11, 11)]
    cells = spark.createDataFrame([("a", *p) for p in [*solid, *solid[:3]]] + [("b", *p) for p in corner] + [("c", 0, 5)], "label string, row int, col int")
    rings = shapes.outlines(cells, "label")
    sizes = {r["label"]: tuple(r)[1:] for r in shapes.outline_sizes(rings, "label").collect()}
    assert sizes == {"a": (2, 8, 21, 28), "b": (2, 8, 2, 8), "c": (1, 4, 1, 4)}
    by = {}
    for r in rings.where("label = 'a'").orderBy("k").collect():
        by.setdefault(r["ring"], []).append((r["x"], r["y"]))
    around = {frozenset(v) for v in by.values()}
    assert around == {frozenset({(0, 0), (5, 0), (5, 5), (0, 5)}), frozenset({(1, 1), (3, 1), (3, 3), (1, 3)})}
    for ring in by.values():  # neighbours in order share a coordinate
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))


def test_a_long_ring_is_numbered_in_few_rounds(spark, monkeypatch):
    n = 400
    comb = spark.range(n * 3).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.lit(1).alias("label")).where("row = 1 or col % 2 = 0")
    rounds, real = [], shapes.saved
    monkeypatch.setattr(shapes, "saved", lambda df: rounds.append(1) or real(df))
    sizes = shapes.outline_sizes(shapes.outlines(comb, "label"), "label").first()
    assert (sizes["rings"], sizes["area"]) == (1, 800)
    assert len(rounds) <= 4 + math.ceil(math.log2(sizes["perimeter"]))
