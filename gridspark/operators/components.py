"""Connected components of an edge table (u, v): each task joins what it reads, the rest goes by alternating large-star and small-star steps; a small rest is finished in one task."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many different edges at most (16 bytes each) are joined in one task; more take rounds over all tasks, which give the same result.
ONE_TASK = 1_000_000

#: Edges that a task joins at once before they meet those of other tasks.
PIECE = 500_000


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that all executors share. Where the session names none, a folder of our own serves a local master only."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridspark-"))
    return df.checkpoint(eager=True)


def label(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges, with root the least node of the component.

    Loops give their node alone, repeated edges count once, an empty table gives an empty one. Each task first joins the edges that it reads, in pieces of PIECE at most; only nodes
    that several pieces have link the pieces' roots, and those links go on: in one task if they are few, else in rounds, which grow with the logarithm of the
    longest chain and end in a checkpoint. Edges stay on the executors, only counts and a checksum come back.
    """
    rows = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u is not null")
    pieces = saved(rows.mapInArrow(_pieces, "node long, root long"))
    nodes = saved(pieces.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    shared = nodes.where("least < most").select("node", "least")
    links = saved(pieces.join(shared, "node").where("root <> least").select(F.col("root").alias("u"), F.col("least").alias("v")).distinct())
    if links.isEmpty():
        return nodes.select("node", F.col("least").alias("root"))
    over = _rounds(links) if links.count() > ONE_TASK else links.coalesce(1).mapInArrow(_joined, "node long, root long")
    over = over.select(F.col("node").alias("least"), "root")
    return nodes.join(over, "least", "left").select("node", F.coalesce("root", "least").alias("root"))


def _rounds(links: DataFrame) -> DataFrame:
    every, before = links, None
    while True:
        both = links.union(links.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        up = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()
        links = saved(down)
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if state == before:
            break
        before = state
    nodes = every.select(F.col("u").alias("node")).union(every.select("v")).distinct()
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _roots(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """The nodes of some edges with the least node that each is joined to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = top[a], top[b]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(top, up := top[top]):
            top = up
        apart = top[a] != top[b]
        a, b = a[apart], b[apart]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "root"])


def _pieces(batches):
    """The joined edges of a task, PIECE at a time."""
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= PIECE:
            yield _roots(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield _roots(*map(np.concatenate, zip(*held, strict=True)))


def _joined(batches):
    """All edges of the one task at once."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        yield _roots(*map(np.concatenate, zip(*held, strict=True)))
