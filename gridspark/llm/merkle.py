"""A Merkle manifest of the data set: a postorder append log of ternary trees, one a source, and one over the sources.

Leaves are numbered in their source by ranges. Aligned builders, one for each block of 3**BLOCK consecutive nodes, write their subtree's nodes to the block's
log in the order in which they are complete, that is in postorder, holding one open run a level. The blocks' roots are the leaves of the next tier, until
one node a source is left; those are the leaves of the tree over all sources. A proof is read from the logs: subtree sizes give the place of any node
in postorder in closed form, so a sibling is addressed without a search. Every log is checkpointed in the shared folder.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import CRC_TABLE_SQL, crc_key, crc_sql, cut, numbered, table

FAN = 3
#: Levels of a builder's subtree; a block has FAN ** BLOCK nodes, a builder's log up to half as many again, of 32 bytes.
BLOCK = 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(*digests: bytes) -> bytes:
    """H of digests, which go in as hex text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def levels(n: int) -> int:
    """Levels above n leaves until one node is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def position(level: int, j: int, leaves: int, height: int) -> int:
    """The place in postorder (from 0) of node j of a level, in a tree of `height` levels over `leaves` leaves.

    Before it come all nodes of its level and below that end where it ends or earlier, and those above that end where it begins or earlier.
    """
    start, end = j * FAN**level, min((j + 1) * FAN**level, leaves)
    return sum(-(-end // FAN**t) for t in range(level + 1)) + sum(start // FAN**t for t in range(level + 1, height + 1)) - 1


class Builder:
    """Takes leaves in order; log holds the nodes as they are completed."""

    def __init__(self, height: int):
        self.runs: list[list[bytes]] = [[] for _ in range(height)]
        self.log: list[bytes] = []

    def add(self, digest: bytes, level: int = 0) -> None:
        self.log.append(digest)
        if level < len(self.runs):
            self.runs[level].append(digest)
            if len(self.runs[level]) == FAN:
                self.close(level)

    def close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.add(joined(*run), level + 1)

    def finish(self) -> list[bytes]:
        for level, run in enumerate(self.runs):
            if self.runs[level]:
                self.close(level)
        return self.log


def siblings(log: list[bytes], j: int, leaves: int, height: int) -> list[dict]:
    """For each level, from leaf j to below the root: the other nodes of its run before it and after it, joined, out of the log."""
    out = []
    for level in range(height):
        count, run = -(-leaves // FAN**level), j - j % FAN
        at = lambda k: log[position(level, k, leaves, height)]  # noqa: B023, E731
        out.append({"left": b"".join(map(at, range(run, j))), "right": b"".join(map(at, range(j + 1, min(run + FAN, count))))})
        j //= FAN
    return out


def fold(leaf: bytes, steps: list[dict]) -> bytes:
    for s in steps:
        leaf = sha256((s["left"].hex() + leaf.hex() + s["right"].hex()).encode()).digest()
    return leaf


def proof_digest(steps: list[dict]) -> str:
    return sha256("".join(s["left"].hex() + s["right"].hex() for s in steps).encode()).hexdigest()


STEPS = "array<struct<left:binary,right:binary>>"
LOG = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("height", pa.int32()), ("log", pa.list_(pa.binary()))])
LOG_DDL = "g string, block bigint, n bigint, m bigint, height int, log array<binary>"
STEP_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def write_log(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The logs of the blocks of one tier: g, block, n (nodes of the next tier), m (leaves of the block), height, log.

    nodes: g, i (place in g), n (nodes of g), digest. One node alone in its g stays as it is.
    """
    size = FAN**block

    def built(it):
        key, tool, m, done = None, None, 0, []

        def put():
            done.append({"g": key[0], "block": key[1], "n": -(-key[2] // size), "m": m, "height": len(tool.runs), "log": tool.finish()})

        for batch in it:
            for g, i, n, digest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key is None or (g, i // size, n) != key:
                    if key is not None:
                        put()
                    key, tool, m = (g, i // size, n), Builder(min(block, levels(n))), 0
                tool.add(digest)
                m += 1
                if len(done) == 64:
                    yield pa.RecordBatch.from_pylist(done, LOG)
                    done = []
        if key is not None:
            put()
        if done:
            yield pa.RecordBatch.from_pylist(done, LOG)

    b = F.floor(F.col("i") / size)
    ordered = nodes.select("g", "i", "n", "digest").repartition("g", b).sortWithinPartitions("g", "i")
    return ordered.mapInArrow(built, LOG_DDL)


def tiers(nodes: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """The logs of all tiers over nodes, lowest first; each g has one block in the last. One number, the most nodes of a g, goes to the driver."""
    most, out = nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        out.append(cut(write_log(nodes, block)))
        if most <= FAN**block:
            return out
        most = -(-most // FAN**block)
        nodes = out[-1].select("g", F.col("block").alias("i"), "n", F.element_at("log", -1).alias("digest"))


#: What a row in the stream of proofs can hold: kind 0 is what lies above a block, kind 1 its log, kind 2 a node that wants its proof.
PARTS = {"g": "string", "block": "bigint", "kind": "int", "i": "bigint", "m": "bigint", "height": "int", "log": "array<binary>", "up": STEPS, "subroot": "binary", "leaf": "binary", "tampered": "binary"}


def prove(nodes: DataFrame, logs: DataFrame, above: DataFrame | None, what: str, block: int = BLOCK) -> DataFrame:
    """Proofs of nodes (g, i, and for what='leaf' key, leaf, tampered) out of a tier's logs; above has the steps over each block's root (g, i, up, subroot).

    what='node' gives g, i, up, subroot; what='leaf' gives key, leaf, subroot, proof_sha256 and folded (the root recomputed from tampered, where that isn't null, else leaf).
    All rows of a block meet in one task and pass in order; one block's log is held.
    """
    size, last = FAN**block, what == "leaf"
    key_type = nodes.schema["key"].dataType.simpleString() if last else "int"
    columns = PARTS | {"key": key_type}
    shaped = lambda df, **have: df.select(*(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
    c = F.col
    rows = shaped(logs, g=c("g"), block=c("block"), kind=F.lit(1), m=c("m"), height=c("height"), log=c("log"))
    if above is not None:
        rows = rows.union(shaped(above, g=c("g"), block=c("i"), kind=F.lit(0), up=c("up"), subroot=c("subroot")))
    more = {"key": c("key"), "leaf": c("leaf"), "tampered": c("tampered")} if last else {}
    rows = rows.union(shaped(nodes, g=c("g"), block=F.floor(c("i") / size), kind=F.lit(2), i=c("i"), **more))
    at, alone = {name: k for k, name in enumerate(columns)}, above is None

    def proved(it):
        up, subroot, log, m, height = [], None, [], 0, 0
        for batch in it:
            col = {name: batch.column(k) for name, k in at.items()}
            wanted = {name: col[name].to_pylist() for name in ("g", "kind", "i", "leaf", "tampered", "key")}
            out = []
            for r, kind in enumerate(wanted["kind"]):
                if kind == 0:
                    up, subroot = col["up"][r].as_py(), col["subroot"][r].as_py()
                elif kind == 1:
                    if alone:
                        up, subroot = [], None
                    log, m, height = col["log"][r].as_py(), col["m"][r].as_py(), col["height"][r].as_py()
                else:
                    steps = siblings(log, wanted["i"][r] % size, m, height) + up
                    own = subroot or log[-1]  # without what lies above, the block's root is the group's
                    if last:
                        leaf, tampered = wanted["leaf"][r], wanted["tampered"][r]
                        out.append({"key": wanted["key"][r], "leaf": leaf.hex(), "subroot": own.hex(), "proof_sha256": proof_digest(steps), "folded": fold(leaf if tampered is None else tampered, steps).hex()})
                    else:
                        out.append({"g": wanted["g"][r], "i": wanted["i"][r], "up": steps, "subroot": own})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema(batch.schema.field(at["key"]).type))

    def schema(key):
        if last:
            return pa.schema([("key", key), *((x, pa.string()) for x in ("leaf", "subroot", "proof_sha256", "folded"))])
        return pa.schema([("g", pa.string()), ("i", pa.int64()), ("up", STEP_TYPE), ("subroot", pa.binary())])

    ddl = f"key {key_type}, leaf string, subroot string, proof_sha256 string, folded string" if last else f"g string, i bigint, up {STEPS}, subroot binary"
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "kind", "i").mapInArrow(proved, ddl)


def row_hash(columns: list[Column]) -> Column:
    """H of columns as text, each `-` if null, else its UTF-8 byte count, `:` and itself; as 32 bytes."""
    told = [F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (c.cast("string") for c in columns)]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def inner_nodes(logs: list[DataFrame]) -> list[DataFrame]:
    """What each tier's logs offer as nodes to the tier above."""
    return [x.select("g", F.col("block").alias("i"), "n", F.element_at("log", -1).alias("digest")) for x in logs]


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", columns: tuple[str, ...] = COLUMNS, tampered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each row of docs: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: the hash (32 bytes, see row_hash) of what a reader holds in place of the row, null where that is the row itself. Null values are hashed as `-`; rows with a null
    key come first in their source, rows with a null source are a source of their own that comes first. Rows that share the key are ordered by leaf; rows equal in all columns have equal
    leaves, each with a place and a proof of its own. Empty texts have the byte count 0, very long ones are hashed whole. An empty table gives no rows; columns not named are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("g"), row_hash([F.col(c) for c in columns]).alias("leaf"), (F.lit(None) if tampered is None else tampered).cast("binary").alias("tampered"))
    leaves = numbered(rows, ["g"], ["key", "leaf"])
    logs = tiers(leaves.withColumnRenamed("leaf", "digest"), block)
    subroots = logs[-1].select("g", F.element_at("log", -1).alias("digest"))
    over = numbered(subroots, [], ["g"]).select(F.lit(None).cast("string").alias("g"), "i", "n", "digest", F.col("g").alias("of"))
    over_logs = tiers(over, block)
    root = over_logs[-1].select(F.hex(F.element_at("log", -1)).alias("root")).withColumn("root", F.lower("root"))
    above = None
    for k in range(len(over_logs) - 1, 0, -1):
        above = cut(prove(inner_nodes(over_logs)[k - 1], over_logs[k], above, "node", block))
    if above is not None:
        above = above.withColumn("subroot", F.lit(None).cast("binary"))
    tops = prove(over, over_logs[0], above, "node", block).select("i", "up").join(over.select("i", "of", "digest"), "i")
    # Over a source's last block stand the steps of its subroot.
    above = cut(tops.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("i"), "up", F.col("digest").alias("subroot")))
    for k in range(len(logs) - 1, 0, -1):
        above = cut(prove(inner_nodes(logs)[k - 1], logs[k], above, "node", block))
    out = prove(leaves, logs[0], above, "leaf", block).crossJoin(F.broadcast(root))  # one row
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def without_newlines() -> Column:
    """The hash of a row of `documents` whose text lost its \\n characters, where 2 divides the CRC-32 of doc_id and the text has one; else null."""
    held = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in COLUMNS]
    return F.when((crc_key(F.col("doc_id")) % 2 == 0) & F.contains("text", F.lit("\n")), row_hash(held))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents").select(*COLUMNS), tampered=without_newlines())


def _hash_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY src) AS n FROM (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src, {_hash_sql('text')} AS leaf,
         CASE WHEN {crc_sql('doc_id::VARCHAR')} % 2 = 0 AND doc_id IS NOT NULL THEN {_hash_sql("replace(text, chr(10), '')")} END AS tampered FROM documents, crc_t)),
lv(l, src, j, n, h) AS (SELECT 0, src, i, n, leaf FROM leaves
  UNION ALL SELECT l + 1, src, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM lv WHERE n > 1 GROUP BY l, src, j // 3, n),
tv(l, j, n, h) AS (SELECT 0, src, (SELECT count(*) FROM lv WHERE n = 1), h FROM lv WHERE n = 1
  UNION ALL SELECT l + 1, j // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY j)) FROM tv WHERE n > 1 GROUP BY l, j // 3, n),
st AS (SELECT a.l, a.src, a.j, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j < a.j), '') AS lf, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j > a.j), '') AS rt
       FROM lv a JOIN lv b ON a.l = b.l AND a.src = b.src AND a.j // 3 = b.j // 3 WHERE a.n > 1 GROUP BY a.l, a.src, a.j),
tt AS (SELECT a.l, a.j, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j < a.j), '') AS lf, coalesce(string_agg(b.h, '' ORDER BY b.j) FILTER (b.j > a.j), '') AS rt
       FROM tv a JOIN tv b ON a.l = b.l AND a.j // 3 = b.j // 3 WHERE a.n > 1 GROUP BY a.l, a.j),
up(src, i, top, l, j, cur, proof) AS (SELECT src, i, false, 0, i, coalesce(tampered, leaf), '' FROM leaves
  UNION ALL SELECT u.src, u.i, u.top OR st.l IS NULL, CASE WHEN st.l IS NULL AND NOT u.top THEN 0 ELSE u.l + 1 END, CASE WHEN st.l IS NULL AND NOT u.top THEN u.src ELSE u.j // 3 END,
    CASE WHEN st.l IS NOT NULL THEN sha256(st.lf || u.cur || st.rt) WHEN u.top THEN sha256(tt.lf || u.cur || tt.rt) ELSE u.cur END, u.proof || coalesce(st.lf || st.rt, CASE WHEN u.top THEN tt.lf || tt.rt END, '')
  FROM up u LEFT JOIN st ON NOT u.top AND st.l = u.l AND st.src = u.src AND st.j = u.j LEFT JOIN tt ON u.top AND tt.l = u.l AND tt.j = u.j WHERE NOT u.top OR tt.l IS NOT NULL),
fin AS (SELECT src, i, arg_max(cur, l) AS folded, arg_max(proof, l) AS proof FROM up WHERE top GROUP BY src, i),
rt AS (SELECT h AS root FROM tv WHERE n = 1)
SELECT doc_id, leaf, lv.h AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaves JOIN fin USING (src, i) JOIN lv ON lv.src = leaves.src AND lv.n = 1, rt
"""


def brute(rows: list[tuple], tampered: list[bytes | None]) -> list[tuple]:
    """The same level by level, for tests: rows are (doc_id, source, leaf) in order; gives (leaf, subroot, root, proof digest, folded)."""

    def tree(nodes: list[bytes]) -> tuple[bytes, list[list[dict]]]:
        paths: list[list[dict]] = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, j in enumerate(at):
                r = j - j % FAN
                paths[k].append({"left": b"".join(nodes[r:j]), "right": b"".join(nodes[j + 1 : r + FAN])})
            nodes, at = [joined(*nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)], [j // FAN for j in at]
        return nodes[0], paths

    by: dict = {}
    for k, (_, source, leaf) in enumerate(rows):
        by.setdefault(source, []).append((k, leaf))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf for _, leaf in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order]) if order else (b"", [])
    out: list = [None] * len(rows)
    for s, top in zip(order, tops, strict=True):
        for (k, leaf), path in zip(by[s], trees[s][1], strict=True):
            out[k] = (leaf, trees[s][0], root, proof_digest(path + top), fold(leaf if tampered[k] is None else tampered[k], path + top))
    return out
