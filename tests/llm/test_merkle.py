"""The Merkle manifest: closed forms, tiers and edges against a level-by-level version, and the query against its SQL."""

import hashlib

import pytest
from pyspark.sql import functions as F

from gridspark.llm import merkle
from tests import oracle

DDL = "doc_id long, source string, lang string, n_chars long, text string, g string, i long, kind int"


def leaf(doc_id, source, lang, n_chars, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256("".join(map(part, (doc_id, source, lang, n_chars, text))).encode()).digest()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80, 100])
def test_positions_name_the_nodes_of_the_log(n):
    height = merkle.levels(n)
    tool = merkle.Builder(height)
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    for x in leaves:
        tool.add(x)
    log, nodes = tool.finish(), leaves
    seen = set()
    for level in range(height + 1):
        for j, x in enumerate(nodes):
            at = merkle.position(level, j, n, height)
            assert log[at] == x
            seen.add(at)
        nodes = [merkle.joined(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    assert seen == set(range(len(log)))


def rows_of(n):
    out = [(k, f"s{k % 4}" if k % 7 else None, "en", k, f"line {k}\nmore" if k % 3 else None, "x", 5, 2) for k in range(n)]
    out += [(None, "s0", None, None, "no id\n", "y", 1, 1), (3, "s3", "de", 1, "same id", None, 0, 0), (3, "s3", "de", 1, "same id", None, 0, 0), (900, "one", "en", 3, "", "z", 1, 0), (901, "s1", "en", 9, "é\n" * 50_000, "z", 1, 0)]
    return out


@pytest.mark.parametrize("block", [1, 2, 6])
def test_equals_level_by_level(spark, block):
    rows = rows_of(150)
    docs = spark.createDataFrame(rows, DDL)
    got = merkle.manifest(docs, tampered=merkle.without_newlines(), block=block).collect()
    want_rows = sorted(((r, leaf(*r[:5])) for r in rows), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    held = []
    for r, _ in want_rows:
        odd = r[0] is None or hashlib and __import__("zlib").crc32(str(r[0]).encode()) % 2
        held.append(None if odd or not r[4] or "\n" not in r[4] else leaf(*r[:4], r[4].replace("\n", "")))
    want = merkle.brute([(r[0], r[1], x) for r, x in want_rows], held)
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=key) == sorted(
        ((r[0], w[0].hex(), w[1].hex(), w[2].hex(), w[3], w[4].hex()) for (r, _), w in zip(want_rows, want, strict=True)), key=key
    )
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def test_small_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert merkle.manifest(none).collect() == []
    one = merkle.manifest(spark.createDataFrame([(7, "a", None, None, None, None, 0, 0)], DDL)).collect()
    assert len(one) == 1
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root
    assert one[0].proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_source_with_most_rows_is_dealt_by_blocks(spark):
    nodes = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("i"), F.lit(5000).cast("long").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    logs = merkle.write_log(nodes, 4)
    assert logs.count() == -(-5000 // 81)
    assert logs.agg(F.max(F.size("log"))).first()[0] == merkle.position(4, 0, 81, 4) + 1


def test_query_equals_sql(spark, sf):
    oracle.same(merkle.op13(spark, sf), merkle.SQL, oracle.connect(sf))
