"""Suffix dedup: the sort against plain sorting, whole jobs against counting every window, edges, and the query against its SQL."""

import random

import numpy as np
import pytest

from gridspark.llm import suffixes as sx
from tests import oracle

DDL = "doc_id long, text string, n_bytes string, gram long"
W = sx.WIDTH


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n))


def corpus(seed, docs=60):
    rnd = random.Random(seed)
    shared = [words(rnd, 60) for _ in range(4)]
    out = []
    for k in range(docs):
        parts = [words(rnd, rnd.randint(5, 80)) for _ in range(3)]
        for s in rnd.sample(shared, rnd.randint(0, 2)):
            cut = rnd.randint(0, 200)
            parts.insert(rnd.randint(0, 3), s[cut : cut + rnd.randint(150, 400)])
        out.append(" ".join(parts))
    base = words(rnd, 250).split()
    for _ in range(12):  # near copies
        other = list(base)
        for _ in range(4):
            other[rnd.randrange(len(other))] = words(rnd, 1)
        out.append(" ".join(other))
    return [*out, out[0], out[0], "a" * 900, "ab" * 300, "short", "short", "", None, shared[0][:200], shared[0][:199], "x" * 10 + shared[1][:210]]


def check(spark, texts, **how):
    rows = [(k, t, "own", 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in sx.remove_repeats(spark.createDataFrame(rows, DDL), **how).collect()}
    assert len(got) == len(texts)
    for k, (t, (n, spans)) in enumerate(zip(texts, sx.brute(texts), strict=True)):
        assert (got[k].n_bytes, [list(s) for s in got[k].spans], got[k].gram) == (n, spans, 1), k
        ends = [0, *(x for s in spans for x in s), n]
        data = (t or "").encode()
        assert bytes(got[k].kept) == b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


@pytest.mark.parametrize("chunk", [sx.CHUNK, 3])
def test_equals_counting_windows(spark, chunk):
    check(spark, corpus(1), chunk=chunk)


def test_pieces_of_long_texts(spark, monkeypatch):
    rnd = random.Random(5)
    long = words(rnd, 400_000)
    assert len(long.encode()) > 2 * sx.PIECE
    check(spark, [long, long[1_000_000:1_000_400] + words(rnd, 50), words(rnd, 100)])


def test_a_text_in_most_rows(spark):
    rnd = random.Random(9)
    hot = words(rnd, 80)
    check(spark, [hot] * 1500 + [hot[30:300] + words(rnd, 30), words(rnd, 90)])


def test_empty_table(spark):
    assert sx.remove_repeats(spark.createDataFrame([], DDL)).collect() == []


@pytest.mark.parametrize("base", [sx.BASE, np.uint64(1), np.uint64(0)])
def test_sort_with_colliding_hashes(base):
    """With a base of 1 a hash is a sum of bytes, so that permuted strings collide; the bytes decide."""
    rnd = random.Random(2)
    core = bytes(rnd.choice(b"ab") for _ in range(260))
    swapped = core[:100] + core[101:102] + core[100:101] + core[102:]
    held = [core, swapped, core[:230] + b"zz" + core[232:], core, bytes(reversed(core))]
    before, span = np.array([20, 20, 20, 20, 7]), np.array([60, 60, 50, 60, 60])
    of, at, found, _ = sx.repeated(held, np.array([0, 0, 0, 0, 1]), before, span, base)
    seen = {}
    for c, a in zip(of, at, strict=True):
        seen.setdefault((c == 4, before[c] - a, held[c][a : a + W]), []).append((c, a))
    want = {x for v in seen.values() if len(v) > 1 for x in v}
    assert {(c, a) for c, a, f in zip(of, at, found, strict=True) if f} == want


def test_suffixes_come_sorted():
    rnd = random.Random(3)
    held = [bytes(rnd.choice(b"ab") for _ in range(40)) * 8 for _ in range(50)] + [b"q" * 320] * 3
    of, at = np.arange(len(held)), np.zeros(len(held), np.int64)
    n = np.full(len(held), len(held))
    order = sx.Suffixes(held, of, at).merge_sort(np.arange(len(held)), np.zeros(len(held), np.int64), n)
    assert [held[k][:W] for k in order] == sorted(h[:W] for h in held)


def test_query_equals_sql(spark, sf):
    oracle.same(sx.op12(spark, sf), sx.SQL, oracle.connect(sf))
