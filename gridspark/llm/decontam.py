"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words is one window). All windows of one
length form one Wu-Manber searcher whose symbols are words: a table over blocks of two words tells how far the window's end
may jump, a block with shift zero selects the bucket of the windows that end with it, and comparing the words confirms an
occurrence. Documents stream through map tasks; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import cut, folded_table, table, text_batches

WINDOW = 10
#: Bytes of benchmark text that one pass holds in each worker; a larger benchmark is searched for in several passes.
PASS_BYTES = 32 << 20
FOLDED = folded_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a null has none."""
    return text.translate(FOLDED).split() if text else []


class Searcher:
    """Wu-Manber over words for patterns of one length m: windows maps the tuple of words to its items."""

    def __init__(self, m: int, windows: dict[tuple, list]):
        self.m, self.block = m, min(2, m)
        self.jump = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list]] = defaultdict(dict)
        for w, items in windows.items():
            for end in range(self.block, m + 1):
                b, s = w[end - self.block : end], m - end
                if s < self.shift.get(b, self.jump):
                    self.shift[b] = s
            self.bucket[w[-self.block :]][w] = items

    def find(self, doc: list[bytes]):
        """Yields (start, items) of every occurrence."""
        n, m, block, jump, shift = len(doc), self.m, self.block, self.jump, self.shift.get
        end = m
        while end <= n:
            b = tuple(doc[end - block : end])
            s = shift(b, jump)
            if s:
                end += s
                continue
            items = self.bucket[b].get(tuple(doc[end - m : end]))
            if items is not None:
                yield end - m, items
            end += 1


def searchers(items: list[tuple]) -> list[Searcher]:
    by_length: dict[int, dict[tuple, list]] = defaultdict(dict)
    for item, text in items:
        w = words(text)
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1) if m else ():
            found = by_length[m].setdefault(tuple(w[i : i + m]), [])
            if item not in found:
                found.append(item)
    return [Searcher(m, by_length[m]) for m in sorted(by_length)]


def scan(doc: list[bytes], tools: list[Searcher]) -> tuple[list[tuple[int, int]], set]:
    """Spans of hit words, merged, and the items that occur."""
    spans, items = [], set()
    for tool in tools:
        for start, found in tool.find(doc):
            spans.append((start, start + tool.m))
            items.update(found)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
HITS_DDL = "struct<n_words:bigint,spans:array<array<bigint>>,items:array<bigint>>"


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "hits") -> DataFrame:
    """docs plus a column `out` with n_words, the merged word spans hit and the items with an occurring window.

    A null or wordless text has no words and no hits; a benchmark text that is null or wordless gives no windows, an
    empty benchmark hits nothing; equal item texts all count; a null item_id hits words but is not listed; equal documents get equal results.
    Texts of any length are searched whole, one at a time. Input columns pass through; one named like `out` is replaced.
    """
    spark = docs.sparkSession
    docs = text_batches(docs).drop(out)
    picked = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null")
    size = picked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    at = docs.columns.index(text)
    for k in range(passes):
        part = picked if passes == 1 else picked.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k)
        held = spark.sparkContext.broadcast(searchers([tuple(r) for r in part.toLocalIterator()]))
        first = k == 0

        def batches(it, held=held, first=first):
            tools = held.value
            for batch in it:
                texts = batch.column(at).cast(pa.binary())
                before = [None] * len(texts) if first else batch.column(batch.num_columns - 1).to_pylist()
                rows = []
                for t, old in zip(texts, before, strict=True):
                    w = words(t.as_py())
                    spans, items = scan(w, tools)
                    if old:
                        spans, items = union([*map(tuple, old["spans"]), *spans]), items | set(old["items"])
                    rows.append({"n_words": len(w), "spans": spans, "items": sorted(x for x in items if x is not None)})
                kept = batch.columns if first else batch.columns[:-1]
                names = batch.schema.names if first else batch.schema.names[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, HITS)], names=[*names, out])

        schema = T.StructType([*docs.schema, T.StructField(out, T.DataType.fromDDL(HITS_DDL))]) if first else docs.schema
        docs = docs.mapInArrow(batches, schema)
        if k + 1 < passes:
            docs = cut(docs)
    return docs


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(spans_col: str = "hits"):
    """n_hit, n_items, items_sha256 and contaminated, derived from find_overlaps' column."""
    h = F.col(spans_col)
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    listed = F.array_join(F.array_sort(F.transform(h["items"], lambda x: x.cast("string"))), ",")
    return [h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *digest())


WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format(t='text')} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format(t='text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win, least(10, len(w)) AS m FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, m, i, w[i:i + m - 1] AS win FROM d, (SELECT DISTINCT m FROM bw) s, unnest(range(1, greatest(len(w) - m + 2, 1))) t(i)),
hit AS (SELECT doc_id, item_id, i, dw.m FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def brute(doc: bytes | None, items: list[tuple]) -> tuple[int, int, list]:
    """The same by comparing every window at every place; for tests."""
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        m = min(WINDOW, len(v))
        for i in range(len(v) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(x for x in found if x is not None)


__all__ = ["find_overlaps", "digest", "op7", "SQL", "brute"]
