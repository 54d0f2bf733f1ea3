"""Removal of repeated passages by a hash-compared suffix sort.

Every 200-byte string of the corpus that starts in two places or more goes, byte by byte. Where two places agree on 200 bytes they agree on the anchor
of that window, the least of its grams by hash, so only suffixes behind the same anchor, at the same distance, can share a window:

1. Each text is cut into stretches of windows that have one anchor. A stretch whose anchor's gram stands nowhere else is unique and leaves the job.
   Stretches that are equal in whole (anchor and a second hash agree) are repeated in whole; one of them goes on, to be met by others.
2. The other stretches of a gram meet in one task, where all their suffixes are sorted to a depth of 200 bytes by mergesort. Two suffixes compare by their common extension, found
   by binary search over prefix polynomial hashes; suffixes that are neighbours and share 200 bytes are repeated, once their bytes have been compared as well.
3. A gram with more than CHUNK stretches is dealt out over several tasks, each a sorted run; windows that a run leaves single, and one of each that it has more often, meet the other runs' once more, by the window.

What is counted per gram is a row a stretch (about 70 bytes of text), not a row a byte; texts move once, to give and to lose their passages.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import cut, table, text_batches

WIDTH = 200
#: Bytes of a gram; each window of WIDTH bytes has WIDTH - GRAM + 1 of them, and the least is its anchor.
GRAM = 64
#: Bytes of texts that are hashed at once; longer texts go in pieces that share WIDTH - 1 bytes. Places in a piece take PLACE_BITS bits of a packed gram.
PIECE = 1 << 20
PLACE_BITS = np.uint64(20)
#: Stretches of one gram that one task sorts.
CHUNK = 8192
#: Stretches that are sorted in one go.
TOGETHER = 4096
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, for a piece."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for b in (BASE, inverse):
        p = np.full(PIECE + 1, b)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: polynomial hashes have weak low bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches of the texts data[starts[k]:ends[k]], at most PIECE bytes in all: (k, anchor, first window, last window, gram's hash)."""
    up, down = powers()
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    grams = mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, have = WIDTH - GRAM + 1, 1
    while have * 2 <= span:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    windows = np.maximum(ends - starts - WIDTH + 1, 0)
    text = np.repeat(np.arange(len(starts)), windows)
    place = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    anchor = (least[place] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(anchor) else np.zeros(0, np.int64)
    last = np.concatenate([new[1:], [len(anchor)]])[: len(new)] - 1
    return text[new], anchor[new], place[new], place[last], grams[anchor[new]]


def pieces(offsets: np.ndarray):
    """Cuts texts that stand one after the other (offsets has len + 1 entries) into pieces: lists of (text, from, to)."""
    out, size = [], 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < WIDTH:
            continue
        while True:
            take = min(b - a, PIECE)
            if size and size + take > PIECE:
                yield out
                out, size = [], 0
            out.append((k, a, a + take))
            size += take
            if a + take == b:
                break
            a += take - WIDTH + 1
    if out:
        yield out


def pack(anchor, first, last):
    """A stretch in one integer: the first window, and in 8 bits each the anchor's and the last window's distance from it."""
    return first << 16 | (anchor - first) << 8 | (last - first)


# --- the suffix sort -------------------------------------------------------------------------------------------------------------


class Suffixes:
    """Suffixes of contexts (byte strings) with prefix polynomial hashes; suffix s begins at at[s] in context of[s] and has WIDTH bytes at least."""

    def __init__(self, contexts: list[bytes], of: np.ndarray, at: np.ndarray, base: np.uint64 = BASE):
        wide = max(map(len, contexts))
        rows = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in contexts), np.uint8).reshape(len(contexts), wide)
        self.n, self.wide, self.of, self.at = len(contexts), wide, of, at
        self.rows = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)])
        self.columns = rows.T
        prefix = np.zeros((wide + 1, self.n), np.uint64)
        for i in range(wide):
            prefix[i + 1] = prefix[i] * base + (self.columns[i].astype(np.uint64) + np.uint64(1))
        self.prefix = prefix.ravel()
        self.power = [np.uint64(pow(int(base), s, 1 << 64)) for s in range(129)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b have in common, WIDTH at most: binary search over the hashes of their prefixes."""
        n, p = self.n, self.prefix
        ia, ib = self.at[a] * n + self.of[a], self.at[b] * n + self.of[b]
        long = np.zeros(len(a), np.int64)
        ha, hb = p[ia], p[ib]
        for s in (128, 64, 32, 16, 8, 4, 2, 1):
            fits = long + s <= WIDTH
            step = np.where(fits, s * n, 0)
            na, nb = p[ia + step], p[ib + step]
            same = fits & (na - ha * self.power[s] == nb - hb * self.power[s])
            go = np.where(same, step, 0)
            ia, ib, long = ia + go, ib + go, long + np.where(same, s, 0)
            ha, hb = np.where(same, na, ha), np.where(same, nb, hb)
        return long

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        long = self.extension(a, b)
        end = np.minimum(long, WIDTH - 1)
        x = self.rows[self.of[a] * self.wide + self.at[a] + end]
        y = self.rows[self.of[b] * self.wide + self.at[b] + end]
        return (long < WIDTH) & (x < y)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether WIDTH bytes are the same, by the bytes, 8 at a time."""
        words = np.ndarray(len(self.rows) - 7, "<u8", self.rows, strides=(1,))
        x, y = self.of[a] * self.wide + self.at[a], self.of[b] * self.wide + self.at[b]
        out = np.ones(len(a), bool)
        for k in range(0, WIDTH, 8):
            out &= words[x + k] == words[y + k]
        return out

    def merge_sort(self, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """order, sorted within the buckets first[k] .. first[k] + size[k] that entry k belongs to; runs double until they span their bucket."""
        w, place = 1, np.arange(len(order))
        while len(place := place[size[place] > w]):
            start, total = first[place], size[place]
            run, mine = (place - start) // w, (place - start) % w
            other = (run ^ 1) * w
            lo, hi = np.zeros(len(place), np.int64), np.clip(total - other, 0, w)
            left, me, base = run % 2 == 0, order[place], start + other
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) // 2
                it, own, first_run = order[base[open_] + mid], me[open_], left[open_]
                a, b = np.where(first_run, it, own), np.where(first_run, own, it)
                right = self.less(a, b) == first_run  # the first run's entries go before equal ones of the second
                lo[open_], hi[open_] = np.where(right, mid + 1, lo[open_]), np.where(right, hi[open_], mid)
            merged = order.copy()
            merged[start + run // 2 * 2 * w + mine + lo] = me
            order, w = merged, w * 2
        return order


def repeated(contexts: list[bytes], group: np.ndarray, before: np.ndarray, span: np.ndarray, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of contexts that stand in another place of their group at the same distance from the anchor: (context, window, repeated, first of its equals) of all windows.

    before: bytes between a context's first window and its anchor; span: windows but one. Equal hashes are believed only once the bytes agree; a collision has the
    sort done by the bytes themselves.
    """
    of = np.repeat(np.arange(len(contexts)), span + 1)
    at = np.arange(len(of)) - np.repeat(np.cumsum(span + 1) - (span + 1), span + 1)
    gap = before[of] - at
    order = np.lexsort((gap, group[of]))
    new = np.concatenate([[True], (np.diff(group[of][order]) != 0) | (np.diff(gap[order]) != 0)])
    starts = np.flatnonzero(new)
    size = np.diff(np.concatenate([starts, [len(order)]]))
    which = np.cumsum(new) - 1
    tool = Suffixes(contexts, of, at, base)
    order = tool.merge_sort(order, starts[which], size[which])
    pair = np.flatnonzero(~new[1:])
    claimed = tool.extension(order[pair], order[pair + 1]) == WIDTH
    same = np.zeros(len(order), bool)  # as the entry before
    same[pair[claimed] + 1] = tool.equal(order[pair[claimed]], order[pair[claimed] + 1])
    if same.sum() < claimed.sum():
        keys = [(int(which[k]), contexts[of[s]][at[s] : at[s] + WIDTH]) for k, s in enumerate(order)]
        by = sorted(range(len(order)), key=keys.__getitem__)
        order = order[by]
        same = np.array([k > 0 and keys[by[k]] == keys[by[k - 1]] for k in range(len(by))], bool)
    twice = same.copy()
    twice[:-1] |= same[1:]
    found, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
    found[order], leads[order] = twice, ~same
    return of, at, found, leads


# --- as Spark jobs ---------------------------------------------------------------------------------------------------------------

STRETCH = pa.schema([("th", pa.int64()), ("gram", pa.int64()), ("whole", pa.int64()), ("place", pa.int64()), ("times", pa.int32())])
STRETCH_DDL = "th bigint, gram bigint, whole bigint, place bigint, times int"


def as_long(h) -> np.ndarray:
    return np.asarray(h, np.uint64).view(np.int64)


def combined(gram: np.ndarray, whole: np.ndarray, th: np.ndarray, place: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, whole, times) for the shuffle. Of stretches that are equal in whole within a piece the first stands for all; the others, repeated for certain, get keys of their own that
    meet nothing, so that a passage which stands everywhere sends a row a piece to its gram's task."""
    key = mixed(gram) ^ whole
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    later, times = order[1:][same], times.copy()
    times[order[:-1][same]] = times[later] = 2
    own = mixed(th[later].view(np.uint64) ^ mixed(place[later].view(np.uint64)))
    gram, whole = gram.copy(), whole.copy()
    gram[later] = whole[later] = own
    return gram, whole, times


def text_stretches(texts: DataFrame) -> DataFrame:
    """All stretches of texts (th, times, text as binary): th, gram, whole (a second hash, of all bytes of its windows), place, times."""

    def cutting(it):
        for batch in it:
            th, times, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            if not len(column):
                continue
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            for piece in pieces(offsets):
                k, a, b = (np.array(x) for x in zip(*piece, strict=True))
                # Short texts between two of a piece, and the shared bytes of a long one, are left out or stand twice: parts are laid side by side.
                part = data[a[0] : b[-1]] if (a[1:] == b[:-1]).all() else np.concatenate([data[x:y] for x, y in zip(a, b, strict=True)])
                starts = np.cumsum(b - a) - (b - a)
                text, anchor, first, last, gram = stretches(part, starts, starts + b - a)
                view = memoryview(part)
                whole = np.array([xxhash.xxh64_intdigest(view[x : y + WIDTH], s) for x, y, s in zip(first.tolist(), last.tolist(), ((anchor - first) << 8 | (last - first)).tolist(), strict=True)], np.uint64)
                shift = (a - offsets[k] - starts)[text]
                of, place = th[k[text]], pack(anchor + shift, first + shift, last + shift)
                gram, whole, twice = combined(gram, whole, of, place, times[k[text]])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, as_long(gram), as_long(whole), place, twice)], schema=STRETCH)

    return text_batches(texts).mapInArrow(cutting, STRETCH_DDL)


CONTEXT = pa.schema([("gram", pa.int64()), ("chunk", pa.int32()), ("known", pa.bool_()), ("th", pa.int64()), ("place", pa.int64()), ("context", pa.binary())])
CONTEXT_DDL = "gram bigint, chunk int, known boolean, th bigint, place bigint, context binary"


def contexts_of(texts: DataFrame, found: str) -> DataFrame:
    """The bytes of the stretches that a text gives: found is an array of (gram, place, known, chunk)."""
    text, at, th = texts.columns.index("__text"), texts.columns.index(found), texts.columns.index("__th")

    def cutting(it):
        for batch in it:
            out, size = [], 0
            for h, t, parts in zip(batch.column(th).to_pylist(), batch.column(text), batch.column(at).to_pylist(), strict=True):
                t = t.as_buffer()
                for p in parts:
                    first, span = p["place"] >> 16, p["place"] & 255
                    out.append((p["gram"], p["chunk"], p["known"], h, p["place"], t[first : first + span + WIDTH].to_pybytes()))
                    size += span + WIDTH
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return text_batches(texts).mapInArrow(cutting, CONTEXT_DDL)


def sort_contexts(rows: DataFrame) -> DataFrame:
    """The suffix sort of rows that are dealt and ordered by (gram, chunk): repeated runs of windows of stretches that weren't known (context null), passed through or
    found, place being the stretch; and of dealt-out grams (chunk 0 or more) windows to meet other runs', with the window as gram and chunk -1."""

    def sorting(it):
        def solve(held):
            ids = {}
            group = np.array([ids.setdefault((r[0], r[1]), len(ids)) for r in held])
            place = np.array([r[4] for r in held])
            known, dealt = np.array([r[2] for r in held]), np.array([r[1] >= 0 for r in held])
            of, at, found, leads = repeated([r[5] for r in held], group, place >> 8 & 255, place & 255)
            out = []
            hit = np.flatnonzero(found & ~known[of])
            if len(hit):
                first = np.concatenate([[True], (np.diff(of[hit]) != 0) | (np.diff(at[hit]) != 1)])
                runs = np.flatnonzero(first)
                ends = np.concatenate([runs[1:], [len(hit)]]) - 1
                for c, x, y in zip(of[hit[runs]].tolist(), at[hit[runs]].tolist(), at[hit[ends]].tolist(), strict=True):
                    begin = (held[c][4] >> 16) + x
                    out.append((0, -1, True, held[c][3], begin << 16 | (y - x), None))
            for s in np.flatnonzero(dealt[of] & leads).tolist():
                r, x = held[of[s]], int(at[s])
                window = r[5][x : x + WIDTH]
                h = xxhash.xxh64_intdigest(window)
                out.append((h - (1 << 64) if h >> 63 else h, -1, bool(found[s] or r[2]), r[3], ((r[4] >> 16) + x) << 16, window))
            return out

        def batches(out):
            for k in range(0, len(out), 20_000):
                part = out[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

        held, last = [], None
        for batch in it:
            passed = []
            for r in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if r[5] is None:
                    passed.append(r)
                    continue
                if len(held) >= TOGETHER and (r[0], r[1]) != last:
                    yield from batches(solve(held))
                    held = []
                held.append(r)
                last = (r[0], r[1])
            yield from batches(passed)
        if held:
            yield from batches(solve(held))

    return rows.mapInArrow(sorting, CONTEXT_DDL)


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs without text, plus n_bytes, spans (maximal removed runs [from, to) of UTF-8 bytes) and kept (the other bytes).

    A null text is empty; texts under WIDTH bytes lose nothing; very long ones are hashed in pieces that share WIDTH - 1 bytes. Equal rows and texts are places of their own, so all
    of their bytes go where there are WIDTH. Texts are held equal, and stretches repeated in whole, by 64-bit hashes (a stretch by two). Other columns pass through, whatever they hold;
    those named n_bytes, spans, kept are replaced, names that begin with __ are taken. An empty table gives an empty one. A text in more than a thousandth of all rows is
    looked at once, in one of its rows: such texts are a thousand at most, and are broadcast.
    """
    others = [c for c in docs.columns if c not in (text, "n_bytes", "spans", "kept")]
    rows = docs.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).withColumn("__th", F.xxhash64("__text")).withColumn("__text", F.col("__text").cast("binary"))
    classes = cut(rows.groupBy("__th").agg(F.count("*").alias("__n")).where("__n >= 1000"))
    total = docs.count()
    hot = F.broadcast(classes.where(F.col("__n") * 1000 > total).select("__th"))
    often = rows.join(hot, "__th", "left_semi")
    one = often.dropDuplicates(["__th"]).select(rows.columns).withColumn("__times", F.lit(2))
    source = rows.join(hot, "__th", "left_anti").select(rows.columns).withColumn("__times", F.lit(1)).union(one)

    # Which grams stand in several places, and which stretches are equal in whole.
    found = text_stretches(source.select("__th", "__times", "__text")).repartition("gram")
    whole = Window.partitionBy("gram", "whole")
    ordered, gram = whole.orderBy("th", "place"), Window.partitionBy("gram")
    found = found.withColumn("r", F.row_number().over(ordered)).withColumn("copy", (F.lag("th").over(ordered) == F.col("th")) & (F.lag("place").over(ordered) == F.col("place")))
    found = found.withColumn("n", F.sum("times").over(whole)).withColumn("single", F.col("n") == 1)
    found = found.withColumn("n_gram", F.sum("times").over(gram)).withColumn("singles", F.sum(F.col("single").cast("int")).over(gram)).withColumn("kinds", F.sum((F.col("r") == 1).cast("int")).over(gram))
    found = found.where("n_gram > 1 and not coalesce(copy, false)").withColumn("gives", F.col("single") | ((F.col("r") == 1) & (F.col("singles") > 0)))
    dealt = F.when(F.col("kinds") > chunk, F.pmod(F.xxhash64("th", "place"), F.ceil(F.col("kinds") / chunk)).cast("int")).otherwise(-1)
    found = cut(found.select("th", "gram", "place", (~F.col("single")).alias("known"), "gives", dealt.alias("chunk")))

    # Texts give the stretches that must be compared; their suffixes are sorted.
    wanted = found.where("gives").groupBy(F.col("th").alias("__th")).agg(F.collect_list(F.struct("gram", "place", "known", "chunk")).alias("__wanted"))
    given = contexts_of(source.join(wanted, "__th"), "__wanted").repartition("gram", "chunk").sortWithinPartitions("gram", "chunk")
    runs = sort_contexts(sort_contexts(given).transform(_again))
    spans = runs.select("th", "place").union(found.where("known").select("th", "place"))
    begin, long = F.shiftright("place", 16), F.col("place").bitwiseAND(255)
    spans = spans.groupBy(F.col("th").alias("__th")).agg(F.collect_list(F.array(begin, begin + long + WIDTH)).alias("__spans"))
    cold = _without(source.join(spans, "__th", "left"), others)
    n = F.octet_length("__text").cast("bigint")
    all_ = n >= WIDTH
    none = F.array().cast("array<array<bigint>>")
    warm = often.select(*others, n.alias("n_bytes"), F.when(all_, F.array(F.array(F.lit(0).cast("bigint"), n))).otherwise(none).alias("spans"), F.when(all_, F.lit(b"")).otherwise(F.col("__text")).alias("kept"))
    return cold.union(warm)


def _again(first: DataFrame) -> DataFrame:
    """The second meeting: windows by their hash; what is found already lies anywhere."""
    return first.withColumn("__deal", F.when(F.col("context").isNull(), F.xxhash64("th", "place")).otherwise(F.col("gram"))).repartition("__deal").sortWithinPartitions("gram").drop("__deal")


def _without(rows: DataFrame, others: list[str]) -> DataFrame:
    """others, n_bytes, spans and kept of rows; a hot text's stand-in goes."""
    names = rows.columns
    at = {c: names.index(c) for c in ("__text", "__times", "__spans")}
    passed = [names.index(c) for c in others]

    def losing(it):
        for batch in it:
            batch = batch.filter(pc.equal(batch.column(at["__times"]), 1))
            n, spans, kept = [], [], []
            for t, found in zip(batch.column(at["__text"]).to_pylist(), batch.column(at["__spans"]).to_pylist(), strict=True):
                gone = merged(found) if found else []
                ends = [0, *(x for s in gone for x in s), len(t)]
                n.append(len(t))
                spans.append(gone)
                kept.append(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if gone else t)
            more = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in passed), *more], names=[*others, "n_bytes", "spans", "kept"])

    schema = T.StructType([*rows.select(others).schema, *T.DataType.fromDDL("n_bytes bigint, spans array<array<bigint>>, kept binary")])
    return text_batches(rows).mapInArrow(losing, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, list[list[int]]]]:
    """(bytes, spans) of each text by counting every window, for tests."""
    data = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for t in data:
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            count[w] = count.get(w, 0) + 1
    return [(len(t), merged([[p, p + width] for p in range(len(t) - width + 1) if count[t[p : p + width]] > 1])) for t in data]


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT r, p, md5(substr(x, p * 2 + 1, {2 * WIDTH})) AS h FROM d, unnest(range(greatest(n - {WIDTH} + 1, 0))) u(p)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM w SEMI JOIN twice USING (h)),
runs AS (SELECT r, p, sum(CASE WHEN gap <= {WIDTH} THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit),
spans AS (SELECT r, k, min(p) AS a, max(p) + {WIDTH} AS b FROM runs GROUP BY r, k),
gone AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, list(b ORDER BY a) AS bs, list(a ORDER BY a) AS as_ FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(x, 2 * f + 1, 2 * (e - f)), '' ORDER BY f) AS y FROM (SELECT r, x, unnest(list_prepend(0, bs)) AS f, unnest(list_append(as_, n)) AS e FROM d JOIN gone USING (r)) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
