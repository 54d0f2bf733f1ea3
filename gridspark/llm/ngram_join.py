"""Near-duplicate join on word shingles by parity sketches.

A bit sketch of a document's set of shingles (two to four parities per shingle) has a Hamming distance that never exceeds the
size of the symmetric difference, so pairs beyond the distance that the similarity allows are dropped unread. For candidates,
all shingles have one order: two sets that link hold the first shingle that they share among the first quarter of both, and the smaller one
among its first seventh, so documents meet in buckets of these shingles, and buckets that are in no member's first seventh are dropped. Shingles found in very many
documents come last in the order, so passages shared by many documents seldom make buckets. A bucket first makes a star of its members, within
each map task and then over the tasks' leading members, and sketches and exact sets verify the star's links. Only buckets whose members are still in
different components are read again: in blocks of bounded size, members with a plausible partner are found by sketches, then
compared by their sets where they lie, and a block gives no more links than join its components.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import cut, table, text_batches
from gridspark.operators.components import label as components

WIDTH = 5
#: Similarity of at least NUM / DEN: the symmetric difference is at most (DEN - NUM) / (DEN + NUM) of both sizes' sum.
NUM, DEN = 3, 4
LEAST_BITS = 256
#: A shingle is common when a task's batches hold it COMMON times in sum, counting those with two or more; of these the most frequent,
#: COMMON_MOST at most, are broadcast. They only change the order of the words.
COMMON, COMMON_MOST = 12, 2_000_000
#: Leaders tried in large buckets.
LEADERS = 4
#: Keys that a map task holds before it makes stars, and members of a bucket from which it does.
HELD_KEYS, STAR = 1 << 18, 4
#: Rows in an Arrow batch of keys.
ROWS = 1 << 16
#: Of the buckets that a member shares with others, it carries so many least keys.
LOW = 4
#: Members of one bucket are held for comparison in blocks of about so many shingles (8 bytes each).
BLOCK = 1 << 19
#: So many ids at most are broadcast to pick candidates' texts; with more the texts are joined by a shuffle.
PICK_ROWS = 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: Bytes of text whose words are hashed together, and what lies between words.
CHUNK, GAP = 1 << 16, re.compile(rb"[\x20\x09-\x0D]")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit values of bytes, and which bytes belong to words.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * FACTORS[1])
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


class Shingler:
    """Sets of shingles as sorted arrays of 64-bit hashes.

    Words are hashed together: running sums of byte values times powers of an odd base give each word's polynomial hash.
    Words of over 64 bytes, for which sums modulo 2^64 are weak, are hashed one by one.
    """

    def __init__(self):
        n = 2 * CHUNK
        self.power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, BASE)))).astype(np.uint64)
        self.inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(pow(int(BASE), -1, 2**64)))))).astype(np.uint64)

    def _words(self, low: bytes) -> np.ndarray:
        """Hashes of the words of at most 2 CHUNK bytes."""
        b = np.frombuffer(low, np.uint8)
        n = len(b)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = IN_WORD[b]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE[b] * self.power[:n], out=sums[1:])
        h = mix((sums[end] - sums[start]) * self.inverse[start])
        for k in np.flatnonzero(end - start > 64):
            h[k] = xxhash.xxh3_64_intdigest(low[start[k] : end[k]])
        return h

    def _hashes(self, low: bytes) -> np.ndarray:
        """Word hashes of a text of any length, read in pieces that end between words."""
        out, at = [], 0
        while at < len(low):
            end = len(low)
            if end - at > CHUNK:
                gap = GAP.search(low, at + CHUNK)
                end = gap.start() if gap else end
            piece = low[at:end]
            at = end
            if len(piece) > 2 * CHUNK:  # it ends with a word of over CHUNK bytes
                head = piece.rsplit(None, 1)
                out += [self._words(head[0])] * (len(head) > 1) + [np.array([xxhash.xxh3_64_intdigest(head[-1])], np.uint64)]
            else:
                out.append(self._words(piece))
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = self._hashes(text.translate(LOWER)) if text else ()
        if not len(h):
            return np.empty(0, np.uint64)
        width = min(WIDTH, len(h))
        m = len(h) - width + 1
        s = h[:m] * FACTORS[0] + np.uint64(width)
        for k in range(1, width):
            s += h[k : k + m] * FACTORS[k]
        s = mix(s)
        s.sort()
        return s[np.concatenate(([True], s[1:] != s[:-1]))]


def set_hash(s: np.ndarray) -> int:
    """A hash of the whole set, signed."""
    return int((mix(s + np.uint64(0x51ED2701)).sum(dtype=np.uint64) + np.uint64(len(s)) * FACTORS[1]).astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in a power of two of at least 2 n (and 256) cells. A sketch of twice the cells folds to one of
    half by XOR of its halves, so sketches of different sizes compare."""
    cells = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the smaller one's size: never more than the symmetric difference of the sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def bucket_keys(s: np.ndarray, common: np.ndarray, tiers: np.ndarray) -> np.ndarray:
    """The keys of the buckets that the set joins: its first shingles in one order of all shingles, the common ones last.

    A set of n shingles shares at least 3 n / 4 of them with a set that it links with, so that the first of the shared ones is among the first n // 4 + 1 of both sets;
    with one that is no smaller it shares 6 n / 7, so that it is among the smaller one's `leading(n)`.
    """
    n = len(s)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        s = s[np.argsort(np.where(common[at] == s, tiers[at], np.uint64(0)), kind="stable")]
    return mix(s[: n * (DEN - NUM) // DEN + 1] + FACTORS[4]).view(np.int64)


def leading(n: int) -> int:
    """So many first keys of a set of n shingles are those by which it is found from sets that are no smaller."""
    return n * (DEN - NUM) // (DEN + NUM) + 1


def _narrow(docs: DataFrame) -> DataFrame:
    """Per document (i, n, h, k): id, set size, set hash, sketch; and rows (h = shingle, n = documents in the batch that have it, i = -1, k
    null) of shingles that stand in two or more documents of a batch."""

    def mapped(batches):
        make = Shingler()
        with np.errstate(over="ignore"):
            for b in batches:
                ids, texts = b.column(0), b.column(1)
                n, h, k, seen, sets = [], [], [], set(), []
                for t in texts:
                    s = make(t.as_py())
                    n.append(len(s))
                    h.append(set_hash(s) if len(s) else 0)
                    k.append(sketch(s))
                    if len(s) and h[-1] not in seen:
                        seen.add(h[-1])
                        sets.append(s)
                u, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
                often = c >= 2
                u, c = u[often].view(np.int64), c[often]
                yield _batch(ids, n, h, pa.array(k, pa.binary()), False)
                if len(u):
                    yield _batch(pa.nulls(len(u), pa.int64()), c, u, pa.nulls(len(u), pa.binary()), True)

    return docs.mapInArrow(mapped, "i long, n long, h long, k binary, often boolean")


def _batch(ids, n, h, k, often: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h, pa.int64()), k, pa.array(np.full(len(n), often))], names=["i", "n", "h", "k", "often"])


def _common(often: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles (h, n summed) as sorted hashes and tiers (the binary logarithm of how often they were counted)."""
    n = often.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON).select("h", F.floor(F.log2("n")).cast("int").alias("tier"))
    n = cut(n)
    least, total = 0, 0
    for r in sorted(n.groupBy("tier").count().collect(), reverse=True):
        total += r["count"]
        least = r["tier"]
        if total > COMMON_MOST:
            least += 1
            break
    got = n.where(F.col("tier") >= least).toPandas()
    h, tier = got["h"].to_numpy(np.int64).view(np.uint64), got["tier"].to_numpy(np.uint64)
    order = np.argsort(h)
    return h[order], tier[order]


def _buckets(docs: DataFrame, common) -> DataFrame:
    """(key, h, lead, first) of every different set in a task: copies within the task are left out before anything is shuffled. first: the key is one of the set's leading ones.

    A bucket with STAR members or more in one task sends on only its least one (of those with first, if there are any), with lead = h; each other member's row is a
    pair with lead as its partner. In all other rows lead is null.
    """
    far = np.int64(2**63 - 1)

    def stars(k: np.ndarray, h: np.ndarray, f: np.ndarray):
        order = np.argsort(k)
        by = k[order]
        at = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
        n = np.diff(np.concatenate((at, [len(k)])))
        # Rows stay in the texts' order, which compresses better than that of the keys.
        lead, none = np.empty(len(k), np.int64), np.empty(len(k), bool)
        least = np.minimum.reduceat(np.where(f, h, far)[order], at)
        least = np.where(least < far, least, np.minimum.reduceat(h[order], at))
        lead[order], none[order] = np.repeat(least, n), np.repeat(n < STAR, n)
        for i in range(0, len(k), ROWS):
            j = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(k[j]), pa.array(h[j]), pa.array(lead[j], mask=none[j]), pa.array(f[j])], names=["key", "h", "lead", "first"])

    def mapped(batches):
        make, seen, often = Shingler(), set(), common.value  # hashes in order, and their tiers
        ks, hs, fs, held = [], [], [], 0
        with np.errstate(over="ignore"):
            for b in batches:
                for t in b.column(0):
                    s = make(t.as_py())
                    if not len(s) or (h := set_hash(s)) in seen:
                        continue
                    seen.add(h)
                    ks.append(bucket_keys(s, *often))
                    hs.append(np.full(len(ks[-1]), h))
                    fs.append(np.arange(len(ks[-1])) < leading(len(s)))
                    held += len(ks[-1])
                    if held >= HELD_KEYS:
                        yield from stars(np.concatenate(ks), np.concatenate(hs), np.concatenate(fs))
                        ks, hs, fs, held = [], [], [], 0
            if held:
                yield from stars(np.concatenate(ks), np.concatenate(hs), np.concatenate(fs))

    return docs.select("t").mapInArrow(mapped, "key long, h long, lead long, first boolean")


def _stars(buckets: DataFrame, parts: int) -> DataFrame:
    """(key, a, b): in every bucket the first member a with each other member b, or a member's lead with it; key is null where the
    bucket has only these two.

    Rows of a bucket meet in order of (key, first, h), at most a few from each map task; of a bucket that is still open two rows at most are held. A bucket whose
    first row is none of its set's leading ones has no such row and makes no pair.
    Pairs that the map tasks made pass through, spread by their member.
    """
    none = np.empty(0, np.int64)

    def batch(k, a, b, known):
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64(), mask=~known), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def mapped(batches):
        held_k = held_h = held_w = held_f = none
        opened = None  # key, first member and last member of a large bucket that may go on
        for rows in batches:
            k, h, lead = (rows.column(c).fill_null(0).to_numpy() for c in range(3))
            f = np.array(rows.column(3)).astype(np.int64)
            leads = np.array(rows.column(2).is_valid())
            pair = leads & (lead != h)
            if pair.any():
                yield batch(k[pair], lead[pair], h[pair], np.ones(int(pair.sum()), bool))
            k, h, w = np.concatenate((held_k, k[~pair])), np.concatenate((held_h, h[~pair])), np.concatenate((held_w, 1 + leads[~pair].astype(np.int64)))
            f = np.concatenate((held_f, f[~pair]))
            if not len(k):
                continue
            new = np.concatenate(([not (opened and (k[0], h[0]) == (opened[0], opened[2]))], (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
            k, h, w, f = k[new], h[new], w[new], f[new]
            if not len(k):
                continue
            start = np.concatenate(([True], k[1:] != k[:-1]))
            at, of = np.flatnonzero(start), np.cumsum(start) - 1
            # A lead stands for others too, so that its bucket is large with one more row.
            lead, big, member = h[at], np.add.reduceat(w, at) >= 3, ~start
            meets = f[at] > 0
            if opened and k[0] == opened[0]:
                lead[0], big[0], member[0], meets[0] = opened[1], True, True, True
            member &= meets[of]
            held_k = held_h = held_w = held_f = none
            last = slice(at[-1], None)
            opened = (k[-1], lead[-1], h[-1]) if big[-1] and meets[-1] else None
            if not opened and meets[-1]:
                held_k, held_h, held_w, held_f, member[last] = k[last], h[last], w[last], f[last], False
            i = np.flatnonzero(member)
            yield batch(k[i], lead[of[i]], h[i], big[of[i]])
            # In one of eight large buckets the next few members lead as well, for links within large groups of near copies.
            rank = np.arange(len(k)) - at[of]
            for nth in range(1, LEADERS):
                j = np.flatnonzero((big & meets)[of] & (rank > nth) & (k & 7 == 0))
                if len(j):
                    yield batch(k[j], h[at[of[j]] + nth], h[j], np.zeros(len(j), bool))
        if len(held_k) == 2:
            yield batch(held_k[:1], held_h[:1], held_h[1:], np.array([False]))

    place = F.when(F.col("lead").isNull() | (F.col("lead") == F.col("h")), F.col("key")).otherwise(F.col("h"))
    return buckets.repartition(parts, place).sortWithinPartitions(F.col("key"), F.col("first").desc(), F.col("h"), F.col("lead").desc()).mapInArrow(mapped, "key long, a long, b long")


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, c) whose sizes and sketches allow the similarity, with the ids that stand for both sets. Sizes are compared
    before sketches are joined."""
    side = lambda x: classes.select(F.col("h").alias(x), F.col("rep").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(NUM * F.greatest("na", "nb") <= DEN * F.least("na", "nb"))
    of = lambda x: classes.select(F.col("h").alias(x), F.col("k").alias(f"k{x}"))
    drawn = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ra", "rb", "c", (F.col("na") + F.col("nb")).alias("n"), "ka", "kb")

    def mapped(batches):
        for b in batches:
            n, ka, kb = (b.column(k).to_pylist() for k in (5, 6, 7))
            keep = [(DEN + NUM) * distance(x, y) <= (DEN - NUM) * z for x, y, z in zip(ka, kb, n, strict=True)]
            yield b.select(["a", "b", "ra", "rb", "c"]).filter(pa.array(keep, pa.bool_()))

    return drawn.mapInArrow(mapped, "a long, b long, ra long, rb long, c long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, s): the sets of the classes (h, i), i a row's id, once each; s holds 8 bytes a shingle, in order."""
    few = F.broadcast(ids) if ids.count() <= PICK_ROWS else ids

    def mapped(batches):
        make, seen = Shingler(), set()
        with np.errstate(over="ignore"):
            for b in batches:
                hs, ss = [], []
                for h, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if h not in seen and set_hash(s := make(t.as_py())) == h:  # else another row with the same id
                        seen.add(h)
                        hs.append(h)
                        ss.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ss, pa.binary())], names=["h", "s"])

    return docs.join(few, "i").select("h", "t").mapInArrow(mapped, "h long, s binary").groupBy("h").agg(F.first("s").alias("s"))


def _far_links(big: DataFrame, root: DataFrame, classes: DataFrame, docs: DataFrame, parts: int) -> DataFrame:
    """(a, b): links of members of one bucket that join different components.

    In each bucket, members outside its most frequent component are held in blocks of about BLOCK shingles, compared with each other, while its other members stream
    past. The first pass keeps the members with a partner in another component that sizes and sketches allow; the second holds
    their sets, compares them and joins components as it goes, so a block gives fewer links than it has members. Two that meet in many
    buckets count in one: each carries its LOW least keys, and the first of these that both have is theirs (where they have none
    in common, every bucket is).
    """
    member = big.select("key", F.col("b").alias("h")).union(big.select("key", F.col("a").alias("h")).distinct())
    known = member.join(root.select(F.col("node").alias("h"), "root"), "h").join(classes.select("h", "n"), "h").repartition(parts, "key")
    most = known.groupBy("key", "root").agg(F.count("h").alias("c"), F.sum("n").alias("n")).groupBy("key").agg(F.max_by(F.struct("root", "n"), F.struct("c", "root")).alias("m"), F.count("*").alias("roots"), F.sum("n").alias("n"))
    most = most.where("roots > 1").select("key", F.col("m.root").alias("main"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("blocks"))
    # (Counting h keeps all of known's columns, so that both uses read one exchange.)
    # Members by their hash, for their least keys and sketches; then each once into every block of its bucket, on side 0 where it is held.
    placed = cut(known.join(most, "key").select("key", "h", "root", "n", "blocks", (F.col("root") != F.col("main")).alias("odd"))).repartition(parts, "h")
    none = F.array_repeat(F.lit(2**63 - 1), LOW)
    low = placed.groupBy("h").agg(F.slice(F.concat(F.array_sort(F.collect_set("key")), none), 1, LOW).alias("low"))
    own = F.col("odd") & (F.col("block") == F.pmod(F.xxhash64("h"), F.col("blocks")))
    every = placed.join(low, "h").join(classes.select("h", "k"), "h").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = every.select("key", "block", F.when(own, 0).otherwise(1).alias("side"), "h", "root", "n", "k", "low")
    names = ["key", "block", "side", "h", "root"]

    def plausible(batches):
        at, held, parts_ = None, None, []

        def batch(key, block, side, h, root_):
            n = len(h)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (np.full(n, key), np.full(n, block), np.full(n, side), h, root_)], names=names)

        def pairs(y):
            """Rows of y with a plausible partner in held, which is marked."""
            yes = np.zeros(len(y.h), bool)
            for a, _, near in held.plausible(y):
                p, q = np.nonzero(near)
                if len(p):
                    first = held.first(at[0], y, p + a, q)
                    yes[p[first] + a] = True
                    held.marked[q[first]] = True
            return yes

        def close():
            """The held members of a block are all there: they meet each other."""
            nonlocal held, parts_
            if held is None and parts_:
                held, parts_ = Block.joined(parts_), []
                pairs(held)

        def marked():
            close()
            if held is not None and held.marked.any():
                yield batch(*at, 0, held.h[held.marked], held.root[held.marked])

        for b in batches:
            key, block, side, h, root_, n = (b.column(c).to_numpy() for c in range(6))
            low = b.column(7).flatten().to_numpy().reshape(-1, LOW)
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]), [True])))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if (key[i], block[i]) != at:
                    yield from marked()
                    at, held, parts_ = (key[i], block[i]), None, []
                m = i + int(np.searchsorted(side[i:j], 1))
                rows = lambda a, z: Block(h[a:z], root_[a:z], n[a:z], [np.frombuffer(x.as_buffer(), np.uint8) for x in b.column(6).slice(a, z - a)], low=low[a:z])
                if m > i:
                    parts_.append(rows(i, m))
                if m == j:
                    continue
                close()
                if held is None:  # a block that got no member
                    continue
                y = rows(m, j)
                yes = pairs(y)
                if yes.any():
                    yield batch(*at, 1, y.h[yes], y.root[yes])
        yield from marked()

    dealt = lambda df: df.repartition(parts, "key", "block").sortWithinPartitions("key", "block", "side")
    few = cut(dealt(rows).mapInArrow(plausible, ", ".join(f"{c} long" for c in names)))
    sets = _sets(docs, cut(few.select("h").distinct().join(classes.select("h", F.col("rep").alias("i")), "h")))

    def linked(batches):
        at, rows, held, top = None, [], None, {}

        def find(x):
            while x in top:
                x = top[x]
            return x

        def meet(row):
            """Links of a row with held ones of other components, which it joins."""
            own = row[1]
            ((_, _, near),) = held.plausible(Block.of([row]))
            for i in np.flatnonzero(near[0]):
                other = int(held.root[i])
                if other != own and similar(held.s[i], row[4]):
                    out.append((row[0], int(held.h[i])))
                    top[other] = own
                    held.root[held.root == other] = own

        def close():
            nonlocal held
            if held is None and rows:
                held = Block.of(rows)
                for row in rows:
                    meet((row[0], find(row[1]), *row[2:]))

        out = []
        with np.errstate(over="ignore"):
            for b in batches:
                for key, block, side, h, root_, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (key, block) != at:
                        close()
                        at, rows, held, top = (key, block), [], None, {}
                    s = np.frombuffer(s, np.uint64)
                    row = (h, find(root_), len(s), np.frombuffer(sketch(s), np.uint8), s)
                    if not side:
                        rows.append(row)
                        continue
                    close()
                    meet(row)
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(2)], names=["a", "b"])
                out = []
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(2)], names=["a", "b"])

    return dealt(few.join(sets, "h").select(*names, "s")).mapInArrow(linked, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets in order reach the similarity."""
    same = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return DEN * same >= NUM * (len(x) + len(y) - same)


class Block:
    """Some members of a bucket: hashes, roots, sizes, sketches, and for some uses sets or least keys; folded sketches are made when first needed."""

    #: Words of sketches that are compared together.
    WORDS = 1 << 21

    def __init__(self, h, root, n, k: list, s=None, low=None):
        self.h, self.root, self.n, self.k, self.s, self.low = np.asarray(h, np.int64), np.array(root, np.int64), np.asarray(n, np.int64), k, s, low
        self.size = np.array([len(x) for x in k], np.int64)
        self.marked = np.zeros(len(k), bool)
        self.folded: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, rows: list) -> Block:
        return cls(*([r[c] for r in rows] for c in range(5)))

    @classmethod
    def joined(cls, parts: list[Block]) -> Block:
        if len(parts) == 1:
            return parts[0]
        one = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return cls(one("h"), one("root"), one("n"), [x for p in parts for x in p.k], low=one("low"))

    def at(self, size: int) -> np.ndarray:
        """All sketches of at least that size, folded to it; shorter ones are zero."""
        if size not in self.folded:
            out = np.zeros((len(self.k), size), np.uint8)
            for i, k in enumerate(self.k):
                while len(k) > size:
                    k = k[: len(k) // 2] ^ k[len(k) // 2 :]
                if len(k) == size:
                    out[i] = k
            self.folded[size] = out.view(np.uint64)
        return self.folded[size]

    def plausible(self, y: Block):
        """(a, z, matrix) for slices of y's rows: which of them and of the held ones are of different components and not ruled out by
        sizes and sketches."""
        sizes = np.unique(np.concatenate((self.size, y.size)))
        step = max(1, self.WORDS // (len(self.h) * int(sizes[-1]) // 8 + 1))
        for a in range(0, len(y.h), step):
            j = slice(a, a + step)
            n = y.n[j, None]
            near = (y.root[j, None] != self.root) & (y.h[j, None] != self.h) & (NUM * np.maximum(n, self.n) <= DEN * np.minimum(n, self.n))
            if near.any():
                less = np.minimum(y.size[j, None], self.size)
                most = (DEN - NUM) * (n + self.n)
                for size in sizes.tolist() if len(sizes) > 1 else [int(sizes[0])]:
                    at = near if len(sizes) == 1 else near & (less == size)
                    p, q = np.flatnonzero(at.any(1)), np.flatnonzero(at.any(0))
                    if len(p):
                        d = np.bitwise_count(y.at(size)[j][p][:, None] ^ self.at(size)[q]).sum(2, dtype=np.int64)
                        box = np.ix_(p, q)
                        near[box] &= ((DEN + NUM) * d <= most[box]) | ~at[box]
            yield a, a + step, near

    def first(self, key: int, y: Block, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which of the pairs (row p of y, held q) have no key below `key` among those that both carry."""
        out = np.ones(len(p), bool)
        for a in range(0, len(p), 1 << 14):
            j = slice(a, a + (1 << 14))
            u, v = y.low[p[j]], self.low[q[j]]
            out[j] = ~((u[:, :, None] == v[:, None, :]) & (u < key)[:, :, None]).any((1, 2))
        return out


def _apart(root: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose roots differ."""
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")


def _grow(root: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the links (a, b) have joined their components."""
    over = components(_apart(root, links).select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return cut(root.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, ra, rb) whose sets, made again from the texts, reach the similarity."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("ra").alias("i")).union(pairs.select("rb")).distinct())
    picked = docs.join(F.broadcast(ids) if ids.count() <= PICK_ROWS else ids, "i", "left_semi")
    both = pairs.join(picked.select(F.col("i").alias("rb"), F.col("t").alias("tb")), "rb").join(picked.select(F.col("i").alias("ra"), F.col("t").alias("ta")), "ra").select("a", "b", "ta", "tb")

    def mapped(batches):
        make, memo = Shingler(), OrderedDict()

        def of(h, t):
            if h in memo:
                memo.move_to_end(h)
                return memo[h]
            s = make(t.as_py())
            if set_hash(s) != h:  # another row with the same id
                return None
            memo[h] = s
            if len(memo) > 200:
                memo.popitem(last=False)
            return s

        with np.errstate(over="ignore"):
            for rows in batches:
                out = []
                for a, b, ta, tb in zip(*(c.to_pylist() if k < 2 else c for k, c in enumerate(rows.columns)), strict=True):
                    x, y = of(a, ta), of(b, tb)
                    if x is not None and y is not None and similar(x, y):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut(both.mapInArrow(mapped, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for every row of docs.

    Rows link when their sets of shingles have a Jaccard similarity of NUM / DEN at least; component_id is the least doc_id
    that links reach. Equal sets are one class and always link. Null, empty and wordless texts have an empty set, class null,
    and are linked with nothing; a row with a null doc_id takes no part in links and has a null component_id; rows that
    repeat a doc_id stay rows of their own; an empty table gives an empty result. Other columns don't matter.
    """
    return grouped(docs, doc_id, text).drop("root")


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates with root, a class that stands for the component: components whose least doc_id is the same differ in it."""
    rows = text_batches(docs).select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("binary").alias("t"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    narrow = cut(_narrow(rows))
    sets = narrow.where("not often")
    classes = cut(sets.where("n > 0 and i is not null").groupBy("h").agg(F.min("i").alias("rep"), F.max("n").alias("n"), F.first("k").alias("k")))
    held = spark.sparkContext.broadcast(_common(narrow.where("often")))
    stars = cut(_stars(_buckets(rows, held), parts))
    # Most members join their component by the pair that shares most words; other pairs are read only while they would join two.
    pairs = cut(_plausible(stars.groupBy("a", "b").agg(F.count("*").alias("c")), classes))
    best = pairs.groupBy("b").agg(F.max_by(F.struct("a", "ra", "rb"), F.struct("c", -F.col("ra"))).alias("m")).select("m.a", "b", "m.ra", "m.rb")
    root = _grow(classes.select(F.col("h").alias("node"), F.col("h").alias("root")), _verified(best, rows))
    root = _grow(root, _verified(_apart(root, pairs).select("a", "b", "ra", "rb"), rows))
    # In larger buckets, members of different components are compared.
    # First in one of eight buckets, which finds most links once instead of many times; then in the others that are not yet one component.
    big, eighth = stars.where("key is not null"), F.col("key").bitwiseAND(F.lit(7)) == 0
    for some in (big.where(eighth), big.where(~eighth)):
        root = _grow(root, _far_links(some, root, classes, rows, parts))
    final = classes.join(root.withColumnRenamed("node", "h"), "h").select("h", "rep", "root")
    least = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = final.join(least, "root").select("h", "component_id", "root")
    out = sets.where("n > 0 and i is not null").join(of_class, "h").select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("h").alias("class"), "component_id", "root")
    rest = sets.where("n = 0 or i is null").select("i", "n", F.when(F.col("n") > 0, F.col("h")), "i", F.lit(None).cast("long"))
    return out.union(rest)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""


def without(docs: DataFrame, gone: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows named in gone (doc_id, __class).

    The join carries ids only where gone is small enough to broadcast (PICK_ROWS), else rows meet in a shuffle by doc_id. A row's class
    is made again from its text only where its doc_id is listed.
    """
    if gone.sparkSession is not docs.sparkSession:
        raise ValueError("both tables must belong to one session")
    gone = cut(gone)
    text_batches(docs)
    listed = gone.groupBy(doc_id).agg(F.collect_set("__class").alias("__gone"))
    marked = docs.join(F.broadcast(listed) if gone.count() <= PICK_ROWS else listed, doc_id, "left")
    at_text, at_gone = marked.columns.index(text), marked.columns.index("__gone")

    def mapped(batches):
        make = Shingler()
        with np.errstate(over="ignore"):
            for b in batches:
                texts, lists = b.column(at_text), b.column(at_gone)
                stay = [not g.is_valid or not len(s := make(t.cast(pa.binary()).as_py() if t.is_valid else None)) or set_hash(s) not in set(g.as_py()) for t, g in zip(texts, lists, strict=True)]
                yield b.filter(pa.array(stay, pa.bool_()))

    return marked.mapInArrow(mapped, marked.schema).select(*docs.columns)


def with_class(docs: DataFrame, text: str = "text", out: str = "__class") -> DataFrame:
    """docs plus the class of each row's text as near_duplicates gives it; null for a text without words."""
    at = text_batches(docs).columns.index(text)

    def mapped(batches):
        make = Shingler()
        with np.errstate(over="ignore"):
            for b in batches:
                sets = [make(t.cast(pa.binary()).as_py() if t.is_valid else None) for t in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([set_hash(s) if len(s) else None for s in sets], pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(mapped, T.StructType([*docs.schema, T.StructField(out, T.LongType())]))
