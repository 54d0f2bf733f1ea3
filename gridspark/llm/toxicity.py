"""Toxic passages by maximum-scoring segment search, calibrated with extreme-value theory.

Words, and the beginnings of words as a back-off, get log-odds of standing in toxic text under an informative Dirichlet prior. One
linear scan of a document's word scores finds all maximal-scoring segments; each raw score becomes a p-value of the
Karlin-Altschul extreme-value law for a text of that length, significant segments are the toxic passages, and the document's
score comes from a logistic calibration of the combined evidence.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import cut, folded_table, table, text_batches

#: About so many labelled documents are learnt from (a documented bound); all are when there are fewer.
FIT_DOCS = 20_000
#: Strength of the Dirichlet prior, in documents; a feature needs MIN_DOCS documents and MIN_Z to count.
PRIOR, MIN_DOCS, MIN_Z = 10.0, 4, 3.0
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: A passage is significant below this p-value.
ALPHA = 0.05
FOLDED = folded_table(b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLDED).split() if text else []


def features(w: bytes) -> list[bytes]:
    """The word and its beginnings of 3 to 9 bytes (marked by a star)."""
    return [w, *(w[:k] + b"*" for k in PREFIXES if len(w) >= k)]


def segments(scores: list[tuple[int, float]], n: int, step: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of n words in one pass, where words outside `scores` (position, value) score -step.

    Each candidate keeps the running sum before and after it; one whose left sum is not below an earlier one's opens a new
    candidate, one whose right sum exceeds it is merged with what lies between. A candidate also keeps the place of the nearest
    earlier one with a lower left sum, so that the search steps over the others and stays linear.
    """
    out: list[list] = []  # start, end, sum before, sum after, place of the nearest earlier one whose sum before is lower
    total, last = 0.0, -1
    for at, v in scores:
        total -= step * (at - last - 1)
        last = at
        if v <= 0:
            total += v
            continue
        cur = [at, at + 1, total, total + v]
        total += v
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= cur[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= cur[3]:
                out.append([*cur, j])
                break
            cur, before = [out[j][0], cur[1], out[j][2], cur[3]], out[j][4]
            del out[j:]
            j = before
    return [(a, b, hi - lo) for a, b, lo, hi, _ in out]


class Model:
    def __init__(self, odds: dict[bytes, tuple[float, float]], rate: float):
        self.odds = odds  # feature -> (log-odds, |z|)
        self.step = 0.02  # what an uninformative word costs: the mean score is below 0, as the theory asks
        self.rate = rate  # share of clean words that score above 0
        self.lam, self.k = 1.0, max(rate, 1e-6)
        self.cal = (-3.0, 1.0, 0.0)

    def word(self, w: bytes) -> float:
        """The log-odds of the word's most significant feature."""
        best, z = 0.0, 0.0
        for f in features(w):
            if (x := self.odds.get(f)) and x[1] > z:
                best, z = x
        return best

    def scan(self, text: str | None, memo: dict) -> tuple[list, int]:
        """The segments of the text, in which every occurrence of a word counts, and the number of words."""
        ws, scored = words(text), []
        for i, w in enumerate(ws):
            v = memo.get(w)
            if v is None:
                if len(memo) > 500_000:
                    memo.clear()
                v = memo[w] = self.word(w)
            if v:
                scored.append((i, v))
        return segments(scored, len(ws), self.step), len(ws)

    def evidence(self, found: list, n: int) -> tuple[float, float, list]:
        """Bits of the best passage and of all significant ones together, and those passages with their p-values."""
        kept, best, total = [], 0.0, 0.0
        for a, b, s in found:
            e = self.k * max(n, 1) * math.exp(-self.lam * s)  # chance segments of that score expected in n words
            p = -math.expm1(-e)
            if p <= ALPHA:
                kept.append({"start": a, "end": b, "score": s, "p": p})
                bits = min(-math.log(max(p, 1e-300)), 60.0)
                best, total = max(best, bits), total + bits
        return best, min(total, 200.0), kept

    def score(self, best: float, total: float) -> float:
        a, b, c = self.cal
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * best + c * total))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps on a few columns."""
    x = np.hstack((np.ones((len(x), 1)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge @ w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w += np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, text: str = "text", label: str = "label", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from about fit_docs rows, drawn by a hash of the text, whose label is 0 or 1; null texts are left out.

    Spark counts features per class; those of at least MIN_DOCS documents and significant come to the driver, so the model
    is bounded by the sample. Without both classes the model finds nothing and every score is the base rate. Texts are read whole,
    one at a time; other columns don't matter.
    """
    rows = text_batches(labelled).select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).where("t is not null and y in (0, 1)")
    size = rows.count()
    if size > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / size))
    # Each equal text counts once per label, so that groups of copies don't weigh more than one text. The sample is drawn once and kept.
    rows = cut(rows.distinct())

    def counted(batches):
        for b in batches:
            n: dict[bytes, list] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kinds = set(words(t))
                in_doc = Counter(f for w in kinds for f in features(w))
                in_doc[b""] = len(kinds)
                for f, c in in_doc.items():
                    have = n.setdefault(f, [0, 0, 0, 0])
                    have[y] += 1
                    have[2 + y] += c
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([n[k][i] for k in keys], pa.int64()) for i in range(4))], names=["f", "d0", "d1", "c0", "c1"])

    # d: documents that have the feature, c: different words in them that have it, by label.
    sums = rows.mapInArrow(counted, "f binary, d0 long, d1 long, c0 long, c1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1")))
    total = sums.where(F.octet_length("f") == 0).first()
    if not total or not total["d0"] or not total["d1"]:
        m = Model({}, 0.0)
        share = (total["d1"] + 1) / (total["d0"] + total["d1"] + 2) if total else 0.0
        m.cal = (math.log(max(share, 1e-6) / (1 - min(share, 1 - 1e-6))), 0.0, 0.0)
        return m
    n0, n1 = float(total["c0"]), float(total["c1"])
    mean = (F.col("c0") + F.col("c1")) / F.lit(n0 + n1)
    prior = PRIOR * mean * F.lit((n0 + n1) / float(total["d0"] + total["d1"]))  # as much as PRIOR documents hold
    a0, a1 = F.col("c0") + prior, F.col("c1") + prior
    delta = F.log(a1 / n1) - F.log(a0 / n0)
    # Words of one document hang together, so the variance counts documents.
    z = F.abs(delta) / F.sqrt(1 / (F.col("d1") + prior) + 1 / (F.col("d0") + prior))
    kept = sums.where((F.octet_length("f") > 0) & (F.col("d0") + F.col("d1") >= MIN_DOCS)).select("f", F.least(F.greatest(delta, F.lit(-6.0)), F.lit(6.0)).alias("d"), z.alias("z"))
    kept = kept.where((F.col("z") >= MIN_Z) & (F.abs("d") > 0.7))
    got = kept.collect()
    m = Model({bytes(r["f"]): (float(r["d"]), float(r["z"])) for r in got}, 0.0)
    held = rows.sparkSession.sparkContext.broadcast(m)

    def scanned(batches):
        model, memo = held.value, {}
        for b in batches:
            raw = [(y, *model.scan(t, memo)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in raw], pa.int32()), pa.array([n for *_, n in raw], pa.int64()), pa.array([[s for *_, s in f] for _, f, _ in raw], pa.list_(pa.float64()))], names=["y", "n", "s"])

    found = cut(rows.mapInArrow(scanned, "y int, n long, s array<double>"))
    high = F.filter("s", lambda v: v > 1.0)
    m.lam, m.k = _extreme_value(*found.where("y = 0").agg(F.sum("n"), F.sum(F.size(high)), F.sum(F.aggregate(high, F.lit(0.0), lambda t, v: t + v))).first())
    fitted = rows.sparkSession.sparkContext.broadcast(m)

    def weighed(batches):
        model = fitted.value
        for b in batches:
            got = [model.evidence([(0, 0, v) for v in s], n)[:2] for n, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.float64())], names=["y", "best", "total"])

    sample = found.mapInArrow(weighed, "y int, best double, total double").collect()  # three numbers for each of about fit_docs rows
    x = np.array([(r["best"], r["total"]) for r in sample])
    y = np.array([r["y"] for r in sample], dtype=float)
    w = _logistic(x, y)
    w[0] -= _best_cut(w[0] + x @ w[1:], y)
    m.cal = tuple(float(v) for v in w)
    return m


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """Where cutting gives the best F1 on the sample, midway between neighbours: the score of one half is put there."""
    order = np.argsort(-logit, kind="stable")
    l, hits = logit[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(l) + 1) + y.sum())
    ends = np.flatnonzero(np.concatenate((l[1:] < l[:-1], [True])))
    k = ends[f1[ends].argmax()]
    return float((l[k] + l[k + 1]) / 2) if k + 1 < len(l) else float(l[k]) - 1.0


def _extreme_value(words: int | None, n: int | None, total: float | None) -> tuple[float, float]:
    """lambda and K from so many words of clean texts, whose n segment scores above 1 sum to total and decay as exp(-lambda s) at a rate K per word."""
    n = n or 0
    lam = 1.0 if n < 20 else float(np.clip(1 / max(total / n - 1.0, 1e-3), 0.3, 2.0))
    return lam, max(n, 1) / (words or 1) * math.exp(lam)


FOUND = "struct<score:double,passages:array<struct<start:int,end:int,score:double,p:double>>>"


def find_toxic(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs plus a struct `out`: score (0 to 1) and the significant passages (word positions, raw score, p-value).

    Null, empty and wordless texts get the score of a text without evidence and no passages; equal texts get equal
    results, also where passages tie; an empty table stays empty. Texts of any length are searched whole, one at a time. Other columns pass through;
    one named like `out` is replaced.
    """
    docs = text_batches(docs).drop(out)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))])

    def batches(it):
        m, memo = held.value, {}
        for b in it:
            rows = []
            for t in b.column(at):
                best, total, kept = m.evidence(*m.scan(t.as_py(), memo))
                rows.append({"score": m.score(best, total), "passages": kept})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(batches, T.StructType([*docs.schema, T.StructField(out, T.DataType.fromDDL(FOUND))]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = fit(docs.where("not held_out").join(labels, "doc_id"))
    out = find_toxic(docs, model)
    score = F.col("toxicity.score")
    return out.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
