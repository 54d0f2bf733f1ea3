"""Language identification of mixed-language text.

Every letter trigram of a word carries a log-likelihood per language; the script of a word's first letter leaves only languages that
use it. A Viterbi pass over the words, with a penalty for each switch of language, labels spans; the document's language is
the one that covers most letters. Learning counts trigrams with Spark over a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.common import table, text_batches

#: About so many labelled documents are learnt from (a documented bound); all are when there are fewer.
FIT_DOCS = 20_000
#: Trigrams are hashed to so many cells per language: the model's proven size is languages x CELLS.
CELLS = 1 << 16
PENALTY = 12.0
#: Letters, or words, of one text that are worked on together.
CHUNK = 1 << 16
#: Code points at which a script starts; what lies between two starts is one script.
SCRIPT_STARTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32400, "other"),
)
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
STARTS = np.array([a for a, _ in SCRIPT_STARTS])
SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


class Text:
    """A text's words of letters as arrays: where they start and end in code points, the trigrams' cells, and the scripts."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int32)
        kind, low = tables()
        letter = kind[c] > 0
        self.letters = letter
        edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
        self.start, self.end = edge[::2], edge[1::2]
        self.script = kind[c[self.start]].astype(np.int64) - 1
        padded = np.full(len(c) + 2, 32, np.int64)
        padded[1:-1] = np.where(letter, low[c], 32)
        self.cells = (((padded[:-2] * 1000003) ^ padded[1:-1]) * 1000003 ^ padded[2:]) * 0x9E3779B1 >> 12 & (CELLS - 1)


_TABLES: tuple[np.ndarray, np.ndarray] | None = None


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its script's number plus one if it is a letter, else 0; and its lower case where that is one code point."""
    global _TABLES
    if _TABLES is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        script = SCRIPT_AT[np.searchsorted(STARTS, np.arange(0x110000), side="right") - 1]
        low = np.arange(0x110000, dtype=np.int32)
        for i in np.flatnonzero(letter):
            x = chr(i).lower()
            if len(x) == 1:
                low[i] = ord(x)
        _TABLES = np.where(letter, script + 1, 0).astype(np.uint8), low
    return _TABLES


class Model:
    """langs in code-point order, logp (CELLS x langs), and which scripts each language uses (scripts x langs)."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        total = counts.sum(0)
        self.logp = np.log((counts + 0.5) / (total + 0.5 * CELLS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.uses = share >= 0.01
        self.uses[~self.uses.any(1)] = True  # a script that no language showed excludes none
        self.prior = np.log((docs + 1) / (docs.sum() + len(langs)))

    def words(self, t: Text) -> np.ndarray:
        """Per-word scores: the trigrams' log-likelihoods summed, less 50 a letter for languages that don't use the word's script.

        Letters are summed in chunks, so that a very long text takes memory for its words alone.
        """
        s = np.empty((len(t.start), len(self.langs)))
        a = 0
        while a < len(t.start):
            b = max(a + 1, int(np.searchsorted(t.end, t.start[a] + CHUNK, side="right")))
            at, size = t.start[a], t.end[b - 1] - t.start[a]
            sums = np.zeros((size + 1, len(self.langs)))
            np.cumsum(self.logp[t.cells[at : at + size]], axis=0, out=sums[1:])
            s[a:b] = sums[t.end[a:b] - at] - sums[t.start[a:b] - at]
            a = b
        off = ~self.uses[t.script]
        s -= 50.0 * (t.end - t.start)[:, None] * off
        return s

    def path(self, s: np.ndarray) -> np.ndarray:
        """Each word's language on the best path, where a switch costs PENALTY.

        One language all along is the best path when no run of words favours another one by more than the penalty; that
        is tested with running sums first, and only other texts take the step-by-step pass.
        """
        total = s.sum(0) + self.prior
        best = int(total.argmax())
        gain = np.cumsum(s - s[:, [best]], axis=0)
        low = np.minimum(np.minimum.accumulate(np.vstack((np.zeros(s.shape[1]), gain)), axis=0)[:-1], 0)
        if (gain - low).max() <= PENALTY - np.abs(self.prior).max():
            return np.full(len(s), best)
        n, k = s.shape
        back = np.empty((n, k), dtype=np.int16)
        v, own = (s[0] + self.prior).tolist(), range(k)
        for i in range(1, n):
            if (i - 1) % CHUNK == 0:
                rows = s[i : i + CHUNK].tolist()
            top = max(own, key=v.__getitem__)
            jump = v[top] - PENALTY
            row, nxt = rows[(i - 1) % CHUNK], []
            for j in own:
                if v[j] >= jump:
                    back[i, j] = j
                    nxt.append(v[j] + row[j])
                else:
                    back[i, j] = top
                    nxt.append(jump + row[j])
            v = nxt
        out = np.empty(n, dtype=np.int64)
        out[-1] = max(own, key=v.__getitem__)
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out

    def label(self, text: str | None) -> tuple[str, float, list]:
        """The language that covers most letters (`und` without letters), its share of the letters, and the spans."""
        t = Text(text) if text else None
        if t is None or not len(t.start) or not self.langs:
            return "und", 0.0, []
        at, size = self.path(self.words(t)), t.end - t.start
        letters = np.bincount(at, weights=size, minlength=len(self.langs))
        best = int(letters.argmax())
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        spans = [{"start": int(t.start[a]), "end": int(t.end[b]), "lang": self.langs[at[a]]} for a, b in zip(first, last, strict=True)]
        return self.langs[best], float(letters[best] / letters.sum()), spans


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from about fit_docs rows, drawn by a hash of the text, that have both a text and a language.

    Only sums come to the driver: languages x (CELLS + scripts) numbers at most. Without any such row the model knows no
    language and labels everything `und`. Texts without letters and empty ones add nothing, texts of any length count whole, copies count
    as often as they are drawn; other columns don't matter.
    """
    rows = text_batches(docs).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    n = rows.count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))

    def counted(batches):
        seen: dict[str, list] = {}
        for b in batches:
            for t, lg in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = Text(t)
                have = seen.setdefault(lg, [np.zeros(CELLS, np.int64), np.zeros(len(SCRIPTS), np.int64), 0])
                have[0] += np.bincount(x.cells[x.letters], minlength=CELLS)
                have[1] += np.bincount(x.script, weights=x.end - x.start, minlength=len(SCRIPTS)).astype(np.int64)
                have[2] += 1
        for lg, (cells, scripts, k) in seen.items():
            every = np.concatenate((cells, scripts, [k]))
            some = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array([lg] * len(some)), pa.array(some, pa.int64()), pa.array(every[some], pa.int64())], names=["l", "i", "n"])

    sums = rows.mapInArrow(counted, "l string, i long, n long").groupBy("l", "i").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["l"].unique())
    grid = np.zeros((CELLS + len(SCRIPTS) + 1, len(langs)))
    if langs:
        grid[sums["i"].to_numpy(), sums["l"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = sums["n"].to_numpy()
    return Model(langs, grid[:CELLS], grid[CELLS:-1], grid[-1])


FOUND = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "langid") -> DataFrame:
    """docs plus a struct `out`: lang, score (share of the letters in that language's spans), spans by code points.

    A null text or one without letters is `und` with score 0 and no spans; equal texts get equal results; ties go to the
    language first in code-point order; an empty table stays empty. Texts of any length are read whole, one at a time. Other columns
    pass through; one named like `out` is replaced.
    """
    docs = text_batches(docs).drop(out)
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

    def batches(it):
        m = held.value
        for b in it:
            rows = [dict(zip(("lang", "score", "spans"), m.label(t.as_py()), strict=True)) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(batches, T.StructType([*docs.schema, T.StructField(out, T.DataType.fromDDL(FOUND))]))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = fit(docs.where("not held_out"))
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("langid.lang").alias("lang_pred"), F.col("langid.score").alias("score"))
