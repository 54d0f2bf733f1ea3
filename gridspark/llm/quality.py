"""Quality rules, line first: lines that break a punctuation, navigation or boilerplate rule go, then documents that lost too much.

The rules name no words of any language. Punctuation: too many signs, or no sign that ends or parts sentences in any script. Navigation: items
between separators. Boilerplate: a line that stands between PLACES different pairs of neighbouring lines or more in the corpus, and half as many as
it has occurrences, which a notice in many documents does, and a line of a document with many exact or near copies does not. DataFrame
expressions only; for the boilerplate rule hashes of lines are counted and joined back, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, cut, let, table, words_of

WINDOW = 8
#: A line breaks the punctuation rule when more than this percentage of its characters are signs.
MAX_SIGNS = 6
#: Documents that keep less than this percentage of their lines' characters are rejected.
MIN_KEPT = 50
#: Different pairs of neighbours from which a line is boilerplate.
PLACES = 20
#: So many rows (of 8 to 16 bytes and short lists) at most are broadcast; with more they meet in a shuffle.
PICK_ROWS = 400_000
NOT_SIGNS = r"[^#*$%&|<>{}\\~^!?]+"
#: Signs that end or part sentences, and scripts that write without them (Thai, Lao, Khmer).
SENTENCE = "[.!?:;,\u2026\u3002\uff01\uff1f\uff1a\uff1b\u3001\uff0c\u061f\u06d4\u060c\u0964\u0965\u1362\u0589\u0e00-\u0eff\u1780-\u17ff]"
NAVIGATION = r"(^| )[|>\xBB\xB7] .*[^ ] [|>\xBB\xB7]( |$)"


def lines_of(text: Column) -> Column:
    """Lines parted by \\n that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def line_key(line: Column) -> Column:
    """What makes two lines the same: their characters in lower case without spaces at the ends, as a hash."""
    return F.xxhash64(F.lower(F.trim(line)))


def line_fails(line: Column) -> Column:
    """True if the line breaks the punctuation or navigation rule."""
    signs = F.length(F.regexp_replace(line, NOT_SIGNS, "")) * 100 > F.length(line) * MAX_SIGNS
    return signs | ~F.rlike(line, F.lit(SENTENCE)) | F.rlike(F.trim(line), F.lit(NAVIGATION))


def repeat_words(words: Column) -> Column:
    """Words in windows of 8 consecutive words found twice or more in the array. Windows compare by 64-bit hashes."""

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            at = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            add = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
            return F.aggregate(F.sort_array(at), start, add, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def measure(text: Column) -> Column:
    """A struct of the base counts of a text and its lines (key, characters, whether a rule is broken); of a null text they are those of an empty one."""
    chars = F.length(text) - F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))
    told = lambda x: F.struct(line_key(x).alias("k"), F.length(x).alias("n"), line_fails(x).alias("fails"))
    line = let(lines_of(text), lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"), F.transform(ls, told).alias("lines")))
    word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    return F.struct(chars.cast("long").alias("word_chars"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), line.alias("line"), word.alias("word"))


def boilerplate(docs: DataFrame, text: str = "text", places: int = PLACES) -> DataFrame:
    """(k): keys of the lines that stand between `places` different pairs of neighbours or more (no neighbour is one of its own), and half as many as they have
    occurrences."""
    keys = docs.select(F.transform(lines_of(F.col(text)), line_key).alias("ks")).where("ks is not null")
    at = keys.select(F.explode(F.transform("ks", lambda k, i: F.struct(k.alias("k"), F.get("ks", i - 1).alias("a"), F.get("ks", i + 1).alias("b")))).alias("s"))
    by = at.groupBy("s.k", "s.a", "s.b").agg(F.count("*").alias("n")).groupBy("k").agg(F.count("*").alias("places"), F.sum("n").alias("n"))
    return by.where((F.col("places") >= places) & (F.col("places") * 2 >= F.col("n"))).select("k")


def clean_lines(docs: DataFrame, text: str = "text", out: str = "quality", places: int = PLACES) -> DataFrame:
    """docs plus a struct `out`: base counts, base_failed, cleaned_text (the lines kept, joined by \\n), kept_share, kept.

    A null or empty text has no words, so base_failed is true and kept false; repeated rows are judged alike, each in its
    own row; an empty table stays empty. Texts of any length are judged whole, row by row. Other columns pass through; one named like `out` is replaced, names
    that begin with __ are taken. Line and window equality rest on 64-bit hashes.
    """
    docs = docs.drop(out)
    few = lambda df: F.broadcast(df) if df.count() <= PICK_ROWS else df
    t = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(F.xxhash64(t).alias("h"), F.length(t).alias("n"))
    often = cut(boilerplate(docs, text, places))
    found = docs.select(row.alias("__row"), F.explode(F.array_distinct(F.transform(lines_of(t), line_key))).alias("k")).join(few(often), "k")
    found = cut(found.groupBy("__row").agg(F.collect_set("k").alias("__often")))  # one text's lines
    rows = docs.withColumn("__row", row).withColumn("__m", measure(t)).join(few(found), "__row", "left")
    goes = lambda x: x["fails"] | F.array_contains(F.coalesce("__often", F.array().cast("array<bigint>")), x["k"])
    line, word = F.col("__m.line"), F.col("__m.word")
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    every, stay = add(line["lines"]), add(F.filter(line["lines"], lambda x: ~goes(x)))
    n, rep = word["n_words"], word["n_repeat_words"]
    failed = (n < 20) | (rep * 100 > n * 30)
    cleaned = F.array_join(F.filter(lines_of(t), lambda x, i: ~goes(F.get(line["lines"], i))), "\n")
    q = F.struct(
        n.alias("n_words"), F.col("__m.word_chars").alias("word_chars"), F.col("__m.n_symbols").alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"), rep.alias("n_repeat_words"), failed.alias("base_failed"),
        cleaned.alias("cleaned_text"), F.try_divide(stay, every).alias("kept_share"), (~failed & (stay * 100 >= every * MIN_KEPT)).alias("kept"),
    )
    return rows.select(*docs.columns, q.alias(out))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM (SELECT r, i, ws[i:i + 7] AS v FROM w, unnest(range(1, greatest(len(ws) - 6, 1))) t(i))),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM win, range(8) s(k) WHERE c > 1 GROUP BY r),
ln AS (SELECT r, i, ls[i] AS x, lower(trim(ls[i], ' ')) AS k, CASE WHEN i > 1 THEN lower(trim(ls[i - 1], ' ')) END AS a, CASE WHEN i < len(ls) THEN lower(trim(ls[i + 1], ' ')) END AS b FROM w, unnest(range(1, len(ls) + 1)) t(i)),
bp AS (SELECT k FROM (SELECT k, a, b, count(*) AS n FROM ln GROUP BY k, a, b) GROUP BY k HAVING count(*) >= {PLACES} AND count(*) * 2 >= sum(n)),
lk AS (SELECT r, sum(length(x)) AS line_chars, coalesce(sum(length(x)) FILTER (bp.k IS NULL AND NOT (length(regexp_replace(x, '{NOT_SIGNS}', '', 'g')) * 100 > length(x) * {MAX_SIGNS}
         OR NOT regexp_matches(x, '{SENTENCE}') OR regexp_matches(trim(x, ' '), '{NAVIGATION}'))), 0) AS kept_chars FROM ln LEFT JOIN bp ON ln.k = bp.k GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
      FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN lk ON w.r = lk.r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars * 100 >= line_chars * {MIN_KEPT} AS kept FROM m
"""
