"""Personal data by bootstrapped contextual extraction.

Four base expressions find e-mail addresses, IP addresses, card and phone numbers. These seeds induce lexical patterns: the one, two
or three words before or after an identifier, per kind. Patterns and instances form a bipartite graph that Spark scores in rounds. A pattern's
worth is s / (s + x + SMOOTH): s sums the worth of its different trusted instances, and x counts what contradicts it, its different
tokens with a digit or an @ that are of another kind or of none. Tokens of the kind's shape that nobody knows yet count neither way. An untrusted
instance is worth the noisy-or of its patterns of one width, the best width of a side, and the noisy-or of both sides; instances above
the threshold become trusted. A pattern counts once it has LEAST_SEEDS different trusted instances, seeds or discovered ones, and rounds go
on until no instance is newly trusted and worth no longer grows. A trusted instance is extracted where a pattern of at least HALF stands
beside it, and elsewhere only when two different such patterns agree on it. An instance is a token with a digit or an @, or a run of up to five of them that has a
kind's shape, such as a number in groups. DataFrame expressions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import SPACE, cut, let, table

KINDS = ("email", "ip", "card", "phone")
#: Base expressions in linear-time forms of the contract's. A match may start at the end of the one before (\G) or where a run starts.
#: What joins parts (a dot between two domain characters, a space or hyphen between two digits) is first replaced by \x01, so that
#: a domain or a card is one run and no group repeats, which would recurse on long chains.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x01-]))[A-Za-z0-9._%+\x01-]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x01]++"
PHONE = r"\+[0-9][ ().0-9\-]+[0-9]"
JOINT, DOT = r"(?<=[0-9])[ -](?=[0-9])", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
#: Identifier-like tokens: words with a digit or an @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Shapes of instances that the base expressions leave out, by kind.
SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^([0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
    "card": r"^[0-9](-?[0-9]){11,18}$",
    "phone": r"^\(?[0-9]{2,4}\)?[-.][0-9]{2,4}([-.][0-9]{2,4}){1,3}$",
}
#: Shapes of instances that run over several tokens, parted by single spaces, and the digits that they may have.
RUNS = {"phone": (r"^\+?\(?[0-9]{1,4}\)?( \(?[0-9]{2,4}\)?| [0-9]{2,4}([-.][0-9]{2,4})*){1,4}$", 8, 15), "card": (r"^[0-9]{4}( [0-9]{4}){2,3}( [0-9]{1,3})?$", 12, 19)}
#: Tokens in an instance, at most.
LONGEST = 5
TRUST, LEAST_SEEDS, SMOOTH, HALF = 0.9, 3, 2.0, 0.5
#: Words in a pattern, at most.
WIDTH = 3
#: The kind of tokens that have no kind's shape.
NONE = "none"
#: Rounds end when the worth of all discovered instances together grows by no more than this.
SETTLED = 1e-6
STEP = 256


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts: the running sum of the lengths before it, in two levels so that many matches stay cheap."""
    lens = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda k: F.length(F.get(pieces, k)) + F.coalesce(F.length(F.get(found, k - 1)), F.lit(0)))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def summed(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / STEP).cast("int")), lambda b: add(F.slice(n, b * STEP + 1, STEP)))
        before = lambda s: F.transform(s, lambda x, b: F.when(b == 0, 0).otherwise(add(F.slice(s, 1, F.greatest(b, F.lit(1))))))
        return let(let(blocks, before), lambda p: F.transform(n, lambda x, k: F.get(p, F.floor(k / STEP).cast("int")) + add(F.slice(n, F.floor(k / STEP).cast("int") * STEP + 1, k % STEP + 1))))

    return let(lens, summed)


SPAN = "array<struct<start:int,end:int,value:string,left:array<bigint>,right:array<bigint>>>"


def matches(text: Column, pattern: str, keep=None, undo: str | None = None) -> Column:
    """All leftmost matches of the pattern as structs (start, end, value, left, right): code points, end exclusive; left and right are hashes of
    the one, two and three lower-cased words before and after, as far as the match before and the one after let them. undo: what \x01 stands for."""
    widths = F.array(*(F.lit(n) for n in range(1, WIDTH + 1)))
    hashed = lambda side, w, cut_: F.transform(F.filter(widths, lambda n: F.size(w) >= n), lambda n: F.xxhash64(F.lit(side), cut_(w, n)))
    plain = lambda c: F.translate(c, "\x01", undo) if undo else c

    def built(found: Column) -> Column:
        def placed(pieces: Column) -> Column:
            def told(words: Column) -> Column:
                left = lambda k: let(F.array_remove(F.get(words, k), ""), lambda w: hashed("left", w, lambda w, n: F.slice(w, -n, n)))
                # What follows up to the next space is still the same word.
                right = lambda k: let(F.array_remove(F.slice(F.get(words, k + 1), 2, WIDTH), ""), lambda w: hashed("right", w, lambda w, n: F.slice(w, F.lit(1), n)))
                return let(_starts(pieces, found), lambda at: F.transform(found, lambda m, k: F.struct(F.get(at, k).alias("start"), (F.get(at, k) + F.length(m)).alias("end"), plain(m).alias("value"), left(k).alias("left"), right(k).alias("right"))))

            return let(F.transform(pieces, lambda p: F.split(F.lower(plain(p)), SPACE + "+")), told)

        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern), placed))

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), built)
    return F.filter(out, lambda s: keep(s["value"])) if keep else out


def is_ip(v: Column) -> Column:
    part = lambda x: F.ltrim(x, F.lit("0"))
    return F.forall(F.split(v, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.concat(F.lit("0"), F.substring(part(x), 1, 3)).cast("int") <= 255))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def is_card(v: Column) -> Column:
    def luhn(d: Column) -> Column:
        twice = lambda x, k: F.when((F.size(d) - k) % 2 == 1, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))
        return F.aggregate(F.transform(d, twice), F.lit(0), lambda s, x: s + x) % 10 == 0

    d = digits(v)
    return F.length(d).between(16, 19) & let(F.transform(F.array_remove(F.split(d, ""), ""), lambda c: c.cast("int")), luhn)


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches by kind; an expression runs only on texts that hold its sign."""
    some = lambda test, value: F.when(test, value).otherwise(F.array().cast(SPAN))
    digit = F.rlike(text, F.lit("[0-9]"))
    joined = lambda by: F.regexp_replace(F.translate(text, "\x01", "\x02"), by, "\x01")
    return {
        "email": some(F.contains(text, F.lit("@")), let(joined(DOT), lambda j: matches(j, EMAIL, undo="."))),
        "ip": some(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), matches(text, IP, is_ip)),
        "card": some(digit, let(joined(JOINT), lambda j: matches(j, CARD, is_card, undo=" "))),
        "phone": some(F.rlike(text, F.lit(r"\+[0-9]")), matches(text, PHONE, lambda v: F.length(digits(v)).between(8, 15))),
    }


def bare(value: Column) -> tuple[Column, Column]:
    """How many signs stand before a token's first letter, digit or bracket, and the token without the signs at its ends."""
    return F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}(+]*", 0)), F.regexp_extract(value, r"^[^\p{L}\p{N}(+]*(.*?)[^\p{L}\p{N}]*$", 1)


def runs(tokens: Column) -> Column:
    """For each of some tokens (in order) a struct: run, the longest run of two to LONGEST tokens from there on that stand one space apart and together have a shape of RUNS (start, end, value, left,
    right, kind), or null where there is none or it ends within one that began before; and inside, whether the token lies in a run. A token looks at its LONGEST neighbours only."""
    last = F.size(tokens) - 1

    def built(k: Column, m: Column) -> Column:
        part = F.slice(tokens, k + 1, m + 1)
        near = F.forall(F.sequence(F.lit(1), m), lambda j: F.get(part, j)["start"] == F.get(part, j - 1)["end"] + 1)
        value = F.array_join(F.transform(part, lambda x: x["value"]), " ")

        def told(v: Column) -> Column:
            lead, core = bare(v)

            def shaped(c: Column) -> Column:
                n = F.length(digits(c))
                kind = F.coalesce(*(F.when(F.rlike(c, F.lit(p)) & n.between(lo, hi), k_) for k_, (p, lo, hi) in RUNS.items()))
                start = F.get(part, F.lit(0))["start"] + lead
                return F.struct(start.alias("start"), (start + F.length(c)).alias("end"), c.alias("value"), F.get(part, F.lit(0))["left"].alias("left"), F.get(part, m)["right"].alias("right"), kind.alias("kind"), m.alias("m"))

            return let(core, shaped)

        return F.when(near, let(value, told))

    def longest(k: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST - 1), last - k)), lambda m: built(k, m)), lambda r: r["kind"].isNotNull())
        return F.when(k < last, let(found, lambda f: F.get(f, F.size(f) - 1)))

    def marked(b: Column) -> Column:
        back = lambda k, lo, test: F.coalesce(F.exists(F.sequence(F.lit(lo), F.lit(LONGEST - 1)), lambda j: F.coalesce(test(F.get(b, k - j), j), F.lit(False))), F.lit(False))
        own = lambda x, k: F.when(~back(k, 1, lambda o, j: o["end"] >= x["end"]), x)
        return F.transform(b, lambda x, k: F.struct(own(x, k).alias("run"), back(k, 0, lambda o, j: o["m"] >= j).alias("inside")))

    return let(F.transform(F.sequence(F.lit(0), last), longest), marked)


def score(graph: DataFrame, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) from the graph (kind, value, seed, side, width, ctx) of different rows: patterns have kind, ctx, side, width and p;
    instances are the untrusted ones (kind, value) that became trusted, with how many different patterns of one word agree on them.

    Rows of kind NONE only contradict. A value that is a seed somewhere is one everywhere. Every round ends in a checkpoint.
    """
    edges = cut(graph.groupBy("kind", "value", "side", "width", "ctx").agg(F.max("seed").alias("seed")))
    total = edges.groupBy("ctx").agg(F.count_distinct("kind", "value").alias("total"))
    own = edges.where(F.col("kind") != NONE).groupBy("kind", "ctx").agg(F.count("*").alias("own"))
    against = cut(own.join(total, "ctx").select("kind", "ctx", (F.col("total") - F.col("own")).alias("x")))
    edges = edges.where(F.col("kind") != NONE)
    known = cut(edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("worth"), F.max("seed").alias("seed")))
    had, now = -1.0, 0.0
    while now > had + SETTLED:  # worth only grows, and by trust at least where an instance is newly trusted
        weighed = edges.drop("seed").join(known.where("worth > 0"), ["kind", "value"]).groupBy("kind", "side", "width", "ctx").agg(F.sum("worth").alias("s"), F.count("*").alias("support"))
        patterns = weighed.where(F.col("support") >= LEAST_SEEDS).join(against, ["kind", "ctx"]).select("kind", "side", "width", "ctx", (F.col("s") / (F.col("s") + F.col("x") + SMOOTH)).alias("p"))
        patterns = cut(patterns)
        open_ = edges.drop("seed").join(known.where("seed = 0").select("kind", "value"), ["kind", "value"])
        graded = open_.join(patterns, ["kind", "side", "width", "ctx"]).groupBy("kind", "value", "side", "width").agg(F.sum(F.ln(1 - F.least("p", F.lit(0.999)))).alias("l"), F.sum((F.col("p") >= HALF).cast("int")).alias("good"))
        graded = graded.groupBy("kind", "value", "side").agg(F.min("l").alias("l"), F.sum(F.when(F.col("width") == 1, F.col("good")).otherwise(0)).alias("good"))
        graded = cut(graded.groupBy("kind", "value").agg((1 - F.exp(F.sum("l"))).alias("g"), F.sum("good").alias("agree")).where(F.col("g") >= trust))
        known = cut(known.where("seed = 1").unionByName(known.where("seed = 0").drop("worth").join(graded.select("kind", "value", F.col("g").alias("worth")), ["kind", "value"], "left").na.fill({"worth": 0.0})))
        had, now = now, known.where("seed = 0").agg(F.coalesce(F.sum("worth"), F.lit(0.0))).first()[0]
    return patterns, graded.select("kind", "value", "agree")


def extract(docs: DataFrame, text: str = "text", trust: float = TRUST) -> DataFrame:
    """docs' columns but the text, plus base (spans by kind) and all_spans: array<struct<kind, start, end, learnt>>, sorted by kind as
    listed, then start. A null text counts as empty; equal texts get equal spans; a text without digits and @ has none; texts of any length
    are searched whole, and words of any length are patterns. An empty table stays empty; input columns named base or all_spans are replaced; column
    names that begin with __ are taken.

    What is kept of the corpus between rounds is one row per span or identifier-like token and pattern, never texts.
    """
    docs = docs.drop("base", "all_spans")
    t = F.coalesce(F.col(text), F.lit(""))
    found = base_spans(t)
    tokens = F.when(F.rlike(t, F.lit("[0-9@]")), matches(t, TOKEN)).otherwise(F.array().cast(SPAN))
    narrow = docs.withColumn("__row", F.struct(F.xxhash64(t).alias("h"), F.length(t).alias("n"))).withColumn("__base", F.struct(*(found[k].alias(k) for k in KINDS))).withColumn("__tokens", tokens).drop(text)
    rows = cut(narrow)
    told = lambda side: lambda h, i: F.struct(F.lit(side).alias("side"), (i + 1).cast("int").alias("width"), h.alias("ctx"))
    beside = F.concat(F.transform("left", told(0)), F.transform("right", told(1)))
    edges = lambda df, seed: df.select("kind", "value", F.lit(seed).alias("seed"), F.explode(beside).alias("c")).select("kind", "value", "seed", "c.side", "c.width", "c.ctx")
    seeds = reduce(DataFrame.union, (rows.select(F.lit(k).alias("kind"), F.explode(f"__base.{k}").alias("s")).select("kind", "s.value", "s.left", "s.right") for k in KINDS))
    every = F.concat(*(F.transform(f"__base.{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS))
    tok = rows.where(F.size("__tokens") > 0).withColumn("__every", every).withColumn("__free", F.filter("__tokens", lambda s: ~F.exists("__every", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))))
    tok = tok.where(F.size("__free") > 0)
    # The token's edges without punctuation; the rest must have the shape of a kind. Runs of tokens have one.
    one = tok.select("__row", F.explode(F.arrays_zip(F.col("__free").alias("s"), runs(F.col("__free")).alias("i"))).alias("z")).select("__row", "z.s", "z.i")
    lead, core = bare(F.col("s.value"))
    shape = F.expr("CASE " + " ".join(f"WHEN value RLIKE r'{p}' THEN '{k}'" for k, p in SHAPES.items()) + f" ELSE '{NONE}' END")
    # A token of a run is no instance of its own and contradicts nothing.
    single = one.where(~F.col("i.inside")).select("__row", (F.col("s.start") + lead).alias("start"), core.alias("value"), "s.left", "s.right").withColumn("kind", shape).withColumn("end", F.col("start") + F.length("value"))
    several = one.where(F.col("i.run").isNotNull()).select("__row", "i.run.start", "i.run.value", "i.run.left", "i.run.right", "i.run.kind", "i.run.end")
    others = cut(single.unionByName(several).distinct())
    patterns, trusted = score(edges(seeds, 1).unionByName(edges(others, 0)), trust)
    shaped = others.where(F.col("kind") != NONE).join(trusted, ["kind", "value"])
    place = ["__row", "kind", "start", "end"]
    alone = shaped.where("agree >= 2").select(*place)
    near = shaped.where("agree < 2").select(*place, F.explode(beside).alias("c")).select(*place, "c.side", "c.width", "c.ctx").join(patterns.where(F.col("p") >= HALF), ["kind", "side", "width", "ctx"]).select(*place).distinct()
    # Of spans in one another the longest stays.
    inside = lambda a: F.filter(a, lambda s: ~F.exists(a, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    learnt = alone.union(near).groupBy("__row").agg(F.collect_set(F.struct("kind", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("__learnt")).withColumn("__learnt", let(F.col("__learnt"), inside))  # one text's spans
    learnt = cut(learnt)  # so that both sides of the join are plain exchanges, whose skewed partitions Spark can split
    out = rows.drop("__tokens").join(learnt, "__row", "left")
    order = lambda k: F.array_position(F.array(*(F.lit(x) for x in KINDS)), k)
    span = lambda kind, s, learnt: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(learnt).alias("learnt"))
    base_of = lambda k: F.transform(f"__base.{k}", lambda s: span(F.lit(k), s, False))
    mine = F.concat(*(base_of(k) for k in KINDS))
    more = F.transform(F.coalesce("__learnt", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: span(s["kind"], s, True))
    keyed = F.array_sort(F.transform(F.concat(mine, more), lambda s: F.struct(order(s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["learnt"].alias("learnt"))))
    out = out.withColumn("all_spans", F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["learnt"].alias("learnt"))))
    base = F.struct(*(F.transform(f"__base.{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS))
    return out.withColumn("base", base).drop("__row", "__learnt", "__base")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(F.filter("all_spans", lambda s: ~s["learnt"])), 256).alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), F.size("all_spans").cast("long").alias("n_spans"))


def brute(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by the contract's own expressions; for tests."""
    import re

    text, out = text or "", []
    sure = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", _luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    for kind, (pattern, keep) in sure.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if keep(m[0])]
    return out


def brute_score(rows: list[tuple], trust: float = TRUST) -> tuple[dict, dict]:
    """score() over rows (kind, value, seed, side, width, ctx) in plain loops; for tests: p by (kind, side, width, ctx), agree by (kind, value)."""
    import math
    from collections import defaultdict

    seed, at, total = defaultdict(int), defaultdict(set), defaultdict(set)
    for kind, value, is_seed, side, width, ctx in rows:
        seed[kind, value] |= is_seed
        at[kind, side, width, ctx].add(value)
        total[ctx].add((kind, value))
    worth = {k: float(v) for k, v in seed.items() if k[0] != NONE}
    while True:
        p = {}
        for (kind, side, width, ctx), values in at.items():
            good = [worth[kind, v] for v in values if kind != NONE and worth[kind, v] > 0]
            if len(good) >= LEAST_SEEDS:
                p[kind, side, width, ctx] = sum(good) / (sum(good) + len(total[ctx]) - len(values) + SMOOTH)
        agree, new = {}, dict(worth)
        for kind, value in worth:
            if seed[kind, value]:
                continue
            mine = [(k[1], k[2], x) for k, x in p.items() if k[0] == kind and value in at[k]]
            left = 1.0
            for side in (0, 1):
                left *= min((math.prod(1 - min(x, 0.999) for s, w, x in mine if (s, w) == (side, width)) for width in range(1, WIDTH + 1)), default=1.0)
            new[kind, value] = 1 - left if 1 - left >= trust else 0.0
            if new[kind, value]:
                agree[kind, value] = sum(w == 1 and x >= HALF for _, w, x in mine)
        if sum(new.values()) <= sum(worth.values()) + SETTLED:
            return p, agree
        worth = new


def _luhn(v: str) -> bool:
    d = [int(c) for c in v if c.isdigit()]
    odd = [x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))]
    return 16 <= len(d) <= 19 and sum(odd) % 10 == 0
