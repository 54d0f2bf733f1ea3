"""Conversation structure repair: the cheapest edits that give turns their order, by minima over scalar big integers.

A conversation's turns pass a small automaton of roles. A path through the graph of (turn, inserted turns, state) is one audit, a letter an edit; its weight
is one integer: the high digits are its cost, the low ones the letters by position, as wide as the longest audit, with zeros where a shorter one has ended. The integer minimum over all paths is
therefore the cheapest audit, and of those the least in ASCII. Long conversations are dealt in blocks of BLOCK turns, each a table of weights from state to state; the blocks of a conversation
are chained by the same minimum, where the rank of the audit so far is a digit between cost and letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import CRC_TABLE_SQL, crc_sql, numbered, table

#: Turns that one table of weights spans.
BLOCK = 1024
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a letter, and the letters' digits in ASCII order; 0 is the padding.
BITS = 3
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {v: k for k, v in DIGITS.items()}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Roles have the form (s?(ua)+)?.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
STATES = 4
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def most_inserts(self, turns: int) -> int:
        """No cheapest repair inserts more. An insertion beyond two deletions never pays: it and a neighbour, or all that is left, can go instead."""
        return 0 if self.insert > 2 * self.delete else turns * self.delete // max(1, self.insert)


def weights(turns: list[tuple[str, bool, bool]], start: int, costs: Costs, inserts: int) -> dict[tuple[int, int], int]:
    """Least weights of edits of turns (initial, must go, truncated) from a state to each (state, insertions); audits are len(turns) + insertions letters long.

    A weight is cost << BITS * width, plus each letter's digit at its position, width being len(turns) + inserts.
    """
    width = len(turns) + inserts
    unit = 1 << BITS * width
    nodes = {(start, 0): 0}

    def relax(into: dict, node: tuple[int, int], w: int) -> None:
        if node not in into or w < into[node]:
            into[node] = w

    def inserted(nodes: dict, i: int) -> dict:
        for k in range(inserts):
            for s in range(STATES):
                if (s, k) in nodes:
                    for c in ROLES:
                        if (s, c) in STEP:
                            relax(nodes, (STEP[s, c], k + 1), nodes[s, k] + costs.insert * unit + (DIGITS["I"] << BITS * (width - 1 - i - k)))
        return nodes

    for i, (initial, gone, truncated) in enumerate(turns):
        after: dict[tuple[int, int], int] = {}
        for (s, k), w in inserted(nodes, i).items():
            at = BITS * (width - 1 - i - k)
            relax(after, (s, k), w + costs.delete * unit + (DIGITS["D"] << at))
            if not gone:
                stays = w + (costs.truncated * unit if truncated else 0)
                if (s, initial) in STEP:
                    relax(after, (STEP[s, initial], k), stays + (DIGITS["K"] << at))
                for c in ROLES:
                    if (s, c) in STEP:
                        relax(after, (STEP[s, c], k), stays + costs.rerole * unit + (DIGITS["R"] << at))
        nodes = after
    return inserted(nodes, len(turns))


def read_weight(w: int, width: int, letters: int) -> tuple[int, str]:
    """The cost and the audit of a weight."""
    cost, low = w >> BITS * width, w & ((1 << BITS * width) - 1)
    return cost, "".join(LETTERS[(low >> BITS * (width - 1 - p)) & ((1 << BITS) - 1)] for p in range(letters))


def chain(blocks: Iterator[list[dict]]) -> tuple[int, str]:
    """The least cost and audit over a conversation's blocks; each is a list of (start, state, inserts, cost, audit)."""
    nodes: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}  # cost, and rank of the audit so far among those of its length
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    for entries in blocks:
        long = max(len(e["audit"]) for e in entries)
        best: dict[tuple[int, int], tuple[int, tuple[int, int], str]] = {}
        for (s, k), (cost, rank) in nodes.items():
            for e in entries:
                if e["start"] == s:
                    digits = 0
                    for c in e["audit"]:
                        digits = digits << BITS | DIGITS[c]
                    w = (((cost + e["cost"]) * (len(nodes) + 1) + rank) << BITS * long) + (digits << BITS * (long - len(e["audit"])))
                    node = (e["state"], k + e["inserts"])
                    if node not in best or w < best[node][0]:
                        best[node] = (w, (s, k), e["audit"], cost + e["cost"], (rank, digits))
        back.append({node: (b[1], b[2]) for node, b in best.items()})
        order = {node: r for r, node in enumerate(sorted(best, key=lambda x: (best[x][4][0], best[x][2])))}
        nodes = {node: (b[3], order[node]) for node, b in best.items()}
    ends = [(cost, node) for node, (cost, _) in nodes.items() if node[0] in ACCEPTED]
    least = min(c for c, _ in ends)

    def audit(node: tuple[int, int]) -> str:
        parts = []
        for step in reversed(back):
            node, letters = step[node]
            parts.append(letters)
        return "".join(reversed(parts))

    return least, min(audit(node) for c, node in ends if c == least)


def replay(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of turns; an audit's letters fix each role."""
    state = 0
    for c in audit:
        if c == "I":
            role, text = None, ""
        else:
            role, text = next(turns)
            if c == "D":
                continue
        if c != "K":
            role = ROLES["a" if state == 2 else "u"]
        state = STEP[state, role[:1]]
        yield role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the CRC-32 of `conv_id:turn` decides; nulls are read as one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), code.alias("__d")).where("__d <> 0")
    d = F.col("__d")
    text = F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(d == 3, 2).otherwise(1))).alias("__copy"))
    return rows.drop("__copy")


def digest_of(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


#: Initials that are none of these are a role of another kind.
def initial(role: Column) -> Column:
    c = F.substring(role, 1, 1)
    return F.when(c.isin("s", "u", "a"), c).otherwise("x")


TABLES = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
    ("entries", pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("inserts", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])
LEGAL = {"su", "ua", "au"}


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) without texts, plus i (place in the conversation), n, initial and the first fault: blank, duplicate, truncated or null.

    Turns go by turn (nulls first), then role, then a 128-bit hash of the text; equal turns are interchangeable. A text is equal to one before if that hash is.
    """
    bare = F.rtrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    rows = turns.select("conv_id", "turn", "role", digest_of("text").alias("h"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open"))
    rows = numbered(rows, ["conv_id"], ["turn", "role", "h"])
    first = rows.groupBy("conv_id", "role", "h").agg(F.min("i").alias("__i")).select(F.col("conv_id").alias("__c"), "__i")
    seen = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("i") == F.col("__i")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("__i").isNull(), "duplicate").when(F.col("open"), "truncated")
    return seen.select("conv_id", "turn", "i", "n", initial(F.col("role")).alias("initial"), fault.alias("fault"))


def solve(told: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """A row for each conversation of faults(): conv_id, blank, duplicate, truncated, illegal, cost, audit."""

    def tables(it):
        rows = (r for batch in it for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
        out = []
        for (conv, b), group in groupby(rows, key=lambda r: (r[0], r[1] // block)):
            group = list(group)  # at most a block
            kinds = [r[4] for r in group]
            turns = [(r[3], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(group, kinds, strict=True)]
            most = costs.most_inserts(group[0][2])
            width, entries = len(turns) + most, []
            for start in range(STATES) if b else (0,):
                for (state, k), w in weights(turns, start, costs, most).items():
                    cost, audit = read_weight(w, width, len(turns) + k)
                    entries.append({"start": start, "state": state, "inserts": k, "cost": cost, "audit": audit})
            ill = sum(x[0] + y[0] not in LEGAL for x, y in zip(turns, turns[1:], strict=False))
            out.append({"conv_id": conv, "block": b, **{f: kinds.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": ill, "first": turns[0][0], "last": turns[-1][0], "entries": entries})
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, TABLES)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, TABLES)

    counts = ("blank", "duplicate", "truncated", "illegal")
    answer = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in counts), ("cost", pa.int64()), ("audit", pa.string())])

    def chained(it):
        rows = (r for batch in it for r in batch.to_pylist())
        out = []
        for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
            total, before = dict.fromkeys(counts, 0), [""]

            def entries(group=group, total=total, before=before):
                for r in group:
                    for c in counts:
                        total[c] += r[c]
                    total["illegal"] += bool(before[0]) and before[0] + r["first"] not in LEGAL
                    before[0] = r["last"]
                    yield r["entries"]

            cost, audit = chain(entries())
            out.append({"conv_id": conv, **total, "cost": cost, "audit": audit})
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, answer)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, answer)

    dealt = told.select("conv_id", "i", "n", "initial", "fault").repartition("conv_id", F.floor(F.col("i") / block)).sortWithinPartitions("conv_id", "i")
    entry = "array<struct<start:int,state:int,inserts:int,cost:bigint,audit:string>>"
    parts = dealt.mapInArrow(tables, f"conv_id bigint, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, entries {entry}")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(chained, "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def repaired(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text; those of a conversation stand together in a partition, in order.

    The rows of one conversation pass through one task, as a stream behind its audit; none are held.
    """
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest_of("text").alias("h"), "text", F.lit(None).cast("string").alias("audit"))
    heads = solved.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("string").alias("text"), "audit")
    fields = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def stream(it):
        rows = (r for batch in it for r in zip(*(batch.column(k).to_pylist() for k in (0, 3, 5, 6)), strict=True))
        out, size = [], 0
        for conv, group in groupby(rows, key=lambda r: r[0]):
            audit = next(group)[3]
            for place, (role, text) in enumerate(replay(audit, ((r[1], r[2]) for r in group))):
                out.append((conv, place, role, text))
                size += len(text)
                if len(out) == 1000 or size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    dealt = rows.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h")
    return dealt.mapInArrow(stream, "conv_id bigint, place bigint, role string, text string")


def repaired_digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired(), read in the order in which its rows stand: `role:text`, joined by newlines."""
    fields = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def digests(it):
        rows = (r for batch in it for r in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True))
        out = []
        for conv, group in groupby(rows, key=lambda r: r[0]):
            h = sha256()
            for k, (_, role, text) in enumerate(group):
                h.update(("\n" if k else "").encode() + f"{role}:{text}".encode())
            out.append((conv, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    return fixed.mapInArrow(digests, "conv_id bigint, repaired_sha256 string")


def report(conversations: DataFrame, turns: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """For each conv_id of conversations, what turns (the same columns, after damage) needs: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation of its own; null turns come first and count for no gap; a null or empty text is blank; roles of other kinds than s, u, a can be reroled or
    deleted only. Rows equal in all columns are duplicates of the first. Texts of any length are judged whole. A conversation that lost all turns has zeros, an empty audit
    and the hash of an empty string; an empty table gives no rows. Other columns are not read.
    """
    told = faults(turns)
    solved = solve(told, costs, block)
    spans = told.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"), F.countDistinct("turn").alias("turns"))
    digests = repaired_digests(repaired(turns, solved))
    out = conversations.select("conv_id").distinct()
    for k, found in enumerate((spans, solved, digests)):
        found = found.withColumnRenamed("conv_id", f"__c{k}")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col(f"__c{k}")), "left").drop(f"__c{k}")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    counts = [zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", zero(F.col("span") - F.col("turns")).alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return report(rows, damaged(rows))


_SP = r"[\x20\x09-\x0D]"
#: Insertions are left out: at these costs none is in a cheapest repair.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
        FROM conversations v JOIN ids ON v.conv_id IS NOT DISTINCT FROM ids.conv_id, crc_t),
dm AS (SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, k FROM raw, range(2) r(k) WHERE d <> 0 AND (k = 0 OR d = 3)),
nr AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text), k) - 1 AS i FROM dm),
ft AS (SELECT c, turn, i, role, text, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?]{_SP}*$') THEN 'truncated' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS prev FROM nr),
ed AS (SELECT c, i, s, s2, let, cost + CASE WHEN fault = 'truncated' AND let <> 'D' THEN 5 ELSE 0 END AS cost, o FROM ft, (VALUES
         ('D', 0, 0, 2, '-'), ('D', 1, 1, 2, '-'), ('D', 2, 2, 2, '-'), ('D', 3, 3, 2, '-'), ('K', 0, 1, 0, 's'), ('K', 0, 2, 0, 'u'), ('K', 1, 2, 0, 'u'), ('K', 2, 3, 0, 'a'), ('K', 3, 2, 0, 'u'),
         ('R', 0, 2, 1, 'u'), ('R', 1, 2, 1, 'u'), ('R', 2, 3, 1, 'a'), ('R', 3, 2, 1, 'u')) e(let, s, s2, cost, o)
       WHERE (let = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate')) AND (let <> 'K' OR ini = o)),
dp(c, i, s, v) AS (SELECT c, 0::BIGINT, 0, {{'cost': 0, 'audit': '', 'outs': ''}} FROM ids
  UNION ALL SELECT dp.c, dp.i + 1, ed.s2, min({{'cost': dp.v.cost + ed.cost, 'audit': dp.v.audit || ed.let, 'outs': dp.v.outs || ed.o}}) FROM dp JOIN ed ON dp.c = ed.c AND dp.i = ed.i AND dp.s = ed.s GROUP BY dp.c, dp.i, ed.s2),
cnt AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
          count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM ft GROUP BY c),
sol AS (SELECT dp.c, min(v) AS v FROM dp JOIN cnt ON dp.c = cnt.c AND dp.i = cnt.n WHERE dp.s IN (0, 3) GROUP BY dp.c),
fx AS (SELECT c, string_agg(CASE substr(v.audit, i + 1, 1) WHEN 'K' THEN role ELSE CASE substr(v.outs, i + 1, 1) WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || text, chr(10) ORDER BY i) AS t
       FROM ft JOIN sol USING (c) WHERE substr(v.audit, i + 1, 1) <> 'D' GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids LEFT JOIN cnt USING (c) LEFT JOIN sol USING (c) LEFT JOIN fx USING (c)
"""


def brute(turns: list[tuple[str, bool, bool]], costs: Costs, most: int) -> tuple[int, str]:
    """Every audit with up to `most` insertions, for tests: the least (cost, audit)."""
    best = [(costs.delete * len(turns), "D" * len(turns))]

    def go(i: int, k: int, s: int, cost: int, audit: str) -> None:
        if cost > best[0][0]:
            return
        if i == len(turns) and s in ACCEPTED:
            best[0] = min(best[0], (cost, audit))
        if k < most:
            for c in ROLES:
                if (s, c) in STEP:
                    go(i, k + 1, STEP[s, c], cost + costs.insert, audit + "I")
        if i < len(turns):
            ini, gone, truncated = turns[i]
            go(i + 1, k, s, cost + costs.delete, audit + "D")
            if not gone:
                more = costs.truncated if truncated else 0
                if (s, ini) in STEP:
                    go(i + 1, k, STEP[s, ini], cost + more, audit + "K")
                for c in ROLES:
                    if (s, c) in STEP:
                        go(i + 1, k, STEP[s, c], cost + costs.rerole + more, audit + "R")

    go(0, 0, 0, 0, "")
    return best[0]
