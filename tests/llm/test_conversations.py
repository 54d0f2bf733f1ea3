"""Conversation repair: weights against all audits, blocks against one table, edges, and the query against its SQL."""

import random
from hashlib import sha256

import pytest

from gridspark.llm import conversations as cv
from tests import oracle

DDL = "conv_id long, turn long, role string, text string, i long, h string"


def solved(turns, costs, block):
    most = costs.most_inserts(len(turns))

    def blocks():
        for b in range(0, len(turns), block):
            part, out = turns[b : b + block], []
            for start in range(cv.STATES) if b else (0,):
                for (state, k), w in cv.weights(part, start, costs, most).items():
                    cost, audit = cv.read_weight(w, len(part) + most, len(part) + k)
                    out.append({"start": start, "state": state, "inserts": k, "cost": cost, "audit": audit})
            yield out

    return cv.chain(blocks())


@pytest.mark.parametrize("costs", [cv.Costs(), cv.Costs(rerole=3), cv.Costs(insert=2), cv.Costs(insert=1, delete=1)])
def test_least_audit_of_all(costs):
    rnd = random.Random(7)
    for _ in range(150):
        turns = [(rnd.choice("suuaax"), rnd.random() < 0.15, rnd.random() < 0.2) for _ in range(rnd.randint(1, 5))]
        want = cv.brute(turns, costs, max(2, costs.most_inserts(len(turns))))
        for block in (2, 3, 100):
            assert solved(turns, costs, block) == want


def test_cheap_insertions_are_made():
    assert solved([("u", False, False)], cv.Costs(insert=1), 10) == (1, "KI")


def test_blocks_do_not_change_long_audits():
    rnd = random.Random(1)
    turns = [(rnd.choice("sua"), rnd.random() < 0.1, rnd.random() < 0.1) for _ in range(700)]
    assert solved(turns, cv.Costs(), 64) == solved(turns, cv.Costs(), 700)


def digest(text):
    return sha256(text.encode()).hexdigest()


def test_edges(spark):
    rows = [
        (1, 0, "user", "Hi.", 0, ""), (1, 1, "assistant", "Yes.", 0, ""),
        (2, 0, "user", "Hi.", 0, ""), (2, 1, "user", "Hi.", 0, ""), (2, 4, "assistant", "Cut off", 0, ""),
        (3, None, None, None, 0, ""), (3, 2, "", "Odd.", 0, ""), (3, 3, "tool", "Odd!", 0, ""),
        (None, 0, "assistant", "Long. " * 30_000, 0, ""), (None, 1, "user", " \t\n", 0, ""),
        (5, None, "system", "Rules.", 0, ""), (5, None, "system", "Rules.", 0, ""),
    ]
    docs = spark.createDataFrame(rows, DDL)
    for block in (1, 2, 1024):
        got = {r.conv_id: r for r in cv.report(docs, docs, block=block).collect()}
        assert set(got) == {1, 2, 3, None, 5}
        assert tuple(got[1])[1:] == (0, 0, 0, 0, 0, 0, "KK", digest("user:Hi.\nassistant:Yes."))
        assert tuple(got[2])[1:] == (2, 0, 1, 1, 1, 6, "DDD", digest(""))
        assert tuple(got[3])[1:] == (0, 1, 0, 0, 2, 4, "DRR", digest("user:Odd.\nassistant:Odd!"))
        assert tuple(got[None])[1:] == (0, 1, 0, 0, 0, 4, "DD", digest(""))
        assert tuple(got[5])[1:] == (0, 0, 1, 0, 1, 4, "DD", digest(""))
    gone = cv.report(docs, docs.where("conv_id = 1")).where("conv_id = 2").collect()[0]
    assert tuple(gone)[1:] == (0, 0, 0, 0, 0, 0, "", digest(""))
    assert cv.report(docs.limit(0), docs.limit(0)).collect() == []


def test_repaired_turns(spark):
    docs = spark.createDataFrame([(1, 0, "user", "A.", 0, ""), (1, 1, "user", "B.", 0, ""), (1, 2, "user", "", 0, "")], DDL)
    fixed = cv.repaired(docs, cv.solve(cv.faults(docs))).collect()
    assert [(r.place, r.role, r.text) for r in fixed] == [(0, "user", "A."), (1, "assistant", "B.")]


def test_one_conversation_with_most_rows(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", 0, "") for k in range(3000)] + [(2, 0, "user", "x", 0, "")]
    docs = spark.createDataFrame(rows, DDL)
    got = {r.conv_id: r for r in cv.report(docs, docs, block=256).collect()}
    assert got[1].audit == "K" * 3000 and got[1].cost == 0
    assert got[1].repaired_sha256 == digest("\n".join(f"{r[2]}:{r[3]}" for r in rows[:3000]))


def test_query_equals_sql(spark, sf):
    oracle.same(cv.op11(spark, sf), cv.SQL, oracle.connect(sf))
