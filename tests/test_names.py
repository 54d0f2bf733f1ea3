"""Unique names against a loop over rows, and the filters of an import."""

import random

import pytest

from gridspark.operators import names

POOL = ["x", "x_2", "x_3", "x_2_2", "x_5", "x_2_3", "y", "x_2_2_2", "x_1", "x_02", "a_b"]


def loop(rows, existing):
    held, out = set(existing), []
    for base in rows:
        name, i = base, 2
        while name in held:
            name, i = f"{base}_{i}", i + 1
        held.add(name)
        out.append(name)
    return out


def spread(spark, rows, existing):
    df = spark.createDataFrame([(b, k) for k, b in enumerate(rows)], "base string, k long")
    got = names.unique_names(df, "base", "k", spark.createDataFrame([(e,) for e in existing], "name string")).collect()
    return [r["name"] for r in sorted(got, key=lambda r: r["k"])]


def test_given_numbers_and_existing_names(spark):
    assert spread(spark, ["x", "x", "x_2"], ["x_3"]) == ["x", "x_2", "x_2_2"] == loop(["x", "x", "x_2"], ["x_3"])
    assert spread(spark, ["x", "x_2", "x"], ["x_3"]) == ["x", "x_2", "x_4"]


@pytest.mark.parametrize("seed", range(4))
def test_like_the_loop_over_rows(spark, seed):
    rnd = random.Random(seed)
    rows = [rnd.choice(POOL[: 4 + 2 * seed]) for _ in range(120)]
    existing = rnd.sample([*POOL, "x_4", "x_17", "y_2", "x_2_9"], 5) + ["unused"]
    assert spread(spark, rows, existing) == loop(rows, existing)


def test_the_walk_like_the_loop():
    rnd = random.Random(1)
    for _ in range(2000):
        rows = [rnd.choice(POOL) for _ in range(rnd.randint(1, 12))]
        m = {b: rows.index(b) for b in rows}
        claims = {}
        for b, i in m.items():
            p, _, k = b.rpartition("_")
            if p in m and k.isdigit() and k[0] != "0" and int(k) > 1:
                claims.setdefault(p, []).append((rows[:i].count(p), int(k), b))
        blocked, count, want = names.taken({}, claims), {}, []
        for b in rows:
            free = (n for n in range(1, 99) if n not in blocked.get(b, ()))
            count[b] = count.get(b, 0) + 1
            n = [next(free) for _ in range(count[b])][-1]
            want.append(b if n == 1 else f"{b}_{n}")
        assert want == loop(rows, [])


def test_import_filters(spark):
    cols = "k long, name string, north string, south string, east string, west string, rotation string"
    rows = [(1, " a ", "2", "1", "3", "0", None), (2, "", "2", "1", "3", "0", ""), (3, "a", "x", "1", "3", "0", ""), (4, "a", "1", "1", "3", "0", ""), (5, "a", "2", "1", "3", "0", "15"), (6, "b", "2", "1", None, "0", ""), (7, "b", "2", "1", "3", "0", "left"), (8, None, "2", "1", "3", "0", "")]
    got = names.import_regions(spark.createDataFrame(rows, cols), "k", spark.createDataFrame([("a",)], "name string")).collect()
    assert sorted((r["k"], r["name"], r["settings"]) for r in got) == [(1, "a_2", "{}"), (5, "a_3", '{"rotation": 15.0}')]


def test_ranges_count_the_bounds_below_a_key(spark):
    bounds = list(range(0, 330, 3))
    rows = spark.createDataFrame([(k,) for k in range(-5, 340)] + [(None,)], "k long")
    got = {r["k"]: r["__range"] for r in names.in_ranges(rows, "k", bounds).collect()}
    assert got == {k: 0 if k is None else sum(k > b for b in bounds) for k in got}


def test_rows_are_exchanged_and_ranked_once(spark):
    """Frequent bases in many ranges, each read once for its rank; keys that repeat and nulls stay apart."""
    rows = [(["x", "y", "x_2", None][k % 4], None if k % 50 == 7 else k) for k in range(3000)]
    df = spark.createDataFrame(rows, "base string, k long")
    out = names.unique_names(df, "base", "k")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 1
    got = [r["name"] for r in out.collect()]
    assert got.count(None) == sum(b is None for b, _ in rows) and len(set(got)) == 1 + sum(b is not None for b, _ in rows)
