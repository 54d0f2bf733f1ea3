import corpus_pipeline as cp
from gridspark.llm import decontam, langid, ngram_join
from pyspark.sql import functions as F
from tests.llm.test_text_operators import brute_join


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(cp.STAGES):
            assert kept.columns == docs.columns, name
        assert kept.count() > 0
        old = before.collect()
        new = kept.collect()
        if name == "language_id":
            m = langid.fit(before)
            want = {r["doc_id"] for r in old if (x := m.label(r["text"]))[0] != "und" and x[1] >= cp.MIN_LANGUAGE_SHARE}
            assert {r["doc_id"] for r in new} == want
        elif name == "near_duplicates":
            groups = brute_join([(r["doc_id"], r["text"]) for r in old])
            assert sorted(r["doc_id"] for r in new) == sorted({int(c) for _, _, c in groups})
        elif name == "decontamination":
            items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            tools = decontam.searchers(items)
            assert {r["doc_id"] for r in new} == {r["doc_id"] for r in old if not decontam.scan(decontam.words(r["text"].encode()), tools)[0]}
        elif name == "mixing":
            assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
        else:
            assert len(new) == len(old) and len({(r["shard"], r["slot"]) for r in new}) == len(new)


def test_run_and_edges(spark, sf):
    assert cp.run(spark, sf).count() > 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x y z", None, None, 5), (3, "x y z", None, None, 5), (None, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        stage(spark, odd, sf).collect()
        stage(spark, odd.where("false"), sf).collect()
    assert cp.near_duplicates(spark, odd, sf).where("doc_id = 3").count() == 1
    left = ngram_join.without(odd, spark.createDataFrame([(3, ngram_join.set_hash(ngram_join.Shingler()(b"x y z")))], "doc_id long, __class long"))
    assert left.where("doc_id = 3").count() == 0 and left.count() == 3
    assert odd.select(F.count("*")).first()[0] == 5


def test_one_row_of_a_component_with_repeated_ids(spark, sf):
    base = [f"w{i}" for i in range(200)]
    near = " ".join([*base[:-1], "other"])  # links with the text, but is another class
    text = " ".join(base)
    far = " ".join(f"v{i}" for i in range(50))  # another component under the same doc_id
    rows = [(1, text), (1, text.upper()), (1, text.replace(" ", "  ")), (1, text), (1, near), (2, near), (1, far), (1, far.upper()), (1, ""), (1, ""), (None, text)]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, sf).collect()]
    assert len([t for i, t in got if i == 1 and t.lower().startswith("w")]) == 1
    assert len([t for i, t in got if i == 1 and t.lower().startswith("v")]) == 1
    assert got.count((1, "")) == 2 and (None, text) in got and len(got) == 5
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs.orderBy(F.desc("text")), sf).collect()), key=str)


def test_stages_with_long_texts_and_clashing_columns(spark, sf):
    long = " ".join(f"word{i} und der" for i in range(30_000))
    rows = [(1, long, "de", "a", len(long)), (2, "the cat and the dog sit here " * 3, "en", "b", 87), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(k) for k, c in enumerate(("n", "h", "key", "count", "root", "class", "component_id", "size", "target", "shard", "slot", "kind", "items"))})
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert set(out.columns) == set(docs.columns), name
        assert any(r["doc_id"] == 1 for r in got), name
        if name != "mixing":
            assert next(r["text"] for r in got if r["doc_id"] == 1) == long
