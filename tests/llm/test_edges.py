"""Nulls, empty and long texts, repeats, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from folioweave.llm import language, leaks, mixing, neighbours, overlap, pairs, scans, spam, splitting, truncation
from folioweave.llm.queries import VOCABULARY

LONG = "The cache keeps every page that the reader asked for in the last hour. " * 900
TEXTS = [None, "", "   ", "\n", "x", "Hello there, this is a whole sentence. ", LONG, "Ein ganzer Satz steht hier auf Deutsch. ", "这是一个完整的中文句子。", "a" * 5000, "The end of this text is cut off in the mid"]


def docs(spark, texts=TEXTS, key="unique_id", text="page_content"):
    rows = [(str(i), t, "s1" if i % 2 else None, "child" if i == 9 else "parent", "0") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, f"{key} string, {text} string, source string, chunk_level string, parent_id string")
    # names that the operators use inside
    for c in ("k", "t", "v", "h", "id", "side", "f", "e", "key", "lang", "finish", "cut", "l", "run"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def test_splitting(spark):
    d = docs(spark)
    p = splitting.split_oversized(d.union(d), limit=1500).toPandas()
    assert set(p.unique_id) == {"6", "9"} and (p.piece.str.len() <= 1500).all()
    k = {r.unique_id: r.kind for r in splitting.oversized_kinds(d.union(d)).collect()}
    assert k == {"6": "natural", "9": "forced"}
    assert splitting.split_oversized(d.limit(0)).count() == 0


def test_truncation(spark):
    d = docs(spark)
    v = {r.unique_id: r.cut for r in truncation.truncated(d).collect()}
    assert len(v) == len(TEXTS) and v["10"] and not v["5"] and not v["0"] and not v["6"]
    rates = truncation.truncation_rates(truncation.truncated(d)).collect()
    assert sum(r.records for r in rates) == len(TEXTS)
    assert truncation.truncated(d.limit(0)).count() == 0


def test_scans(spark):
    d = docs(spark)
    assert scans.scan_noise(d).count() == 0
    assert scans.scan_noise(d.limit(0)).count() == 0


def test_spam(spark):
    d = docs(spark, key="doc_id", text="text")
    got = {r.doc_id: r.non_prose for r in spam.page_shares(d.union(d), "doc_id", "text").collect()}
    assert "0" not in got and "1" not in got and got["6"] < 0.5
    assert spam.stuffed_pages(d.limit(0), "doc_id", "text").count() == 0


def test_language(spark):
    d = docs(spark)
    model = language.Model.fit([LONG[:300], "Ein ganzer Satz steht hier auf Deutsch.", "这是一个完整的中文句子。"], ["en", "de", "zh"])
    got = language.document_languages(d, model, "unique_id", "page_content").toPandas().set_index("unique_id").lang
    assert got["8"] == "zh" and got["7"] == "de" and got["6"] == "en" and "1" not in got.index
    seg = language.segment_languages(d, model, "unique_id", "page_content").toPandas()
    assert set(seg.lang) == {"en", "de", "zh"} and (seg.end > seg.start).all()
    assert language.document_languages(d.limit(0), model, "unique_id", "page_content").count() == 0
    empty = language.fit_model(d.limit(0).withColumn("lab", F.lit("en")), "page_content", "lab")
    assert language.document_languages(d, empty, "unique_id", "page_content").count() > 0


def test_leaks(spark):
    d = docs(spark, key="doc_id", text="text")
    ev = spark.createDataFrame([("s1", LONG[:200]), ("s1", LONG[:200]), ("s2", None), ("s3", ""), (None, LONG[:200]), ("s4", "too short")], "sample_id string, gold_answer string").withColumn("i", F.lit(1))
    assert [tuple(r) for r in leaks.leaked_passages(d.union(d), ev).collect()] == [("s1", "6")]
    assert leaks.leaked_passages(d.limit(0), ev).count() == 0 and leaks.leaked_passages(d, ev.limit(0)).count() == 0
    blocks = leaks.leaked_passages(d, ev, block_chars=100)
    assert [tuple(r) for r in blocks.collect()] == [("s1", "6")]


def test_pairs(spark):
    rows = [(i, None if i % 3 else "Answer.", t, t) for i, t in enumerate(TEXTS)] + [(None, "x", "y", "z"), (99, None, None, None)]
    d = spark.createDataFrame(rows, "row_id long, instruction string, input string, output string").withColumn("k", F.lit(1))
    got = {r.row_id: r.defect for r in pairs.broken_pairs(d.union(d), language.Model.fit(["some words here"], ["en"])).collect()}
    assert got[0] == got[1] == got[99] == "empty" and got[8] == "copy" and None not in got
    assert pairs.broken_pairs(d.limit(0), language.Model.fit([], [])).count() == 0


def test_overlap(spark):
    rows = [(i, t, t, i % 2 == 0) for i, t in enumerate(TEXTS)] + [(100, LONG, LONG, False), (101, LONG, LONG, False), (102, LONG[:-300], LONG, False), (None, "a b c", "d", True)]
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean").withColumn("id", F.lit(1)).withColumn("k", F.lit(1))
    got = {(r.eval_key, r.train_key) for r in overlap.cross_split_overlaps(d.union(d)).collect()}
    assert got == {(6, 100), (6, 101), (6, 102)}
    assert overlap.cross_split_overlaps(d.limit(0)).count() == 0


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, []), (7, [1.0, 0.0, 0.0]), (8, [1.0, None]), (9, [0.9, 0.1]), (9, [0.9, 0.1]), (10, [float("nan"), 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit(1))
    got = neighbours.most_similar(d, k=5).toPandas()
    assert set(got.vec_id) == {1, 2, 3, 9} and (got.groupby("vec_id").size() == 3).all()
    assert list(got[got.vec_id == 1].sort_values("rank").neighbour) == [2, 9, 3]
    assert neighbours.most_similar(d.limit(0)).count() == 0
    same = spark.range(1, 41).select(F.col("id").alias("vec_id"), F.array(F.lit(0.6), F.lit(0.8)).cast("array<float>").alias("embedding"))
    n = neighbours.most_similar(same).toPandas()
    assert sorted(n[n.vec_id == 30].neighbour) == [1, 2, 3, 4, 5] and sorted(n[n.vec_id == 3].neighbour) == [1, 2, 4, 5, 6]
    assert neighbours.similar_pairs(neighbours.most_similar(same)).count() == 5 * 34 + 15


def test_mixing(spark, tmp_path):
    if not __import__("os").path.exists(VOCABULARY):
        pytest.skip("no vocabulary files here")
    d = docs(spark, key="doc_id", text="text").withColumn("source", F.lit("a")).withColumn("tokens", F.lit(1)).withColumn("copy", F.lit(1))
    tg = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1), ("c", None, 1), ("d", 0.0, 1)], "source string, target_share double, max_repeats int")
    m, s = mixing.mix(d, tg, VOCABULARY)
    assert m.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert {r.source: r.share for r in s.collect()} == {"a": 1.0, "b": 0.0}
    m, s = mixing.mix(d.limit(0), tg, VOCABULARY)
    assert m.count() == 0 and s.count() == 2
    m, _ = mixing.mix(d, tg.limit(0), VOCABULARY)
    assert m.count() == 0
