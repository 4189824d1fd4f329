import json

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import search
from folioweave.sources import index, io
from folioweave.streaming import jobs


def test_tolerant_json(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"instruction":"a","input":"b","output":"c"}\nnot json\n\n{"input":"x"}\n')
    good, bad = io.read_tolerant(spark, str(p), io.ALPACA, ("instruction",))
    assert good.count() == 1 and bad.count() == 2


def test_json_array_or_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "b.jsonl").write_text('{"a": 3}\n')
    assert io.read_json_any(spark, str(tmp_path / "a.json")).count() == 2 and io.read_json_any(spark, str(tmp_path / "b.jsonl")).first().a == 3
    with pytest.raises(ValueError, match="one known format"):
        io.read_by_extension(spark, ["a.json", "b.csv"])


def test_catalogue(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"q": "x", "output": "y"}\n')
    c = io.Catalogue({"d": {"file_name": "d.jsonl", "columns": {"input": "q"}}, "r": {"file_name": "d.jsonl", "ranking": True}, "h": {}}, str(tmp_path))
    assert c.read(spark, "d").first().input == "x"
    for name, stage in (("nope", None), ("r", "sft"), ("h", None)):
        with pytest.raises((KeyError, ValueError)):
            c.read(spark, name, stage)


def test_round_trip_and_partitions(spark, tmp_path):
    d = spark.createDataFrame([("t", ("u", "p", None, "parent", "s", 1, None, "en", None))], io.DOCUMENT)
    io.write_documents(d, str(tmp_path / "docs"))
    assert io.read_documents(spark, str(tmp_path / "docs")).first().metadata.source == "s"
    t = str(tmp_path / "idx")
    io.write_by_source(spark.createDataFrame([(1, "a"), (2, "b")], "v int, source string"), t)
    io.write_by_source(spark.createDataFrame([(3, "a")], "v int, source string"), t)
    assert sorted(tuple(r) for r in spark.read.parquet(t).collect()) == [(2, "b"), (3, "a")]


def test_binary(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert io.read_binary(spark, str(tmp_path), "*.bin").first().bytes == 3


def events(spark):
    return spark.createDataFrame([(1, "2024-01-01 00:01:00", 7, "a", 1.0), (2, "2024-01-01 00:09:00", 7, "a", 2.0), (3, "2024-01-01 01:30:00", 7, "b", 3.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))


def test_windows_and_sessions(spark):
    assert {(r.event_type, r.n, r.total) for r in jobs.windowed(events(spark)).collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
    assert sorted(r.n for r in jobs.sessions(events(spark)).collect()) == [1, 2]


def test_streamed_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    events(spark).coalesce(1).write.parquet(src)
    s = jobs.windowed(jobs.read_parquet_stream(spark, src))
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == 2


def test_index_and_resume(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("s", "o", "c"))
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, source string").coalesce(1).write.parquet(src)
    jobs.keep_index(jobs.read_parquet_stream(spark, src), out, ck).awaitTermination()
    spark.createDataFrame([(3, "a")], "v int, source string").coalesce(1).write.mode("append").parquet(src)
    jobs.keep_index(jobs.read_parquet_stream(spark, src), out, ck).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(2, "b"), (3, "a")]
    res, ck2 = str(tmp_path / "r"), str(tmp_path / "c2")
    for _ in range(2):
        jobs.resumable(jobs.read_parquet_stream(spark, src), lambda b: b.withColumn("x", F.col("v") * 2), res, ck2).awaitTermination()
    assert spark.read.parquet(res).count() == 3


def test_vector_collection(spark, tmp_path):
    c = index.VectorCollection(spark, f"file://{tmp_path}/vectors")
    with pytest.raises(ValueError, match="no collection"):
        c.read()
    c.create()
    with pytest.raises(ValueError, match="there is a collection"):
        c.create()
    d = spark.createDataFrame([("a", [1.0], "s"), ("b", [2.0], "s"), ("c", [3.0], "t"), (None, [4.0], "t")], "uid string, vector array<float>, source string")
    c.upsert(d)
    c.upsert(d.where("uid = 'a'").withColumn("vector", F.array(F.lit(9.0))))
    assert sorted((r.uid, r.vector[0]) for r in c.read().collect()) == [("a", 9.0), ("c", 3.0)]
    assert sorted((r.uid, r.page) for r in c.pages(1).collect()) == [("a", 0), ("c", 1)]
    c.create(again=True)
    assert c.read().count() == 0
    c.drop()
    assert not c.exists()


def test_stop_words_and_qa(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The\n\nof\nthe\n")
    stops = io.read_stop_words(spark, f"{tmp_path}/stop.txt")
    assert stops == ["of", "the"]
    d = spark.createDataFrame([("The cache of pages",)], "t string")
    assert d.select(tx.without_stops(tx.search_tokens("t"), stops).alias("x")).first().x == ["cache", "pages"]
    (tmp_path / "a.json").write_text('[{"id": "1", "q": "a"}]')
    (tmp_path / "b.jsonl").write_text('{"id": "1", "q": "b"}\n{"id": "2", "q": "c"}\n')
    schema = io.T.StructType([io.T.StructField(c, io.T.StringType()) for c in ("id", "q")])
    assert sorted(tuple(r) for r in io.read_qa(spark, f"{tmp_path}/a.json", f"{tmp_path}/b.jsonl", schema).collect()) == [("1", "a"), ("2", "c")]


def test_index_is_kept(spark, tmp_path):
    d = spark.createDataFrame([(1, "cache cache index"), (2, "index"), (3, None)], "id long, t string")
    q = spark.createDataFrame([("q", "index of the cache")], "qid string, t string")
    made = search.Postings(d, "id", "t")
    made.save(f"file://{tmp_path}/idx")
    kept = search.Postings.load(spark, f"file://{tmp_path}/idx")
    want = sorted(tuple(r) for r in search.bm25(made, q, "qid", "t", 5).collect())
    assert want and sorted(tuple(r) for r in search.bm25(kept, q, "qid", "t", 5).collect()) == want
    one = search.scores_of(kept, q, spark.createDataFrame([("q", 2), ("q", 3)], "qid string, doc long"), "qid", "t")
    assert {r.doc: r.score for r in one.collect()} == {2: next(x[2] for x in want if x[1] == 2), 3: 0.0}
