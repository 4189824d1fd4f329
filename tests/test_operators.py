import math
import random
import re

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators import chunking, crosspage, datasets, finetune, fusion, layout, losses, metrics, quality, scorers, search


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# search -----------------------------------------------------------------------------------------------------------
def test_bm25_by_hand(spark):
    d = spark.createDataFrame([(1, "cache cache index"), (2, "index"), (3, None), (4, "other words here")], "id long, t string")
    q = spark.createDataFrame([("q", "cache cache index")], "qid string, t string")
    got = search.bm25(search.Postings(d, "id", "t"), q, "qid", "t", 5).collect()
    n, avg = 4, 7 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, df, dl: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = {1: part(2, 1, 3) + part(1, 2, 3), 2: part(1, 2, 1)}
    assert {r.doc: r.score for r in got} == {k: round(v, 6) for k, v in want.items()} and [r.doc for r in sorted(got, key=lambda r: r["rank"])] == [1, 2]
    assert search.bm25(search.Postings(d.limit(0), "id", "t"), q, "qid", "t", 5).count() == 0
    made = search.Postings(d, "id", "t")
    assert rows(made.terms, "term", "df") == [("cache", 1), ("here", 1), ("index", 2), ("other", 1), ("words", 1)] and rows(made.postings.where("doc = 1"), "term", "len", "tf") == [("cache", 3, 2), ("index", 3, 1)]


def test_bm25_pairs_are_not_shuffled(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common", "en" if i % 2 else "zh") for i in range(40)], "id long, t string, l string")
    q = spark.createDataFrame([(None, "w1 common", "en"), ("b", "w2 w4 w4 none", "zh"), ("c", "common", "en")], "qid string, t string, l string")
    index = search.Postings(d, "id", "t", F.col("l"))
    t = {(r["lang"], r["term"]): r["df"] for r in index.terms.collect()}
    words = {r["id"]: r["t"].split() for r in d.collect()}
    want = []
    for a, text, lang in q.collect():
        s = {}
        for i in (i for i in words if (i % 2 == 1) == (lang == "en")):
            for w in set(text.split()) & set(words[i]):
                tf = words[i].count(w)
                s[i] = s.get(i, 0) + math.log(1 + (20 - t[lang, w] + 0.5) / (t[lang, w] + 0.5)) * tf * 2.5 / (tf + 1.5)  # all of one length
        want += [(a, i) for i, _ in sorted(s.items(), key=lambda x: (-round(x[1], 6), x[0]))[:4]]
    for size in (500_000, 2):
        monkeypatch.setattr(search, "SMALL_QUERIES", size)
        got = search.bm25(index, q, "qid", "t", 4, lang=F.col("l"))
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["query"], r["doc"]) for r in got.collect()} == set(want)


def test_dense_blocks_and_ties(spark, monkeypatch):
    r = random.Random(0)
    v = [(i, [float(r.randint(0, 3)) for _ in range(4)]) for i in range(60)] + [(98, None), (99, [1.0])]
    d = spark.createDataFrame(v, "id long, v array<float>")
    q = d.where("id % 10 = 0").select(F.col("id").alias("query"), F.col("v").alias("qvec"))
    want = set()
    for a, x in v[:60]:
        if a % 10 == 0:
            s = sorted(((-sum(p * y for p, y in zip(x, z)), b) for b, z in v[:60] if b != a))[:3]
            want |= {(a, k + 1, b) for k, (_, b) in enumerate(s)}
    assert set(rows(search.dense_top_k(d, q, "id", "v", 3), "query", "rank", "doc")) == want
    monkeypatch.setattr(search, "BLOCK_FLOATS", 8)
    assert set(rows(search.dense_top_k(d, q, "id", "v", 3), "query", "rank", "doc")) == want


def test_dense_scores_are_held_by_tiles(monkeypatch):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    x = np.round(r.normal(size=(2000, 8)), 1)
    x[50:90], x[::97] = x[7], 0
    doc, k = [int(i) for i in r.permutation(2000)], 4
    ask = list(range(0, 2000, 2))
    many = [pa.RecordBatch.from_arrays([pa.array(doc[i : i + 700]), pa.array(list(x[i : i + 700]), pa.list_(pa.float64()))], names=["doc", "v"]) for i in range(0, 2000, 700)]
    monkeypatch.setattr(search, "TILE", 1 << 13)
    tracemalloc.start()
    got = [b.to_pylist() for b in search.dense_best(many, [doc[i] for i in ask], x[ask], k)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700 * len(ask) * 8 / 2  # all scores of a batch took several times as much
    rows_of = {}
    for b in got:
        for h in b:
            rows_of.setdefault(h["query"], []).append((-h["score"], h["doc"]))
    for i in ask:
        s = np.round(x @ x[i], 6)
        assert sorted(rows_of[doc[i]]) == sorted((-v, d) for v, d in zip(s, doc) if d != doc[i])[:k]


@pytest.mark.parametrize("k", [2, 4, 1 << 30])
def test_sums_of_shared_terms_as_by_hand(monkeypatch, k):
    import numpy as np
    import pyarrow as pa

    r = random.Random(k)
    monkeypatch.setattr(search, "TILE", 1 << 9)
    docs = {i: {min(int(r.expovariate(0.2)), 30): round(r.uniform(-0.3, 3), 2) for _ in range(r.randint(0, 7))} for i in range(400)}
    for i in range(40, 60):
        docs[i] = dict(docs[3])
    ask = list(range(0, 400, 7))
    qi, qt, qw = (np.array(x) for x in zip(*[(j, t, w) for j, i in enumerate(ask) for t, w in docs[i].items()]))
    order = r.sample(sorted(docs), 400)
    many = [pa.RecordBatch.from_arrays([pa.array(order[i : i + 90])], names=["doc"]) for i in range(0, 400, 90)]

    def weigh(t):
        got = [(j, a, w) for j, i in enumerate(t.column("doc").to_pylist()) for a, w in docs[i].items()]
        return tuple(np.array(x) for x in zip(*got))

    found = {}
    for b in search.sums_best(many, ask, qi, qt, qw.astype(float), weigh, k, True):
        for h in b.to_pylist():
            found.setdefault(h["query"], []).append((-h["score"], h["doc"]))
    for i in ask:
        want = sorted((-round(sum(w * docs[j][t] for t, w in docs[i].items() if t in docs[j]), 6), j) for j in docs if j != i and docs[i].keys() & docs[j].keys())
        got = sorted(found.get(i, []))
        assert [d for _, d in got] == [d for _, d in want[:k]] and [v for v, _ in got] == pytest.approx([v for v, _ in want[:k]], abs=1.1e-6)


def test_sparse_pairs_are_not_shuffled(spark, monkeypatch):
    d = spark.createDataFrame([(i, {i % 7: 1.0 + i % 3, 100 + i % 2: 0.5}) for i in range(40)] + [(90, {}), (91, None)], "id long, s map<int,float>")
    q = d.where("id % 5 = 0").select(F.col("id").alias("query"), F.col("s").alias("qw"))
    v = {r["id"]: r["s"] or {} for r in d.collect()}
    want = []
    for a in range(0, 40, 5):
        s = sorted((-sum(w * v[b][t] for t, w in v[a].items() if t in v[b]), b) for b in v if b != a and v[a].keys() & v[b].keys())[:3]
        want += [(a, k + 1, b) for k, (_, b) in enumerate(s)]
    got = search.sparse_top_k(d, q, "id", "s", 3)
    assert rows(got, "query", "rank", "doc") == sorted(want) and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "SMALL_QUERIES", 4)
    assert rows(search.sparse_top_k(d, q, "id", "s", 3), "query", "rank", "doc") == sorted(want)


def test_fusion_and_routes(spark):
    mk = lambda x: spark.createDataFrame([("q", i + 1, d, 1.0 / (i + 1)) for i, d in enumerate(x)], "query string, rank int, doc string, score double")
    f = search.fuse([mk("abc"), mk("bd")], 3)
    assert rows(f, "rank", "doc") == [(1, "b"), (2, "a"), (3, "d")]
    assert rows(search.in_route_order([mk("ab"), mk("bc")], 5), "rank", "doc") == [(1, "a"), (2, "b"), (3, "c")]
    m = fusion.merge_results([mk("ab").withColumnRenamed("rank", "pos"), mk("bc").withColumnRenamed("rank", "pos")], "doc")
    assert rows(m, "rank", "doc") == [(1, "a"), (2, "b"), (3, "c")]


def test_rerank_is_stable(spark):
    d = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.5), ("q", 3, "c", None), ("q", 4, "d", 0.9)], "query string, rank int, doc string, s double")
    assert [r.doc for r in search.rerank(d, F.col("s"), 4).orderBy("new_rank").collect()] == ["d", "a", "b", "c"]


# ordered sets -------------------------------------------------------------------------------------------------------
def test_parents(spark):
    docs = spark.createDataFrame([("p", "p"), ("c1", "p"), ("c2", "p"), ("x", "gone")], "uid string, parent_id string")
    hits = spark.createDataFrame([("q", 1, "c2"), ("q", 2, "c1"), ("q", 3, "x")], "query string, rank int, doc string")
    assert rows(fusion.to_parents(hits, docs), "rank", "parent") == [(1, "p"), (2, "x")]
    assert rows(fusion.to_parents(hits, docs, fallback=False), "rank", "parent") == [(1, "p")]


def test_first_and_last(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "uid string, pos int, v string")
    assert rows(fusion.first_of(d, ["uid"], ["pos"]), "uid", "v") == [("a", "x"), ("b", "y")]
    assert rows(fusion.last_at_first_place(d, "uid", "pos"), "pos", "uid", "v") == [(1, "a", "z"), (2, "b", "y")]


def test_sync(spark):
    old = spark.createDataFrame([("a", "s", 1, 0), ("b", "s", 1, 0), ("c", "t", 1, 0), ("n", None, 1, 0)], "uid string, source string, v int, pos int")
    new = spark.createDataFrame([("a", "s", 2, 1), ("d", "s", 2, 2), (None, "s", 2, 3)], "uid string, source string, v int, pos int")
    got, stale = fusion.sync_source(old, new, "s")
    assert rows(got, "uid", "v") == [("a", 2), ("c", 1), ("d", 2), ("n", 1)] and rows(stale, "uid") == [("b",)]
    again, _ = fusion.sync_source(got, new, "s")
    assert rows(again, "uid", "v") == rows(got, "uid", "v")
    assert rows(fusion.upsert(old.drop("pos"), new.drop("pos"), "uid"), "uid", "v") == [("a", 2), ("b", 1), ("c", 1), ("d", 2), ("n", 1)]


def test_islands(spark):
    d = spark.createDataFrame([(i, k) for i, k in enumerate("aabba")] + [(5, None), (6, None)], "i int, k string")
    assert [r.island for r in fusion.islands(d, ["i"], ["k"]).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3, 3]


# metrics ------------------------------------------------------------------------------------------------------------
def test_ranking_metrics(spark):
    d = spark.createDataFrame([("a", 1, 0), ("a", 2, 2), ("a", 3, 1), ("b", 1, 0), ("b", 2, None)], "query string, rank int, label int")
    m = {r["query"]: r for r in metrics.ranking_metrics(d, (1, 3)).collect()}
    dcg, ideal = 3 / math.log2(3) + 1 / 2, 3 + 1 / math.log2(3)
    assert m["a"].hit_1 == 0 and m["a"].hit_3 == 1 and m["a"].rr == 0.5 and m["a"].ap == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert m["a"].ndcg_3 == pytest.approx(dcg / ideal) and m["b"].recall_3 == 0 and m["b"].ndcg_3 == 0
    assert metrics.macro_average(metrics.ranking_metrics(d.limit(0), (1,))).first().queries == 0


def test_answer_metrics(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "c", "c"]), ([], []), (["a"], [])], "g array<string>, s array<string>")
    r = d.select(metrics.token_f1(F.col("g"), F.col("s")).alias("f"), metrics.lcs_length("g", "s").alias("l"), metrics.text_scores("g", "s").alias("m"), metrics.longest_shared_run("g", "s").alias("run")).collect()
    assert [x.f for x in r] == [pytest.approx(4 / 6), 1.0, 0.0] and [x.l for x in r] == [2, 0, 0] and r[0].m.rouge_l == pytest.approx(4 / 6) and r[1].m.rouge_l == 1.0 and r[0].run == 1


def test_lcs_against_table():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics._lcs(a, b) == t[-1][-1]


def test_statuses_and_bins(spark):
    d = spark.createDataFrame([("无答案", "不知道"), ("无答案", "A cache"), ("A cache", "无法回答"), ("A cache", "An index"), ("A  <b>cache</b>", "a CACHE")], "g string, s string")
    got = [r.x for r in d.select(metrics.answer_status("g", "s").alias("x")).collect()]
    assert got == ["correct_no_answer", "missed_no_answer", "false_no_answer", "content_mismatch", "exact_match"]
    h = metrics.histogram(spark.createDataFrame([(0,), (9,), (None,), (3,)], "v int"), F.col("v"), 1, 5)
    assert rows(h, "score", "n") == [(1, 2), (2, 0), (3, 1), (4, 0), (5, 1)]


# quality, layout, chunks ----------------------------------------------------------------------------------------------
def test_quality_routes(spark):
    long = "The inverted index keeps terms because it is a method. " * 8
    texts = ["", "@@## $$ ^^ &&", "Chapter 3", "however, a list of", "Do Exercise 1.2 for the index.", "As shown in Figure 3 the cache works.", long, "A postings list is defined as a list of documents for one term.", long.replace(". ", "; "), "Nice weather today, friends."]
    d = quality.with_quality(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t")
    assert [r.reason for r in d.orderBy("i").collect()] == [
        "empty", "too_noisy", "low_information", "incomplete_both_ends", "exercise_or_question_block", "caption_or_strong_figure_dependency", "rule_high_quality",
        "rule_short_but_complete", "borderline_high_value", "borderline",
    ]
    assert spark.range(1).select(quality.stricter(F.lit("core"), F.lit("extra")).alias("x")).first().x == "extra"
    u = quality.unfit_documents(spark.createDataFrame([("a" * 9,), (" ",), (None,), ("x ERROR y",)], "t string"), "t", ("ERROR",), 5)
    assert rows(u, "t") == [("aaaaa",)]


def test_layout(spark):
    lines = "Running head\n" + "\n".join(f"This is line {i} of the body, which says something long." for i in range(20)) + "\n12"
    d = spark.createDataFrame([("s", 1, lines), ("s", 2, None)], "src string, p int, t string")
    b = layout.with_gaps(layout.blocks_of_lines(d, "t", F.col("src"), F.col("p")))
    got = {r.block_no: r.furniture for r in layout.furniture(b, layout.learn_bands(b)).collect()}
    assert got[21] == "page_number" and got[20] == "footer" and got[10] is None
    tall = b.withColumn("height_ratio", F.lit(0.02))
    assert layout.furniture(tall, layout.learn_bands(tall)).where("furniture = 'header'").count() == 5
    reg = spark.createDataFrame([("s", 1, 0.0, 0.0, 1000.0, 30.0)], "source string, page_no int, x0 double, y0 double, x1 double, y1 double")
    assert min(r.block_no for r in layout.outside_regions(b, reg).collect()) == 3


def test_chunks_cover_all_nodes(spark):
    text = [("u", 1, 0, "heading", "1.1 The cache"), ("u", 1, 1, "body", "The cache keeps pages. It is fast. However, the index is another thing. The index maps terms. It is large."), ("u", 1, 2, "caption", "Figure 1: The cache"), ("u", 1, 3, "body", "More text here. And more of it.")]
    u = spark.createDataFrame(text, "source string, page_no int, unit_no int, unit_type string, text string")
    page = ["source", "page_no"]
    n = chunking.nodes(u, page)
    c = chunking.chunks(n, chunking.cuts(chunking.boundaries(n, page), page), page)
    got = c.orderBy("chunk").collect()
    assert sum(r.n_nodes for r in got) == n.count() and [r.chunk for r in got] == list(range(len(got)))
    assert any(list(r.node_types)[-1] == "caption" for r in got) and got[0].heading == "1.1 The cache"


def test_splitter():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(r.choice(["word ", "long sentence. ", "\n", "\n\n", "中文。", "x"]) for _ in range(r.randint(0, 80)))
        p = chunking.split_recursively(t, 40, 8, ("\n\n", "\n", ". ", "。", " ", ""))
        assert all(0 < len(x) <= 40 for x in p) and "".join("".join(p).split()) != "" or not t.strip()
        assert all(w in " ".join(p) for w in t.split() if len(w) < 8)


def test_parents_and_children(spark):
    d = spark.createDataFrame([("A long sentence here. " * 40, "s", 1), ("short", "s", 2), (None, "s", 3)], "t string, s string, p int")
    x = chunking.parents_and_children(d, "t", "s", "p").toPandas()
    assert (x.level == "parent").sum() == 2 and x[x.level == "child"].text.str.len().max() <= 256 and x[x.level == "child"].parent_id.nunique() == 1


def test_figures_and_footnotes(spark):
    c = spark.createDataFrame([("c", 1, "As Figure 2 and Table 1 show, the cache keeps pages. See Figure 2.")], "k string, p int, text string")
    f = spark.createDataFrame([("Figure 2", "b.png", "Cap", 1), ("Figure 2", "a.png", "Other", 2)], "label string, image_path string, caption string, page_no int")
    got = chunking.attach_figures(c, f, "k").first().figures
    assert [(x.label, x.image_path) for x in got] == [("Figure 2", "b.png")]
    n = spark.createDataFrame([(1, "The cache keeps pages in memory"), (None, "The cache keeps pages")], "p int, text string")
    assert [r.note for r in chunking.attach_footnotes(c, n, "k", ["p"]).collect()] == ["The cache keeps pages in memory"]


def test_captions_in_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = "See Figure 1.2 and fig. 1.2, Figure 1.2 (here) or Figure 1.23; Figure 1.2."
    assert one(tx.with_caption(F.lit(t), F.lit("Figure 1.2"), F.lit("a cache"))) == "See Figure 1.2 (a cache) and fig. 1.2, Figure 1.2 (here) or Figure 1.23; Figure 1.2 (a cache)."
    assert one(tx.with_caption(F.lit("Fig 3, fig. 3"), F.lit("Figure 3"), F.lit("x"), 1)) == "Fig 3, fig. 3 (x)"
    assert one(tx.short_caption(F.lit("◮ Figure 1.2: The cache. More of it."), F.lit("Figure 1.2"))) == "The cache."
    c = spark.createDataFrame([("c", "As Figure 2 shows."), ("d", "The large cache of pages. See Figure 2."), ("e", "None.")], "k string, text string")
    u = spark.createDataFrame([(1, "Figure 2 The large cache of pages", None), (3, "Figure 2 Other", "b.png")], "page_no int, text string, image_path string")
    got = {r.k: r for r in chunking.with_captions(c, layout.figure_index(u), "k").collect()}
    assert got["c"].text == "As Figure 2 (The large cache of pages) shows." and got["d"].text == "The large cache of pages. See Figure 2." and got["e"].figures is None
    assert got["c"].figures[0].image_path == "b.png" and got["c"].figures[0].page_no == 1


def test_visual_lines_and_captions(spark):
    at = lambda y, x, t, w=100.0: ("s", 1, y, x, y + 10, x + w, t, 800.0)
    lines = [at(10.0, 0.0, "Figure 1", 40.0), at(10.5, 50.0, "The cache"), at(22.0, 0.0, "goes on here"), at(34.0, 2.0, "and here."), at(90.0, 0.0, "Body text."), at(102.0, 0.0, "Table 2 Next"), at(114.0, 100.0, "Far right.")]
    d = spark.createDataFrame(lines, "source string, page_no int, y0 double, x0 double, y1 double, x1 double, text string, page_height double")
    v = layout.visual_lines(d)
    assert [r.text for r in v.orderBy("line_no").collect()][:2] == ["Figure 1 The cache", "goes on here"]
    gaps = spark.createDataFrame([("s", 1, 2.0)], "source string, page_no int, line_gap double")
    got = layout.caption_regions(v, gaps).orderBy("y0").collect()
    assert [(r.kind, r.label, r.text, r.lines) for r in got] == [("figure", "Figure 1", "Figure 1 The cache goes on here and here.", 3), ("table", "Table 2", "Table 2 Next", 1)]


def test_sentences_against_plain(spark):
    texts = ["It is so. 1. First point here. 2. Second point there. End of it.", "(1) Alpha one (2) Beta two. And then. a) Gamma", "See Fig. 3. It is e.g. good! 3. Next", "One. 1. Two", ""]

    def plain(t):
        keep = {a: chr(0xE000 + i) for i, a in enumerate(tx.ABBREVIATIONS)}
        for a, k in keep.items():
            t = t.replace(a, k)
        out = []
        for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", t):
            marks = [m.start() for m in re.finditer(r"(?<!\w)(?=(?:\(?\d+\)|\d+\.|[A-Za-z]\))\s+[A-Z])", p)]
            cuts = [0, *marks, len(p)] if len(marks) > 1 else [0, len(p)]
            parts = [p[a:b].strip() for a, b in zip(cuts, cuts[1:]) if p[a:b].strip()]
            i = 0
            while i < len(parts):
                if re.fullmatch(r"\(?\d+\)|\d+\.|[A-Za-z]\)", parts[i]) and i + 1 < len(parts):
                    out.append(parts[i] + " " + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
        for a, k in keep.items():
            out = [x.replace(k, a) for x in out]
        return [x for x in out if len(x) >= 2]

    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in d.select(tx.sentences("t").alias("s")).collect()] == [plain(t) for t in texts]


def test_cross_page(spark):
    u = spark.createDataFrame([("s", 1, 0, "body", "The cache keeps pages that are"), ("s", 2, 0, "caption", "Figure 1: x."), ("s", 3, 0, "body", "used often by readers."), ("s", 3, 1, "body", "New text."), ("s", 3, 2, "footnote", "1 note")], "source string, page_no int, unit_no int, unit_type string, text string")
    got = crosspage.merge_across_pages(u).orderBy("page_no", "unit_no").toPandas()
    assert got.text.tolist()[0] == "The cache keeps pages that are used often by readers." and list(got.pages.tolist()[0]) == [1, 3] and len(got) == 4


def test_page_runs_lose_nothing(spark, monkeypatch):
    r = random.Random(11)
    kinds = {"heading": ["1.2 The cache"], "caption": ["Figure 1 The cache that", "Table 2 Pages."], "footnote": ["1 A note"], "body": ["It keeps pages that", "and goes on with", "used by readers.", "The end is here."]}
    data = []
    for s in ("a", "b", None):
        for p in range(120):
            for k in range(r.randint(1, 8)):
                t = r.choices(list(kinds), (1, 1, 1, 5))[0]
                data.append((s, p, k, t, r.choice(kinds[t])))
    u = spark.createDataFrame(data, "source string, page_no int, unit_no int, unit_type string, text string")
    runs = crosspage.page_runs(crosspage._with_marks(u))
    assert runs.groupBy("source", "run").count().count() > 20 and runs.groupBy("run").agg(F.count_distinct(F.coalesce("source", F.lit("-"))).alias("n")).where("n > 1").count() == 0
    got = rows(crosspage.merge_across_pages(u).withColumn("source", F.coalesce("source", F.lit("-"))), "source", "page_no", "unit_no", "text")
    monkeypatch.setattr(crosspage, "page_runs", lambda x: x.select("source", "page_no").distinct().withColumn("run", F.lit(0)))
    assert got == rows(crosspage.merge_across_pages(u).withColumn("source", F.coalesce("source", F.lit("-"))), "source", "page_no", "unit_no", "text")
    assert any(len(x[3]) > 60 for x in got)


def test_carried_sums(spark):
    r = random.Random(4)
    keys = [r.choice("ab") for _ in range(500)]
    d = spark.createDataFrame(list(enumerate(keys)), "i int, k string").repartition(7)
    want, n = [], 0
    for i, k in enumerate(keys):
        n += i > 0 and k != keys[i - 1]
        want.append(n)
    assert [x.island for x in fusion.islands(d, ["i"], ["k"]).orderBy("i").collect()] == want
    assert fusion.numbered(d, ["i"]).where("place <> i").count() == 0 and fusion.numbered(d.limit(0), ["i"]).count() == 0


# datasets -------------------------------------------------------------------------------------------------------------
def test_qa_pairs(spark):
    d = spark.createDataFrame([("u", '[{"question":" a ","answer":"b"},{"question":"c","answer":"d"},{"question":"","answer":"x"}]', [5, 3]), ("v", "no json", None)], "unique_id string, raw_resp string, sc array<int>")
    assert rows(datasets.qa_pairs(d, scores="sc"), "source_uid", "question") == [("u#0", "a")]
    assert datasets.qa_pairs(d).count() == 2


def test_splits(spark):
    d = spark.range(1000).withColumn("g", (F.col("id") / 7).cast("int"))
    s = datasets.split_exact(d, "id", 0.9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 900, "test": 100}
    g = datasets.split_groups(d, "g").groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).toPandas()
    assert (g.n == 1).all() and 0.05 < (g.s == "test").mean() < 0.15
    assert datasets.split_exact(d.limit(0), "id", 0.9).count() == 0


def test_training_lists(spark):
    d = spark.createDataFrame([("q", i, int(i == 0)) for i in range(10)] + [("z", 1, 0)], "query_id string, doc int, label int")
    got = datasets.training_lists(d, 4).groupBy("query_id", "list_no").agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).collect()
    assert all(r.n == 4 and r.k == 2 and r.query_id == "q" for r in got) and got


def test_grouping_round_trip(spark):
    d = spark.createDataFrame([(0, "a", "x", "c1", 1), (1, "a", "x", "c2", 0), (2, "b", "y", "c3", 1), (3, "a", "x", "c4", 1)], "pos int, query_id string, query string, content string, label int")
    g = datasets.grouped_hits(d)
    assert g.count() == 3 and rows(datasets.pointwise(g), "content", "label") == rows(d, "content", "label")


def test_batches(spark):
    b = datasets.batches(spark.range(1003), 10, ["id"])
    assert b.count() == 1000 and b.where(F.col("batch") != F.floor(F.col("id") / 10)).count() == 0


def test_triplets(spark):
    d = spark.createDataFrame([("q", ["p1", "p2"], ["n1", "n2"]), ("r", ["p"], [])], "query string, pos array<string>, neg array<string>")
    got = datasets.triplets(d, 3).collect()
    assert len(got) == 2 and all(len(r.negs) == 3 and set(r.negs) == {"n1", "n2"} for r in got)


def test_grades(spark):
    d = spark.createDataFrame([(-1,), (0,), (1,)], "r int")
    assert [x.g for x in d.select(datasets.relevance_grade(F.col("r")).alias("g")).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="unknown relevance"):
        spark.range(1).select(datasets.relevance_grade(F.lit(5))).collect()


# fine-tuning ------------------------------------------------------------------------------------------------------------
GOLDEN = [((3000, 2000), (600, 400)), ((2000, 3000), (400, 600)), ((1000, 100), (900, 100)), ((100, 1000), (100, 900)), ((100, 500), (100, 500)), ((500, 100), (500, 100)), ((10, 10), (10, 10))]


def test_budget_golden(spark):
    d = spark.createDataFrame([x for x, _ in GOLDEN], "s int, t int").select(finetune.budget(F.col("s"), F.col("t"), 1000).alias("b"))
    assert [(r.b.source, r.b.target) for r in d.collect()] == [y for _, y in GOLDEN]


def test_converters(spark):
    a = spark.createDataFrame([("Do", "it", "done", None), ("Do", "", None, "S")], "instruction string, input string, output string, system string")
    r = finetune.align(a, "alpaca").collect()
    assert r[0].prompt[0].content == "Do\nit" and r[0].response[0].content == "done" and r[1].system == "S" and r[1].response == []
    s = spark.createDataFrame([([("system", "S"), ("human", "a"), ("gpt", "b")],), ([("gpt", "b"), ("human", "a")],), ([("human", "a"), ("gpt", "b"), ("human", "c"), ("gpt", "d")],)], "conversations array<struct<from:string,value:string>>")
    r = finetune.align(s, "sharegpt").collect()
    assert r[0].system == "S" and len(r[0].prompt) == 1 and r[1].prompt == [] and len(r[2].prompt) == 3 and r[2].response[0].content == "d"
    o = spark.createDataFrame([([("user", "a"), ("assistant", "call"), ("tool", "1"), ("tool", "2"), ("assistant", "b")],)], "messages array<struct<role:string,content:string>>")
    r = finetune.align(o, "openai").first()
    assert [m.content for m in r.prompt] == ["a", "call", "1\n2"] and r.response[0].content == "b"


def test_mask_and_packing(spark):
    m = spark.range(1).select(finetune.block_mask(F.array(*[F.lit(x) for x in (1, 1, 2, 2, 2, 0)])).alias("m")).first().m
    seg = (1, 1, 2, 2, 2, 0)
    assert m == [[j <= i and seg[i] == seg[j] and seg[i] > 0 for j in range(6)] for i in range(6)]
    d = spark.createDataFrame([(0, i, n, [i] * n, [i] * n) for i, n in enumerate([5, 3, 4, 9, 1, 2])], "b int, k int, n int, input_ids array<int>, labels array<int>")
    p = finetune.pack_greedy(d, "b", "k", "n", 8)
    load = p.join(d.select(F.col("k").alias("key"), "n"), "key").groupBy("pack").agg(F.sum("n").alias("s")).collect()
    assert all(r.s <= 8 for r in load) and p.count() == 5
    q = finetune.packed_sequences(d, p, "k", 8).collect()
    assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 9 for r in q)


def test_packs_against_plain():
    r = random.Random(5)
    for _ in range(200):
        sizes, room = [r.randint(0, 14) for _ in range(r.randint(0, 25))], r.randint(1, 12)
        pool, want = sorted(n for n in sizes if 0 < n <= room), []
        while pool:
            left, pack = room, []
            while any(n <= left for n in pool):
                n = max(n for n in pool if n <= left)
                pool.remove(n)
                pack.append(n)
                left -= n
            want.append(pack)
        got = finetune.fill_packs(sizes, room)
        assert [[sizes[i] for i in p] for p in got] == want and len({i for p in got for i in p}) == sum(map(len, got))


def test_supervised_and_padding(spark):
    d = spark.createDataFrame([(0, "abc", "de"), (0, "a", "b")], "b int, p string, r string")
    s = finetune.supervised(d, "p", "r", 100)
    r = s.orderBy("p").collect()
    assert r[1].input_ids == [97, 98, 99, 100, 101, 256] and r[1].labels == [-100] * 3 + [100, 101, 256]
    assert {len(x.input_ids) for x in finetune.padded_batches(s, "b", 50).collect()} == {6}


def test_sampling(spark):
    d = spark.range(10)
    g = finetune.resample(d, "id", 25).groupBy("id").count().collect()
    assert sum(r["count"] for r in g) == 25 and {r["count"] for r in g} == {2, 3}
    x = finetune.interleave([spark.range(100), spark.range(1000, 1100)], [1.0, 0.5], "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in x} == {0: 100, 1: 50}


# losses, seams ------------------------------------------------------------------------------------------------------------
def test_losses(spark):
    d = spark.createDataFrame([("q", 1, 2.0, 1), ("q", 2, 1.0, 0)], "query string, doc int, score double, label int")
    assert losses.pairwise_ranknet(d).first().loss == pytest.approx(math.log(1 + math.exp(-1)))
    assert losses.listwise_ce(d).first().loss == pytest.approx(math.log(math.exp(2) + math.exp(1)) - 2)
    assert losses.pointwise_mse(d).first().loss == 1.0
    assert losses.kl_to_scores(d.withColumn("teacher", F.col("score"))).first().loss == pytest.approx(0)


def test_citations_and_registry(spark):
    h = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b")], "query string, rank int, doc string")
    a = spark.createDataFrame([("q", "x【2，9】y【1】")], "query string, answer string")
    assert rows(scorers.cited(a, h), "place", "doc") == [(0, "b"), (2, "a")]
    scorers.register("score", "zero")(lambda q, d: F.lit(0.0))
    assert scorers.get("score", "zero")("a", "b") is not None
