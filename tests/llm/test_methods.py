"""Each method against brute force, round trips or planted cases on small inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import language, leaks, mixing, neighbours, overlap, pairs, scans, spam, splitting, truncation
from folioweave.llm.queries import VOCABULARY
from folioweave.llm._text import fold

WORDS = "the old index keeps every short page near a local cache while some reader asks for more results of that long query and this server answers within one second".split()


def sentence(r, n=12):
    w = [r.choice(WORDS) for _ in range(n)]
    return " ".join(w).capitalize() + "."


def test_cut_against_brute_force():
    r = random.Random(1)
    for _ in range(4000):
        share = r.choice([0.02, 0.05, 0.2, 0.5])
        t = "".join(r.choice(" \n.。,") if r.random() < share else r.choice("ab中") for _ in range(r.randint(0, 250)))
        for over in (0, 6):
            p = splitting.cut(t, 30, over, block=64)
            if len(t) <= 30:
                assert len(p) == (1 if t else 0)
                continue
            assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < e - s <= 30 for s, e, _ in p)
            assert all(s < s2 <= e < e2 and e - s2 <= over for (s, e, _), (s2, e2, _) in zip(p, p[1:]))
            assert any(f for *_, f in p) == bool(re.search(r"[^\s.!?。！？]{31,}", t))


def test_range_max():
    r = np.random.default_rng(0)
    v = r.integers(0, 50, 300)
    m = splitting.RangeMax(v, 300)
    for _ in range(500):
        a, b = sorted(r.integers(0, 300, 2))
        assert m.max(int(a), int(b)) == v[a : b + 1].max()


def test_wu_manber_against_find():
    r = random.Random(2)
    for _ in range(150):
        t = "".join(r.choice("ab") for _ in range(r.randint(0, 400)))
        ps = ["".join(r.choice("ab") for _ in range(r.randint(4, 9))) for _ in range(5)]
        code = lambda s: np.array([ord(c) for c in s], np.uint32)
        got = sorted(leaks.WuManber([code(p) for p in ps]).search(code(t), lanes=7))
        assert got == sorted((i, k) for k, p in enumerate(ps) for i in range(len(t)) if t.startswith(p, i))


def test_leaks_against_windows(spark):
    r = random.Random(3)
    gold = [(f"e{i}", " ".join(sentence(r) for _ in range(4))) for i in range(8)] + [("zh", "".join(chr(0x4E00 + r.randrange(400)) for _ in range(90)))]
    body = []
    for i in range(60):
        t = " ".join(sentence(r) for _ in range(6))
        g = r.choice(gold)
        if i % 3 == 0:
            if g[0] == "zh":
                n, at = r.randint(20, 45), r.randint(0, 40)
                t += "\n，" + " ".join(g[1][at : at + n])
            else:
                w, n = g[1].split(), r.randint(10, 22)
                at = r.randint(0, len(w) - n)
                t += " » " + " - ".join(w[at : at + n]).upper() + " " + sentence(r)
        body.append((i, t))
    want = set()
    for sid, g in gold:
        units = list(fold(g)) if sid == "zh" else [fold(w) for w in g.split()]
        n = 30 if sid == "zh" else 15
        for a in range(len(units) - n + 1):
            want |= {(sid, i) for i, t in body if "".join(units[a : a + n]) in fold(t)}
    got = leaks.leaked_passages(spark.createDataFrame(body, "doc_id long, text string"), spark.createDataFrame(gold, "sample_id string, gold_answer string"))
    assert {tuple(x) for x in got.collect()} == want and want


def test_scanned_page(spark):
    r = random.Random(4)
    plain = [(f"p{i}", " ".join(sentence(r, 20) for _ in range(5)) + " A well-known answer follows. It is well-known.", "a") for i in range(20)]
    page = "   FIELD NOTES OF THE CACHE\nThe old indcx keeps every short page near a local\ncache while some reader asks for more res-\nults of that well-\nknown query and this server answers witbin\n   - 12 -\n\n   Field Notes of the Cache  13\none second. The old index keeps every short page\nnear a local cache."
    rows = [*plain, ("scan", page, "b")]
    d = spark.createDataFrame(rows, "unique_id string, page_content string, source string")
    noise = scans.scan_noise(d)
    got = {(x.unique_id, x.kind, x.fixed) for x in noise.collect()}
    assert got == {
        ("scan", "header", "FIELD NOTES OF THE CACHE"), ("scan", "header", "Field Notes of the Cache  13"), ("scan", "page_number", "- 12 -"),
        ("scan", "hyphen", "results"), ("scan", "hyphen", "well-known"), ("scan", "misread", "index"), ("scan", "misread", "within"),
    }
    text = scans.repaired_text(d, noise).first().text
    assert text.startswith("The old index keeps every short page near a local cache while some reader asks for more results of that well-known query and this server answers within one second.")
    assert "FIELD" not in text and "- 12 -" not in text


def test_distance():
    assert scans.distance("rnodel", "model") == pytest.approx(0.3) and scans.distance("m0del", "model") == pytest.approx(0.3)
    assert scans.distance("modxl", "model") == pytest.approx(1.0) and scans.distance("model", "model") == 0


def test_prefix_join(spark):
    r = random.Random(5)
    longs = [" ".join(sentence(r) for _ in range(4)) for _ in range(40)]
    rows = [(f"l{i}", t, "a") for i, t in enumerate(longs)] + [(f"c{i}", t[: 40 + i], "b") for i, t in enumerate(longs)] + [("same", longs[0][:40], "c")]
    rows += [("short", longs[1][:9], "a"), ("chance", longs[2][:9], "elsewhere"), ("head", "Some heading", "a"), ("page", "Some heading\nand its text.", "a")]
    d = spark.createDataFrame(rows, "unique_id string, page_content string, source string")
    got = {x.unique_id: x for x in truncation.truncated(d, parent=None, level=None).where("by_prefix").collect()}
    whole = {k: t for k, t, _ in rows}
    want = {k for k, t, _ in rows if len(t) >= truncation.HEAD and not scans.closed(t) and any(u != t and u.startswith(t) for _, u, _ in rows)}
    assert set(got) == want | {"short"} and "same" in got and all(x.cut for x in got.values())
    assert all(any(t.startswith(whole[k] + x.more) for _, t, _ in rows) for k, x in got.items())


def test_goes_on_in_parent(spark):
    r = random.Random(8)
    p = " ".join(sentence(r, 12) for _ in range(20))
    rows = [("p", p, "parent", None), ("c1", p[100:400], "child", "p"), ("c2", p[len(p) - 300 : -1], "child", "p"), ("c3", p[50:90], "child", "q"), ("c4", p[:8], "child", "p"), ("c5", "Something else that is cut in the mid", "child", "p")]
    d = spark.createDataFrame(rows, "unique_id string, page_content string, chunk_level string, parent_id string").withColumn("source", F.lit("s"))
    got = {x.unique_id: x.in_parent for x in truncation.truncated(d).collect()}
    # c2 goes on by the parent's last stop alone
    assert got == {"p": False, "c1": True, "c2": True, "c3": False, "c4": True, "c5": False}


def test_cut_at_end():
    cut = ["The cache keeps every pa", "Every word is here and", "The page was stored…", "缓存保存每一页，而且读者", "All of it stands [truncated]", "The value is &am", "Body text. And then the ne\n"]
    whole = ["All is well.", "3.6 Modern Keyword Extractor", "Figure 4: The cache", "Items:\n- one\n- two things", "a | b | c", "缓存保存每一页。", "The tool works (v2.5)", "", "12"]
    assert all(map(truncation.cut_at_end, cut)) and not any(map(truncation.cut_at_end, whole))


def test_graph_recall():
    r = np.random.default_rng(0)
    x = np.concatenate([c + 0.25 * r.normal(size=(60, 32)) for c in r.normal(size=(25, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbours.Graph(x.astype(np.float32))
    ids, _ = g.search(x.astype(np.float32), 40)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :5]
    hit = np.mean([len(set(a[a != i][:5]) & set(b)) / 5 for i, (a, b) in enumerate(zip(ids, true))])
    assert hit > 0.95 and (g.edge < len(x)).all() and g.edge.shape[1] == 30


def test_neighbours_recall(spark):
    r = np.random.default_rng(1)
    x = np.concatenate([c + 0.3 * r.normal(size=(40, 16)) for c in r.normal(size=(40, 16))]) * r.uniform(0.5, 3, (1600, 1))
    d = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.most_similar(d, shard_size=200).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    assert len(true & set(zip(got.vec_id, got.neighbour))) / len(true) > 0.9


def test_many_shards(spark, monkeypatch):
    """Hundreds of shards, grouped about coarser centroids, and shards that only hashes can divide."""
    r = np.random.default_rng(5)
    x = np.concatenate([c + 0.3 * r.normal(size=(40, 16)) for c in r.normal(size=(100, 16))])
    d = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "FLAT", 64)
    got = neighbours.most_similar(d, shard_size=16, sample=2000).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    assert len(true & set(zip(got.vec_id, got.neighbour))) / len(true) > 0.9
    monkeypatch.setattr(neighbours, "_split_hot", lambda reps, cent, size: (cent[:1], {0: reps.count()}))
    whole = neighbours.most_similar(d, shard_size=100, sample=2000).toPandas()
    assert len(true & set(zip(whole.vec_id, whole.neighbour))) / len(true) > 0.95


def test_hot_shards_are_divided(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(400, 8)), np.array([3.0] + [0] * 7) + 0.05 * r.normal(size=(1200, 8))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    d = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<float>")
    start = neighbours.fit_centroids(x[:400], 4)  # none of them knows the dense region
    cent, count = neighbours._split_hot(d, start, 150)
    assert sum(count.values()) == 1600 and max(count.values()) <= 300
    assert np.bincount((x @ cent.T).argmax(1)).max() <= 300 < np.bincount((x @ start.T).argmax(1)).max()


def test_within_against_table():
    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            q = [i]
            for j in range(1, len(b) + 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != b[j - 1])))
            p = q
        return p[-1]

    r = random.Random(6)
    for _ in range(800):
        a = "".join(r.choice("abc") for _ in range(r.randint(1, 50)))
        b = list(a)
        for _ in range(r.randint(0, 7)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randint(0, 1)] = r.choice(["", "a", "b"])
        b = "".join(b) or "a"
        near = lev(a, b) <= int(0.1 * max(len(a), len(b)))
        most = int(0.1 * max(len(a), len(b)))
        assert overlap.within(a, b, 0.1) == near == overlap.near_pairs([a], [b], 0.1)[0]
        if abs(len(a) - len(b)) <= most:
            short, long = sorted((a, b), key=len)
            assert overlap._by_diagonals(overlap.codes(short), overlap.codes(long), most) == near


def test_overlap_planted(spark):
    r = random.Random(7)
    rows, want = [], set()
    for i in range(60):
        q, a = sentence(r, 18)[:-1] + "?", " ".join(sentence(r, 14) for _ in range(3))
        rows.append((2 * i, q, a, True))
        if i % 3 == 0:  # words changed, case and marks too
            w = a.split()
            for k in range(0, len(w), 20):
                w[k] = "Changed"
            rows.append((2 * i + 1, q.upper(), " , ".join(w), False))
            want.add((2 * i, 2 * i + 1))
        elif i % 3 == 1:
            rows.append((2 * i + 1, q, " ".join(sentence(r, 14) for _ in range(3)), False))
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean")
    got = {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()}
    assert got == want


def test_overlap_deep_rounds(spark, monkeypatch):
    """A prefix shared by all rows is left to longer ones, and near pairs are still found."""
    monkeypatch.setattr(overlap, "MOST", 20)
    r = random.Random(8)
    head = " ".join(sentence(r, 14) for _ in range(2))
    rows = []
    for i in range(30):
        a = " ".join(sentence(r, 14) for _ in range(5))
        rows += [(2 * i, head, a, True), (2 * i + 1, head, a.replace("index", "Index "), False)]
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean")
    got = {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(30)}


EN, DE, FR = "The cache keeps every page that a reader asked for. ", "Der Speicher behält jede Seite, die ein Leser verlangt. ", "Le cache garde chaque page que le lecteur demande. "
ZH = "缓存会保存读者请求的每一页内容。"


def test_languages(spark):
    model = language.Model.fit([EN * 3, DE * 3, FR * 3, ZH * 3], ["en", "de", "fr", "zh"])
    rows = [("a", EN * 2, "en-US"), ("b", EN + ZH, "en"), ("c", DE, None), ("d", FR + "Cache", "French"), ("e", EN, "de"), ("f", EN + DE + ZH, "zh"), ("g", "12 34", None)]
    d = spark.createDataFrame(rows, "k string, t string, lab string")
    got = {(x.k, x.lang) for x in language.wrong_labels(language.document_languages(d, model, "k", "t"), d, "k", "lab").collect()}
    assert got == {("b", "en"), ("b", "zh"), ("c", "de"), ("e", "en"), ("f", "en"), ("f", "de"), ("f", "zh")}
    seg = [tuple(x)[1:4] for x in language.segment_languages(d.where("k = 'b'"), model, "k", "t").orderBy("start").collect()]
    assert [s[2] for s in seg] == ["en", "zh"] and seg[0][0] == 0 and seg[-1][1] == len(EN + ZH)


def test_labels():
    assert [language.label_code(x) for x in ("EN", "zh-Hans", " Français ", "n/a", None, "it")] == ["en", "zh", "fr", None, None, "it"]


def test_defects(spark):
    r = random.Random(9)
    model = language.Model.fit([EN * 3, DE * 3, FR * 3, ZH * 3, *(sentence(r) for _ in range(20))], ["en", "de", "fr", "zh", *["en"] * 20])
    good = [(i, "Answer.", sentence(r)[:-1] + "?", " ".join(sentence(r) for _ in range(3))) for i in range(100, 160)]
    rows = [
        (1, "Answer.", "Why?", "n/a"), (2, "Answer.", "Why is the cache slow?", "I'm sorry, but I can't help with that."), (3, "Answer.", "Why is the old cache slow today?", "Question: Why is the old cache slow today?"),
        (4, "Answer.", "Why is it slow?", EN + "The cache keeps eve"), (5, "Answer.", "Why does the cache keep every page?", ZH), (6, "Answer in Chinese.", "Why does the cache keep every page?", ZH),
        (7, "If unsure, reply only with: Out of scope", "Who are you?", "Out of scope"), (8, "Answer.", "Why is it slow?", "I can't put it more briefly: " + EN), (9, "List the terms.", EN, "cache, page, reader"), (10, EN, None, DE),
    ]
    d = spark.createDataFrame(rows + good, "row_id long, instruction string, input string, output string")
    got = {x.row_id: x.defect for x in pairs.broken_pairs(d, model).collect()}
    assert got == {1: "empty", 2: "refusal", 3: "copy", 4: "truncated", 5: "other_language", 10: "other_language"}


def test_stuffed_pages(spark):
    r = random.Random(10)
    rows = [(i, "\n".join(" ".join(sentence(r) for _ in range(3)) for _ in range(4))) for i in range(60)]
    for i in range(60, 90):
        k = [f"{r.choice(['cheap', 'best', 'buy', 'free'])} {r.choice(['cache', 'index', 'server'])}" for _ in range(60)]
        spamtext = [", ".join(k), "\n".join(f"http://shop{j}.example/{w.replace(' ', '-')}" for j, w in enumerate(k)), "\n".join(k)][i % 3]
        rows.append((i, sentence(r) + "\n" + spamtext))
    rows.append((90, " ".join(sentence(r) for _ in range(12)) + "\nSee also\n- http://docs.example/page"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in spam.stuffed_pages(d).collect()} == set(range(60, 90))


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(2)
    move = np.log(r.dirichlet(np.ones(4), 4))
    length = np.array([1, 5, 3])
    emit = r.normal(size=(9, 4))
    got, at = spam._viterbi(emit, move, length), 0
    for n in length:
        e = emit[at : at + n]
        best = max(itertools.product(range(4), repeat=n), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(got[at : at + n]) == best
        at += n


def test_mix_shares(spark):
    if not __import__("os").path.exists(VOCABULARY):
        pytest.skip("no vocabulary files here")
    r = random.Random(11)
    rows = [(i, sentence(r), s) for i, s in enumerate(["big"] * 600 + ["mid"] * 200 + ["small"] * 30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tg = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    m, s = mixing.mix(d, tg, VOCABULARY, rows_per_bucket=50)
    p = m.toPandas()
    assert p.groupby(["doc_id"]).size().max() <= 4 and not p.duplicated(["doc_id", "copy"]).any()
    assert p[p.source == "big"]["copy"].max() == 1
    assert all(abs(x.share - x.target_share) < 0.03 for x in s.collect())
    assert (p.finish.diff().dropna() >= 0).all()
    fixed, _ = mixing.mix(d, tg, VOCABULARY, budget=1000)
    assert 900 < fixed.agg(F.sum("tokens")).first()[0] <= 1000


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上个国到说们"])
def test_overlap_scattered_edits(spark, alphabet):
    """Edits of 5 to 10 % at random places, or one every ten characters, lose no pair; 12 % make none."""
    r = random.Random(12)
    rows, want = [], set()
    for i in range(120):
        n = r.choice([12, 25, 40, 60, 90, 150, 262, 430, 900])
        a = "".join(r.choice(alphabet) for _ in range(n))
        b, k = list(a), int(n * (0.05, 0.1, 0.1, 0.12)[i % 4])
        if i % 4 == 3:
            k += 2
        places = range(9, n, 10) if i % 4 == 1 else sorted(r.sample(range(n), k), reverse=True)
        for p in list(places)[:k]:
            b[p] = ("", r.choice(alphabet), b[p] + r.choice(alphabet))[1 if i % 4 == 1 else r.randrange(3)]
        b = "".join(b)
        rows += [(2 * i, a, "", True), (2 * i + 1, b, "", False)]
        if overlap.within(a, b, 0.1):
            want.add((2 * i, 2 * i + 1))
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean")
    got = {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()}
    assert got == want and 80 < len(want) < 120


def test_overlap_hot_template(spark):
    """Short near copies of one template, whose common head over 1,024 cross-split pairs share, are found."""
    r = random.Random(13)
    head, rows = "please answer the question on the local cache: ", []
    for i in range(40):
        tail = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(34))
        rows += [(2 * i, head, tail, True), (2 * i + 1, head, "0" + tail[1:17] + "1" + tail[18:], False)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and overlap.within(fold(a[1] + a[2]), fold(b[1] + b[2]), 0.1)}
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean")
    got = {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()}
    assert got == want and len(want) == 40


def test_every_confusion_makes_a_candidate():
    meets = lambda a, b: bool(set(scans.delete_keys(a)) & set(scans.delete_keys(b)))
    for w in ("{}quality", "cl{}imate", "turn{}ing", "li{}on", "ra{}dii", "corn{}er", "b{}ririlc"):
        for a, b in [*scans.PAIRS, *scans.SINGLES.items()]:
            assert meets(w.format(a), w.format(b)), (w, a, b)
    for read, word in (("folcler", "folder"), ("descnbe", "describe"), ("upclate", "update"), ("c1ick", "click"), ("qua1ity", "quality"), ("callbrate", "calibrate"), ("c|imate", "climate"), ("clirnb1ng", "climbing"), ("clescnbecl", "described")):
        assert meets(read, word) and scans.distance(read, word) <= 1, (read, word)


def test_copies_do_not_veto_a_repair(spark):
    """Copies of a page, and pages of one source with the same misread word, still have it repaired."""
    r = random.Random(14)
    plain = [(f"p{i}", " ".join(sentence(r, 20) for _ in range(3)) + " A quiet harbour lies near. All is well.", "a") for i in range(20)]
    page = "The old page keeps every short harb0ur near a local\ncache while some reader asks for more of that long\nquery and this server answers within one second."
    pages = [(f"c{i}", page, f"s{i}") for i in range(15)] + [(f"d{i}", page.replace("short harb0ur near", f"short wind0w {w}"), "b") for i, w in enumerate(WORDS[:15])]
    plain = [(k, t.replace("All is", "That window is wide. All is"), s) for k, t, s in plain]
    noise = scans.scan_noise(spark.createDataFrame(plain + pages, "unique_id string, page_content string, source string"))
    got = {(x.unique_id, x.fixed) for x in noise.where("kind = 'misread'").collect()}
    assert got == {(f"c{i}", "harbour") for i in range(15)} | {(f"d{i}", "window") for i in range(15)}


def test_trust_does_not_hang_on_the_size(spark):
    """Rare words are repaired to and left alone, rare compounds keep their hyphen, and a frequent misreading is told
    from a word by how often its look-alike stands."""
    r = random.Random(15)
    plain = [(f"p{i}", " ".join(sentence(r, 20) for _ in range(3)) + " The modern way goes on.", "a") for i in range(20)]
    plain += [(f"q{i}", "Some zirconium and a modem lie here. All is well.", "a") for i in range(2)] + [("r", "Every cold-rolled page lies here.", "a")]
    plain += [("s", "So " + "under that " * 700 + "page.", "a")] + [(f"t{i}", "So it lies uncler that page.", "a") for i in range(3)]
    page = "The old zirconlum keeps every short page near a cold-\nrolled cache while some reader asks a modem for more\nof that query uncler this server and answers within one\nsecond."
    noise = scans.scan_noise(spark.createDataFrame([*plain, ("scan", page, "b")], "unique_id string, page_content string, source string"))
    got = {(x.kind, x.form, x.fixed) for x in noise.where("unique_id = 'scan'").collect()}
    assert got == {("misread", "zirconlum", "zirconium"), ("misread", "uncler", "under"), ("hyphen", "coldrolled", "cold-rolled")}


def test_neighbours_recall_with_many_shards(spark):
    """Every vector's 5 most similar ones are found where 50 shards part a thin cloud."""
    x = np.random.default_rng(3).normal(size=(4000, 16))
    d = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.most_similar(d, shard_size=80).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(len(u)) for j in np.argsort(-s[i])[:5]}
    assert len(true & set(zip(got.vec_id, got.neighbour))) / len(true) > 0.9


def test_neighbours_of_equal_cosine(spark):
    """Among twelve directions as near as each other the smallest keys are the neighbours."""
    rows = [(1, [1.0] + [0.0] * 12)] + [(2 + i, [1.0] + [float(j == i) for j in range(12)]) for i in range(12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.most_similar(d).where("vec_id = 1").orderBy("rank").collect()
    assert [x.neighbour for x in got] == [2, 3, 4, 5, 6]


def test_results_beside_the_cases_are_queries(spark):
    from folioweave.llm import queries

    path, q = "/root/testdata/sf0.001", queries.queries()
    if not __import__("os").path.isdir(path):
        pytest.skip("no test data here")
    keys = {"p1_repaired": ["unique_id"], "p2_rates": ["source"], "p3_pieces": ["unique_id", "piece_no"], "p5_report": ["split", "dataset"], "p7_segments": ["table_name", "row_key", "start"]}
    for name, key in keys.items():
        got = q[name](spark, path).select(*key).toPandas()
        assert len(got) and not got.duplicated().any(), name


def test_neighbours_in_usual_shards_are_exact(spark):
    """A shard of usual size is compared whole; graphs give nearly the same."""
    x = np.random.default_rng(8).normal(size=(1500, 64))
    d = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j, k + 1) for i in range(len(u)) for k, j in enumerate(np.argsort(-s[i])[:5])}
    got = neighbours.most_similar(d).toPandas()
    assert set(zip(got.vec_id, got.neighbour, got["rank"])) == true
    graphs = neighbours.most_similar(d, exact=0).toPandas()
    assert len({(i, j) for i, j, _ in true} & set(zip(graphs.vec_id, graphs.neighbour))) / len(true) > 0.6


def test_compared_shards_meet_both_ways():
    """Asked rows find indexed ones and indexed rows asked ones; of equal cosines the smaller rows stay."""
    r = np.random.default_rng(9)
    x = np.concatenate([r.integers(-1, 2, (300, 6)), r.normal(size=(500, 6))])
    x = np.unique(x[np.abs(x).sum(1) > 0] / np.linalg.norm(x[np.abs(x).sum(1) > 0], axis=1, keepdims=True), axis=0).astype(np.float32)
    x = x[r.permutation(len(x))]
    for m in (0, 1, 3, 4, 7, 200):
        where = np.sort(r.choice(len(x), m, replace=False))
        s = np.round(x.astype(float) @ x.T.astype(float), 9)
        np.fill_diagonal(s, -9)
        s[np.ix_(*[np.setdiff1d(np.arange(len(x)), where)] * 2)] = -9  # two that are only asked do not meet
        want = {(i, j) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:4] if s[i, j] > -9}
        a, b, _ = neighbours._compare(x, where, 4, at_once=64, hold=1000)
        assert set(zip(a.tolist(), b.tolist())) == want


def test_overlap_in_blocks(spark, monkeypatch):
    """Seeds are neither written nor shuffled; any division into blocks and meetings finds the same pairs."""
    r = random.Random(12)
    words = ["index", "cache", "ranking", "词项", "vector", "page", "文档", "query", "margin", "fusion"]
    rows = []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(2, 40)))
        n = list(t)
        for _ in range(r.randint(0, len(t) // 9)):
            n[r.randrange(len(n))] = r.choice("abc文")
        rows += [(2 * i, t, "", True), (2 * i + 1, "".join(n), "", False)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and overlap.within(fold(a[1] + a[2]), fold(b[1] + b[2]), 0.1)}
    d = spark.createDataFrame(rows, "row_id long, input string, output string, is_eval boolean")
    write, written = overlap.materialize, []
    monkeypatch.setattr(overlap, "materialize", lambda df, tag="t": written.append((tag, write(df, tag))) or written[-1][1])
    got = {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()}
    assert got == want and len(want) > 20
    assert max(t.count() for _, t in written) <= len(rows)
    monkeypatch.setattr(overlap, "BLOCK", (900, 900))
    assert {(x.eval_key, x.train_key) for x in overlap.cross_split_overlaps(d).collect()} == want
    assert sum(tag == "links" for tag, _ in written) > 5


def test_meetings_are_counted_by_whole_texts(monkeypatch):
    import pyarrow as pa

    r = random.Random(13)
    base = "".join(r.choice("abcdefgh") for _ in range(90))
    near = lambda: "".join(c if r.random() > 0.06 else r.choice("xyz") for c in base)
    ev, tr = [near() for _ in range(12)], [near() for _ in range(15)] + ["", "ab"]
    often = np.zeros(1 << 10, np.int32)
    seeds = [(k, i, a) for i, f in enumerate(ev) for _, at, keys in overlap.asked_keys(f, 0.1, often) for k, a in zip(keys.view(np.int64), at)]
    rows = pa.table({n: pa.array([x[j] for x in seeds], pa.int64()) for j, n in enumerate(("h", "e", "at"))})
    asked = overlap.Asked(rows, pa.table({"id": pa.array(range(len(ev)), pa.int64()), "f": ev}))
    want = {(i, j) for i, a in enumerate(ev) for j, b in enumerate(tr) if overlap.within(a, b, 0.1)}
    for most in (1, 100, 1 << 21):
        monkeypatch.setattr(overlap, "MEETINGS", most)
        got = [(int(a), int(b)) for e, t in asked.near(np.arange(len(tr)) + 100, tr, 0.1) for a, b in zip(e, t)]
        assert set(got) == want and len(got) == len(want) > 5
