"""Queries on page layout, chunks and whole retrieval chains. Their SQL holds its own literals."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import chunking, crosspage, fusion, layout, scorers, search
from ..session import materialize, table
from .catalogue import _BM25, _LUCENE, _TOP5, STORE, VECTORS, WS, _collapse, _tokens, query, store, vectors
from .passages import _CAP, strip

#: Every stored record as a page of its source, its lines as blocks on a page of fixed height.
HEIGHT = 480.0


def _blocks(spark, d):
    return layout.with_gaps(layout.blocks_of_lines(store(spark, d), "text", F.col("source"), F.col("uid"), page_height=HEIGHT))


_HEADING = "(length(s) > 0 AND length(s) <= 150 AND (regexp_matches(s, '^\\d+(\\.\\d+)*\\s+[A-Z]|^(Chapter|CHAPTER)\\s+\\d|^(Appendix|APPENDIX)\\s+[A-Z0-9]|^(Figure|Table)\\s+\\d+(\\.\\d+)?($|[^a-zA-Z0-9_])|^(References|REFERENCES|Bibliography|BIBLIOGRAPHY|Index|INDEX)$') OR (len(regexp_extract_all(s, '\\pL')) BETWEEN 1 AND 40 AND len(regexp_extract_all(s, '\\p{Lu}')) > 0.75 * len(regexp_extract_all(s, '\\pL')))))"
_PAGENO = "regexp_matches(line, '(?i)^(\\d+|page\\s+\\d+|page\\s+\\d+\\s+of\\s+\\d+|-\\s*\\d+\\s*-|\\[\\d+\\]|\\d+\\s*/\\s*\\d+|p\\.\\s*\\d+|page\\s*[ivxlcdm]+|[ivxlcdm]+)$')"
BLOCKS = f"""l AS (SELECT source, uid AS page_no, string_split(text, chr(10)) AS ls FROM store WHERE text IS NOT NULL), b0 AS (SELECT source, page_no, unnest(ls) AS text, unnest(range(0, len(ls))) AS k FROM l),
 b1 AS (SELECT *, {_collapse('text')} AS line, {strip('text')} AS s, 12.0::DOUBLE * k AS y0, 12.0::DOUBLE * k + 12 AS y1 FROM b0 WHERE trim(text, ' ') <> ''),
 b AS (SELECT *, CASE WHEN {_HEADING} THEN 14.0 ELSE 10.0 END AS font, greatest(0, coalesce(y0 - lag(y1) OVER w, 0)) AS ga, greatest(0, coalesce(lead(y0) OVER w - y1, 0)) AS gb, y0 / 480 AS top, y1 / 480 AS bottom, length(line) AS n, len(regexp_extract_all(text, '[^' || substr('{WS}', 2, length('{WS}') - 2) || ']+')) AS words, {_PAGENO} AS pn FROM b1 WINDOW w AS (PARTITION BY source, page_no ORDER BY k))"""
_BAND = """r AS (SELECT source, coalesce(max(n) FILTER (h), 120) AS head_len, coalesce(max(words) FILTER (h), 20) AS head_words, coalesce(median(gb / 480) FILTER (h), 0.005) AS head_gap, avg((top + bottom) / 2) FILTER (h) AS head_y,
 coalesce(max(n) FILTER (f), 120) AS foot_len, coalesce(max(words) FILTER (f), 20) AS foot_words, avg((top + bottom) / 2) FILTER (f) AS foot_y FROM (SELECT *, top <= 0.2 AND n > 0 AND NOT pn AND n <= 200 AND words <= 30 AS h, bottom >= 0.88 AND n BETWEEN 1 AND 120 AS f FROM b) GROUP BY source)"""


@query(f"WITH {STORE}, {BLOCKS} SELECT source, page_no, count(*) AS blocks, sum(ga) AS gaps FROM b GROUP BY ALL")
def page_gaps(spark, d):
    return _blocks(spark, d).groupBy("source", "page_no").agg(F.count("*").alias("blocks"), F.sum("gap_above").alias("gaps"))


@query(f"WITH {STORE}, {BLOCKS}, {_BAND} SELECT source, head_len, head_words, round(head_gap, 6) AS head_gap, round(head_y, 6) AS head_y, foot_len, foot_words, round(foot_y, 6) AS foot_y FROM r")
def learned_bands(spark, d):
    """Bands are learned by source from all its pages."""
    r = layout.learn_bands(_blocks(spark, d), by=("source",))
    return r.select("source", "head_len", "head_words", F.round("head_gap", 6).alias("head_gap"), F.round("head_y", 6).alias("head_y"), "foot_len", "foot_words", F.round("foot_y", 6).alias("foot_y"))


_KIND = "CASE WHEN (top <= 0.2 OR bottom >= 0.88) AND n > 0 AND pn THEN 'page_number' WHEN top <= 0.2 AND n > 0 AND n <= greatest(160, floor(head_len * 1.2)) AND words <= greatest(24, floor(head_words * 1.2)) THEN 'header' WHEN bottom >= 0.88 AND n > 0 AND ((n <= 160 AND words <= 25) OR contains(lower(text), 'copyright')) THEN 'footer' END"


@query(f"WITH {STORE}, {BLOCKS}, {_BAND} SELECT source, furniture, count(*) AS n FROM (SELECT b.source, {_KIND} AS furniture FROM b JOIN r ON b.source = r.source) GROUP BY ALL")
def furniture_blocks(spark, d):
    b = materialize(_blocks(spark, d).where("source is not null"), "blocks")
    return layout.furniture(b, layout.learn_bands(b, by=("source",)), ("source",), ("copyright",)).groupBy("source", "furniture").agg(F.count("*").alias("n"))


_FONTS = "bf AS (SELECT source, page_no, coalesce(median(font) FILTER (length(text) > 3), 10.0) AS body FROM b GROUP BY ALL)"


@query(f"WITH {STORE}, {BLOCKS}, {_FONTS}, g AS (SELECT source, page_no, coalesce(median(ga) FILTER (ga > 0 AND ga <= 24), 5.76) AS gap FROM b GROUP BY ALL) SELECT source, page_no, body AS body_font, round(gap, 6) AS line_gap FROM bf JOIN g USING (source, page_no)")
def page_fonts_and_gaps(spark, d):
    b = materialize(_blocks(spark, d).where("source is not null"), "blocks")
    return layout.body_font(b).join(layout.line_gap(b), ["source", "page_no"]).select("source", "page_no", "body_font", F.round("line_gap", 6).alias("line_gap"))


_UNITS = f"""ut AS (SELECT b.*, CASE WHEN regexp_matches(line, {_CAP}) THEN 'caption' WHEN font >= 1.2 * body AND words <= 20 THEN 'heading' WHEN regexp_matches(line, '^(\\d+\\.\\s+.+|\\[\\d+\\]\\s+.+|\\d+\\s+[A-Z].+)') AND y1 >= 0.78 * 480 AND font <= 0.88 * body THEN 'footnote' ELSE 'body' END AS unit_type FROM b JOIN bf USING (source, page_no)),
 uc AS (SELECT *, CASE WHEN unit_type = lag(unit_type) OVER w AND unit_type IN ('body', 'heading', 'footnote') THEN 0 ELSE 1 END AS c FROM ut WINDOW w AS (PARTITION BY source, page_no ORDER BY k)),
 un AS (SELECT *, sum(c) OVER (PARTITION BY source, page_no ORDER BY k) - 1 AS unit_no FROM uc)"""


def _units(spark, d):
    b = _blocks(spark, d).where("source is not null")
    return layout.merge_units(layout.unit_types(b, layout.body_font(b)))


@query(f"WITH {STORE}, {BLOCKS}, {_FONTS}, {_UNITS} SELECT source, page_no, CAST(unit_no AS BIGINT) AS unit_no, unit_type, CAST(count(*) AS INT) AS blocks, md5(string_agg(trim(text, ' '), chr(10) ORDER BY k)) AS text FROM un GROUP BY source, page_no, unit_no, unit_type")
def merged_units(spark, d):
    return _units(spark, d).select("source", "page_no", "unit_no", "unit_type", "blocks", F.md5("text").alias("text"))


@query(f"WITH {STORE}, {BLOCKS} SELECT source, page_no, count(*) AS kept FROM b WHERE NOT (source IS NOT NULL AND EXISTS (SELECT 1 FROM b r WHERE r.source = b.source AND r.page_no = b.page_no AND r.k % 5 = 0 AND r.n > 20 AND least(r.y1, b.y1) - greatest(r.y0, b.y0) >= 6)) GROUP BY ALL")
def blocks_outside_regions(spark, d):
    b = materialize(_blocks(spark, d), "blocks")
    wide = b.where((F.col("block_no") % 5 == 0) & (F.length(tx.collapse("text")) > 20)).select("source", "page_no", F.lit(0.0).alias("x0"), "y0", F.lit(1e6).alias("x1"), "y1").where("source is not null")
    return layout.outside_regions(b, wide).groupBy("source", "page_no").agg(F.count("*").alias("kept"))


@query(f"WITH {STORE}, {BLOCKS}, v AS (SELECT source, page_no, row_number() OVER (PARTITION BY source, page_no ORDER BY k) - 1 AS line_no, line, k FROM b WHERE n > 0) SELECT source, page_no, CAST(line_no AS INT) AS line_no, md5(CASE WHEN n2 > 1 THEN {_collapse('a')} || ' ' || {_collapse('z')} ELSE line END) AS text, y0 FROM (SELECT *, length(line) AS n2, substr(line, 1, length(line) // 2) AS a, substr(line, length(line) // 2 + 1) AS z, 12.0::DOUBLE * k AS y0 FROM v) WHERE {_collapse('a')} <> '' OR n2 = 1")
def visual_lines(spark, d):
    """Lines that were parsed in two fragments each, put together again; fragments are halves of the lines."""
    b = _blocks(spark, d).withColumn("t", tx.collapse("text"))
    n = F.floor(F.length("t") / 2).cast("int")
    a = b.withColumn("text", F.substr("t", F.lit(1), n)).withColumn("x1", F.lit(50.0))
    z = b.withColumn("text", F.substr("t", n + 1)).withColumn("x0", F.lit(60.0)).withColumn("x1", F.lit(100.0))
    return layout.visual_lines(a.unionByName(z)).select("source", "page_no", "line_no", F.md5("text").alias("text"), "y0")


@query(f"""WITH {STORE}, {BLOCKS}, o AS (SELECT source, page_no, k, line, regexp_matches(line, {_CAP}) AS cap FROM b), i AS (SELECT *, count(*) FILTER (cap) OVER (PARTITION BY source, page_no ORDER BY k) AS c, k - row_number() OVER (PARTITION BY source, page_no ORDER BY k) AS run FROM o),
 h AS (SELECT source, page_no, c, min(k) AS k0, min(run) AS run0 FROM i WHERE cap GROUP BY ALL) SELECT source, page_no, md5(string_agg(line, ' ' ORDER BY k)) AS text, CAST(count(*) AS INT) AS lines FROM i JOIN h USING (source, page_no, c) WHERE run = run0 AND k BETWEEN k0 AND k0 + 8 GROUP BY source, page_no, c""")
def caption_regions(spark, d):
    """Captions with the lines that follow them without a blank one between, eight at most."""
    b = materialize(_blocks(spark, d).where("source is not null"), "blocks")
    gaps = b.select("source", "page_no").distinct().withColumn("line_gap", F.lit(1.0))
    lines = layout.visual_lines(b).withColumn("page_height", F.lit(100.0))
    return layout.caption_regions(lines, gaps).select("source", "page_no", F.md5("text").alias("text"), "lines")


#: Every seventh line of a record is numbered and small here, and the two after it are small.
_NOTES = f"nl AS (SELECT source, page_no, k, {_collapse("CASE WHEN k % 7 = 3 THEN '12. ' || text ELSE text END")} AS t, k % 7 IN (3, 4, 5) AS small, k % 7 = 3 AS apart FROM b WHERE n > 0), ni AS (SELECT *, small AND apart AND regexp_matches(t, '^(\\d+\\.\\s+.+|\\[\\d+\\]\\s+.+|\\d+\\s+[A-Z].+)') AS begins, small AND length(t) >= 8 AS goes FROM nl), na AS (SELECT source, page_no, min(k) FILTER (begins) AS st FROM ni GROUP BY ALL), nb AS (SELECT ni.*, st, count(*) FILTER (k > st AND NOT goes) OVER (PARTITION BY ni.source, ni.page_no ORDER BY k) AS stops FROM ni JOIN na ON ni.source IS NOT DISTINCT FROM na.source AND ni.page_no = na.page_no)"


@query(f"WITH {STORE}, {BLOCKS}, {_NOTES} SELECT source, page_no, md5(coalesce(string_agg(t, ' ' ORDER BY k) FILTER (st IS NULL OR k < st), '')) AS body, md5(string_agg(t, ' ' ORDER BY k) FILTER (k = st OR (k > st AND stops = 0))) AS footnote FROM nb GROUP BY source, page_no")
def split_footnotes(spark, d):
    """Records as one block each, all of it in the foot of the page."""
    b, k = _blocks(spark, d), F.col("block_no")
    lines = b.select(
        "source", "page_no", F.lit(0).alias("block_no"), F.when(k % 7 == 3, F.concat(F.lit("12. "), F.col("text"))).otherwise(F.col("text")).alias("text"), "y0", F.lit(95.0).alias("y1"),
        F.when(k % 7 == 3, 5.0).otherwise(0.0).alias("gap_above"), F.when((k % 7).isin(3, 4, 5), 8.0).otherwise(10.0).alias("font"), F.lit(100.0).alias("page_height"), F.lit(10.0).alias("body_font"), F.lit(1.0).alias("line_gap"),
    ).where(F.length(tx.collapse(b["text"])) > 0)
    return layout.split_footnotes(lines).select("source", "page_no", F.md5("body").alias("body"), F.md5("footnote").alias("footnote"))


@query(f"WITH {STORE} SELECT uid, CAST(coalesce(orig_page_no, page_no, CASE WHEN regexp_matches(source, '^\\d+$') THEN CAST(source AS INT) END, 7) AS INT) AS page FROM store")
def cited_pages(spark, d):
    return store(spark, d).select("uid", layout.first_page(F.col("orig_page_no"), F.col("page_no"), F.col("source"), F.lit(" 7 ")).alias("page"))


@query(f"WITH {STORE}, {BLOCKS} SELECT source, page_no, round(avg(font), 6) AS avg_font, max(font) AS max_font, count(*) AS lines FROM b GROUP BY ALL")
def block_fonts(spark, d):
    f = layout.block_fonts(_blocks(spark, d), ("source", "page_no"))
    return f.select("source", "page_no", F.round("avg_font", 6).alias("avg_font"), "max_font", "lines")


_FIG = f"""cl AS (SELECT uid, page_no, {_collapse('line')} AS line FROM (SELECT uid, page_no, unnest(string_split(text, chr(10))) AS line FROM store)), cf AS (SELECT *, (CASE WHEN lower(line) LIKE '%table%' AND regexp_matches(line, '(?i)^[^a-z]*table') THEN 'Table ' ELSE 'Figure ' END) || regexp_extract(line, '(?i)\\b(?:figure|fig\\.?|table)\\s+(\\d+(?:\\.\\d+)*)\\b', 1) AS label FROM cl WHERE regexp_matches(line, '(?i)^(figure|fig\\.?|table)\\s+\\d+(\\.\\d+)*\\b')),
 fi AS (SELECT label, arg_min(line, (coalesce(page_no, 1000000000), line)) AS caption, arg_min(uid, (coalesce(page_no, 1000000000), line)) AS u FROM cf GROUP BY label)"""


def _captioned(spark, d):
    s = store(spark, d).select("uid", "page_no", F.explode(F.split("text", "\n")).alias("text"))
    return s.where(tx.starts_caption("text")).withColumn("image_path", F.lit(None).cast("string"))


@query(f"WITH {STORE}, {_FIG} SELECT label, caption FROM fi")
def figure_index(spark, d):
    return layout.figure_index(_captioned(spark, d)).select("label", "caption")


@query(f"""WITH {STORE}, {_FIG}, m AS (SELECT uid, generate_subscripts(f, 1) AS i, unnest(f) AS ref FROM (SELECT uid, regexp_extract_all({_collapse("coalesce(text, '')")}, '(?i)\\b(?:figure|fig\\.?|table)\\s+\\d+(?:\\.\\d+)*\\b') AS f FROM store)),
 r AS (SELECT uid, (CASE WHEN lower(ref) LIKE 'table%' THEN 'Table ' ELSE 'Figure ' END) || regexp_extract(ref, '(\\d+(?:\\.\\d+)*)$', 1) AS label, min(i) AS i FROM m GROUP BY ALL), t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY uid ORDER BY i) <= 8)
SELECT uid, CAST(count(*) AS INT) AS figures, string_agg(label, '|' ORDER BY i) AS labels FROM t JOIN fi USING (label) GROUP BY uid""")
def figures_in_context(spark, d):
    """Texts with captions behind their references; the figures that were found for each."""
    x = chunking.with_captions(store(spark, d).select("uid", "text"), layout.figure_index(_captioned(spark, d)), "uid").where("figures is not null")
    return x.select("uid", F.size("figures").alias("figures"), F.array_join(F.transform("figures", lambda f: f["label"]), "|").alias("labels"))


@query(f"WITH {STORE}, x AS (SELECT source, uid, page_no, orig_page_no FROM store) SELECT source, uid, CAST(row_number() OVER (PARTITION BY source ORDER BY coalesce(orig_page_no, 1000000000), coalesce(page_no, 1000000000), uid) - 1 AS INT) AS place FROM x")
def page_order(spark, d):
    s = store(spark, d).select("source", "uid", "page_no", "orig_page_no")
    return crosspage.page_order(s, tie="uid").select("source", "uid", "place")


@query()
def semantic_chunks(spark, d):
    """Chunks of all pages; SQL has no folds, so tests compare them with a plain version."""
    page = ["source", "page_no"]
    n = materialize(chunking.nodes(_units(spark, d), page), "nodes")
    c = chunking.cuts(materialize(chunking.boundaries(n, page), "bounds"), page)
    return chunking.chunks(n, c, page).select("source", "page_no", "chunk", "n_nodes", "words", "chunk_id")


@query()
def children_of_parents(spark, d):
    """Parents and overlapping children of all records; the recursive splitter is tested against its limits."""
    return chunking.parents_and_children(store(spark, d), "text", "source", "page_no").select("uid", "parent_id", "level", F.length("text").alias("n"))


@query()
def cross_page_units(spark, d):
    """Units of all pages joined where they go on; a fixpoint, so no SQL. Rows without a page come last in their source."""
    w = Window.partitionBy("source", "page_no").orderBy("uid")
    kind = F.when(tx.starts_caption("text"), "caption").when(tx.looks_like_heading(F.split_part(tx.stripped("text"), F.lit("\n"), F.lit(1))), "heading").otherwise("body")
    u = store(spark, d).where("text is not null").select("source", "page_no", (F.row_number().over(w) - 1).alias("unit_no"), kind.alias("unit_type"), "text")
    return crosspage.merge_across_pages(u).select("source", "page_no", "unit_no", "unit_type", F.length("text").alias("n"), F.size("pages").alias("pages"))


# --- retrieval from end to end -----------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(embedding[16 * i + 1:16 * i + 16] AS DOUBLE[]) AS v FROM embeddings, range(0, 4) r(i)), m AS (SELECT q.vec_id AS query, c.vec_id AS doc, q.i, max(list_dot_product(q.v, c.v)) AS m FROM p q JOIN p c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
 s AS (SELECT query, doc, round(avg(m), 6) AS score FROM m GROUP BY ALL) """ + _TOP5)  # fmt: skip
def late_interaction(spark, d):
    """Every fourth of a vector stands for a token's vector; the queries meet all documents, by blocks of queries."""
    e = table(spark, d, "embeddings")
    return search.late_interaction_top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec")), "vec_id", "embedding", 5, 16)


def _chain() -> str:
    """The BM25 tables over the stored records, asked by the first 60 characters of records of the vector queries."""
    base = _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="")
    base = base.replace(f"SELECT doc_id, 'all' AS lang, {_tokens('text')} AS toks FROM documents", f"SELECT uid AS doc_id, 'all' AS lang, {_tokens('text')} AS toks FROM store")
    return base.replace(f"SELECT sample_id AS query, 'all' AS lang, unnest(list_distinct({_tokens('question')})) AS term FROM eval_inputs", f"SELECT query, 'all' AS lang, unnest(list_distinct({_tokens('question')})) AS term FROM qs")


_ASK = "qs AS (SELECT v.vec_id AS query, substr(coalesce(s.text, ''), 1, 60) AS question, v.embedding FROM vecs v JOIN store s ON v.unique_id = s.uid WHERE v.vec_id % 20 = 0 AND v.embedding IS NOT NULL)"


@query(f"""WITH {STORE}, {VECTORS}, {_ASK}, {_chain()},
 b5 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 5),
 dv AS (SELECT q.query, v.vec_id, v.unique_id AS doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM qs q JOIN vecs v ON v.vec_id <> q.query AND v.embedding IS NOT NULL),
 v5 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM dv QUALIFY rank <= 5), h AS (SELECT query, doc, rank, 0 AS l FROM v5 UNION ALL SELECT query, doc, rank, 1 FROM b5),
 pr AS (SELECT h.query, coalesce(p.uid, h.doc) AS parent, h.l, h.rank FROM h LEFT JOIN store c ON h.doc = c.uid LEFT JOIN store p ON c.parent_id = p.uid), pm AS (SELECT query, parent, l, min(rank) AS best FROM pr GROUP BY ALL), pp AS (SELECT *, row_number() OVER (PARTITION BY query, l ORDER BY best, parent) AS pos FROM pm),
 mg AS (SELECT * FROM pp QUALIFY row_number() OVER (PARTITION BY query, parent ORDER BY l, pos) = 1), rk AS (SELECT query, parent, row_number() OVER (PARTITION BY query ORDER BY l, pos, parent) AS rank FROM mg),
 tk AS (SELECT rk.query, rk.parent, rk.rank, list_distinct({_tokens('qs.question')}) AS q, list_distinct({_tokens('t.text')}) AS d FROM rk JOIN qs USING (query) JOIN store t ON t.uid = rk.parent), sc AS (SELECT query, parent, rank, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, d)) / len(q) ELSE 0 END, 6) AS new_score FROM tk)
SELECT query, parent AS doc, new_score, CAST(row_number() OVER (PARTITION BY query ORDER BY new_score DESC, rank) AS INT) AS new_rank FROM sc QUALIFY new_rank <= 5""")  # fmt: skip
def retrieved_parents(spark, d):
    """The whole chain: vector hits and BM25 hits on records, both as parents, merged, scored against the question, cut."""
    s, v = materialize(store(spark, d).select("uid", "text", "parent_id"), "store"), vectors(spark, d)
    q = v.where("vec_id % 20 = 0 and embedding is not null").join(s.select("uid", "text"), F.col("unique_id") == F.col("uid"))
    q = materialize(q.select(F.col("vec_id").alias("query"), F.substring(F.coalesce("text", F.lit("")), 1, 60).alias("question"), F.col("embedding").alias("qvec")), "questions")
    dense = search.dense_top_k(v, q, "vec_id", "embedding", 5).join(v.select(F.col("vec_id").alias("doc"), "unique_id"), "doc").select("query", F.col("unique_id").alias("doc"), "rank")
    words = search.bm25(search.Postings(s, "uid", "text"), q, "query", "question", 5).select("query", "doc", "rank")
    lists = [fusion.to_parents(x, s.select("uid", "parent_id")).select("query", "parent", F.col("rank").alias("pos")) for x in (dense, words)]
    hits = fusion.merge_results(lists, "parent").select("query", "parent", "rank").join(q.select("query", "question"), "query").join(s.select(F.col("uid").alias("parent"), "text"), "parent")
    return search.rerank(hits, F.round(scorers.get("score")(F.col("question"), F.col("text")), 6), 5).select("query", F.col("parent").alias("doc"), "new_score", "new_rank")


_STOPPED = _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="").replace(_tokens("text"), f"list_filter({_tokens('text')}, lambda w: w NOT IN ('the', 'of', 'and'))").replace(_tokens("question"), f"list_filter({_tokens('question')}, lambda w: w NOT IN ('the', 'of', 'and'))")


@query(f"WITH {_STOPPED} {_TOP5}")
def bm25_without_stop_words(spark, d):
    """The index is saved, loaded again and asked, all without stop words."""
    from ..session import scratch_root

    stops = ["The", "of", "and"]
    index = search.Postings(table(spark, d, "documents"), "doc_id", "text", stops=stops)
    path = f"{scratch_root(spark)}/fw-saved-{abs(hash(d))}"
    index.save(path)
    return search.bm25(search.Postings.load(spark, path), table(spark, d, "eval_inputs"), "sample_id", "question", 5, tokens=lambda c: tx.without_stops(tx.search_tokens(c), stops))

