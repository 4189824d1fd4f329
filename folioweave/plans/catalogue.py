"""Registry of the engine's named queries: each with its plan and, where SQL can say it, the same query for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import datasets, finetune, fusion, layout, losses, metrics, scorers, search
from ..session import table
from ..streaming import jobs

FLAGSHIP = "bm25_eval_questions"
ALPACA = "train_round2_residual_fix_alpaca"
_Q: dict = {}
_SQL: dict = {}

#: White space as (?U)\s means it, for RE2.
WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name."""

    def add(fn):
        _Q[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict:
    return dict(_SQL)


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return (
        f"list_concat(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[一-鿿]+'), "
        "lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END)))"
    )


def _script(x: str) -> str:
    return f"CASE WHEN len(regexp_extract_all(coalesce({x}, ''), '[一-鿿]')) > len(regexp_extract_all(coalesce({x}, ''), '[A-Za-z]')) THEN 'zh' ELSE 'en' END"


def _route(label: str, x: str) -> str:
    return f"CASE WHEN coalesce(lower(trim({label})), '') = '' THEN {_script(x)} WHEN lower(trim({label})) LIKE 'zh%' THEN 'zh' ELSE 'en' END"


#: manual_info without second deliveries, flat.
STORE = """store AS (SELECT unique_id AS uid, page_content AS text, metadata.parent_id AS parent_id, metadata.chunk_level AS level, metadata.source AS source,
  metadata.page_no AS page_no, metadata.orig_page_no AS orig_page_no, metadata.lang AS lang, metadata.content_hash AS content_hash
  FROM manual_info QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ingested_at) = 1)"""


def store(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manual_info")
    flat = m.select(
        F.col("unique_id").alias("uid"), F.col("page_content").alias("text"), *[F.col(f"metadata.{c}").alias(n) for c, n in (
            ("parent_id", "parent_id"), ("chunk_level", "level"), ("source", "source"), ("page_no", "page_no"), ("orig_page_no", "orig_page_no"), ("lang", "lang"), ("content_hash", "content_hash"))],
        "ingested_at",
    )
    return fusion.first_of(flat, ["uid"], ["ingested_at"]).drop("ingested_at")


VECTORS = "vecs AS (SELECT vec_id, unique_id, embedding, sparse, source FROM vector_rows QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ingested_at) = 1)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_of(table(spark, d, "vector_rows"), ["vec_id"], ["ingested_at"]).drop("ingested_at")


ROWS = f"inst AS (SELECT * EXCLUDE (ingested_at) FROM {ALPACA} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"


def instructions(spark: SparkSession, d: str) -> DataFrame:
    return fusion.first_of(table(spark, d, ALPACA), ["row_id"], ["ingested_at"]).drop("ingested_at")


# --- scans, sources, joins --------------------------------------------------------------------------------------
@query(f"WITH {STORE} SELECT uid, parent_id, level, source, page_no, length(text) AS n FROM store WHERE page_no BETWEEN 5 AND 20")
def scan_page_range(spark, d):
    return layout.page_range(store(spark, d), 5, 20).select("uid", "parent_id", "level", "source", "page_no", F.length("text").cast("long").alias("n"))


@query(f"WITH {STORE} SELECT c.uid, coalesce(p.uid, c.uid) AS doc, length(coalesce(p.text, c.text)) AS n FROM store c LEFT JOIN store p ON c.parent_id = p.uid WHERE c.level = 'child'")
def child_to_parent(spark, d):
    s = store(spark, d)
    p = s.select(F.col("uid").alias("p"), F.col("text").alias("pt"))
    j = s.where("level = 'child'").join(p, F.col("parent_id") == F.col("p"), "left")
    return j.select("uid", F.coalesce("p", "uid").alias("doc"), F.length(F.coalesce("pt", "text")).cast("long").alias("n"))


@query(f"WITH {STORE}, {VECTORS} SELECT v.vec_id, s.uid, s.level, v.source AS index_source, s.source FROM vecs v JOIN store s ON v.unique_id = s.uid")
def index_with_store(spark, d):
    v = vectors(spark, d).withColumnRenamed("source", "index_source")
    return v.join(store(spark, d), F.col("unique_id") == F.col("uid")).select("vec_id", "uid", "level", "index_source", "source")


@query(f"WITH {STORE}, {VECTORS} SELECT uid FROM store WHERE level = 'parent' AND uid NOT IN (SELECT unique_id FROM vecs)")
def not_indexed(spark, d):
    return fusion.remaining(store(spark, d).where("level = 'parent'"), [vectors(spark, d).select(F.col("unique_id").alias("uid"))], "uid").select("uid")


@query("""WITH new AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h FROM documents WHERE source = 'web_crawl' OR doc_id % 10 = 0),
old AS (SELECT doc_id, source, md5('old') AS h FROM documents)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)""")
def upsert_documents(spark, d):
    x = table(spark, d, "documents")
    old = x.select("doc_id", "source", F.md5(F.lit("old")).alias("h"))
    new = x.where((F.col("source") == "web_crawl") | (F.col("doc_id") % 10 == 0)).select("doc_id", "source", tx.text_id("text").alias("h"))
    return fusion.upsert(old, new, "doc_id")


@query("""SELECT doc_id AS uid, source, 0 AS version FROM documents WHERE source <> 'web_crawl'
UNION ALL SELECT doc_id, source, 1 FROM documents WHERE source = 'web_crawl' AND text IS NOT NULL""")
def sync_one_source(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "source", F.lit(0).alias("version"), F.lit(0).alias("pos"))
    new = table(spark, d, "documents").where("source = 'web_crawl' and text is not null").select(F.col("doc_id").alias("uid"), "source", F.lit(1).alias("version"), F.col("doc_id").cast("int").alias("pos"))
    return fusion.sync_source(x, new, "web_crawl")[0].select("uid", "source", "version")


@query("SELECT doc_id AS uid FROM documents WHERE source = 'web_crawl' AND text IS NULL")
def stale_after_sync(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "source", F.lit(0).alias("version"), F.lit(0).alias("pos"))
    new = table(spark, d, "documents").where("source = 'web_crawl' and text is not null").select(F.col("doc_id").alias("uid"), "source", F.lit(1).alias("version"), F.col("doc_id").cast("int").alias("pos"))
    return fusion.sync_source(x, new, "web_crawl")[1]


@query(f"""WITH {ROWS} SELECT c.name, coalesce(c.split, 'train') AS split, count(r.row_id) AS n, c.num_samples
FROM dataset_info c LEFT JOIN inst r ON c.file_name = r.file_name GROUP BY ALL""")
def catalogue_counts(spark, d):
    c = table(spark, d, "dataset_info").select("name", F.coalesce("split", F.lit("train")).alias("split"), "num_samples", "file_name")
    n = instructions(spark, d).groupBy("file_name").agg(F.count("*").alias("n"))
    return c.join(n, "file_name", "left").select("name", "split", F.coalesce("n", F.lit(0)).alias("n"), "num_samples")


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_properties(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.where("k is not null")


# --- text functions and rules -----------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({_collapse('text')}) AS collapsed, md5(lower({_collapse("regexp_replace(text, '<[^>]+>', ' ', 'g')")})) AS comparable FROM documents WHERE text IS NOT NULL")
def normalised_texts(spark, d):
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.md5(tx.collapse("text")).alias("collapsed"), F.md5(tx.comparable("text")).alias("comparable"))


@query(f"SELECT doc_id, len({_tokens('text')}) AS n, len(list_distinct({_tokens('text')})) AS distinct_n, len(regexp_extract_all(lower(coalesce(text, '')), '[一-鿿]|[a-z0-9]+')) AS mixed FROM documents")
def token_counts(spark, d):
    t = tx.search_tokens("text")
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("distinct_n"), F.size(tx.mixed_tokens("text")).cast("long").alias("mixed"))


@query(f"SELECT doc_id, {_script('text')} AS script, {_route('lang', 'text')} AS route FROM documents")
def language_routes(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.script_language("text").alias("script"), tx.route_language("lang", "text").alias("route"))


_X = _collapse("coalesce(text, '')")


@query(f"WITH {STORE} SELECT uid, md5(concat_ws('||', coalesce(source, ''), coalesce(CAST(orig_page_no AS VARCHAR), ''), coalesce(CAST(page_no AS VARCHAR), ''), coalesce(substr({_X}, 1, 500), ''))) AS content_id FROM store")
def content_ids(spark, d):
    return store(spark, d).select("uid", tx.content_id("source", "orig_page_no", "page_no", F.coalesce(F.substring(tx.collapse("text"), 1, 500), F.lit(""))).alias("content_id"))


# --- search -----------------------------------------------------------------------------------------------------
_BM25 = f"""d AS (SELECT doc_id, {{lang_d}} AS lang, {_tokens('text')} AS toks FROM documents),
tot AS (SELECT lang, count(*) AS n, avg(len(toks)) AS avg_len FROM d GROUP BY lang),
e AS (SELECT doc_id, lang, len(toks) AS dl, unnest(toks) AS term FROM d),
p AS (SELECT lang, term, doc_id, dl, count(*) AS tf FROM e GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM p GROUP BY ALL),
q AS (SELECT sample_id AS query, {{lang_q}} AS lang, unnest(list_distinct({_tokens('question')})) AS term FROM eval_inputs),
s AS (SELECT q.query, p.doc_id AS doc, round(sum({{idf}} * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / tot.avg_len))), 6) AS score
 FROM q JOIN df USING (lang, term) JOIN p USING (lang, term) JOIN tot USING (lang) {{more}} GROUP BY ALL)
"""
_LUCENE = "ln(1 + (tot.n - df.df + 0.5) / (df.df + 0.5))"
_TOP5 = "SELECT query, CAST(rank AS INTEGER) AS rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 5"


_INDEXES: dict = {}


def documents_index(spark: SparkSession, d: str, by_language: bool = False) -> search.Postings:
    """The inverted index of the documents: built once a session and folder, then shared by the queries."""
    key = (spark.sparkContext.applicationId, d, by_language)
    if key not in _INDEXES:
        _INDEXES[key] = search.Postings(table(spark, d, "documents"), "doc_id", "text", tx.route_language("lang", "text") if by_language else None)
    return _INDEXES[key]


def _bm25(spark, d, **kw):
    by = kw.pop("by_language", False)
    return search.bm25(documents_index(spark, d, by), table(spark, d, "eval_inputs"), "sample_id", "question", 5, lang=tx.script_language("question") if by else None, **kw)


@query("WITH " + _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="") + _TOP5)
def bm25_eval_questions(spark, d):
    return _bm25(spark, d)


@query("WITH " + _BM25.format(lang_d=_route("lang", "text"), lang_q=_script("question"), idf=_LUCENE, more="") + _TOP5)
def bm25_by_language(spark, d):
    return _bm25(spark, d, by_language=True)


@query("WITH " + _BM25.format(lang_d="'all'", lang_q="'all'", idf="CASE WHEN ln((tot.n - df.df + 0.5) / (df.df + 0.5)) < 0 THEN f.floor ELSE ln((tot.n - df.df + 0.5) / (df.df + 0.5)) END",
       more="JOIN (SELECT lang, 0.25 * avg(ln((tot.n - df.df + 0.5) / (df.df + 0.5))) AS floor FROM df JOIN tot USING (lang) GROUP BY lang) f USING (lang)") + _TOP5)
def bm25_okapi(spark, d):
    return _bm25(spark, d, idf="okapi")


@query("""WITH s AS (SELECT q.vec_id AS query, c.vec_id AS doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) """ + _TOP5)  # fmt: skip
def dense_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return search.dense_top_k(e, q, "vec_id", "embedding", 5)


@query(f"""WITH {VECTORS}, q AS (SELECT vec_id AS query, unnest(map_entries(sparse)) AS e FROM vecs WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS doc, unnest(map_entries(sparse)) AS e FROM vecs),
s AS (SELECT query, doc, round(sum(CAST(q.e.value AS DOUBLE) * CAST(c.e.value AS DOUBLE)), 6) AS score FROM q JOIN c ON q.e.key = c.e.key AND query <> doc GROUP BY ALL) """ + _TOP5)  # fmt: skip
def sparse_neighbours(spark, d):
    v = vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("sparse").alias("qw"))
    return search.sparse_top_k(v, q, "vec_id", "sparse", 5)


_DENSE_V = """dn AS (SELECT q.vec_id AS query, c.vec_id AS doc, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
 FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
sp AS (SELECT query, doc, round(sum(CAST(q.e.value AS DOUBLE) * CAST(c.e.value AS DOUBLE)), 6) AS score FROM
 (SELECT vec_id AS query, unnest(map_entries(sparse)) AS e FROM vecs WHERE vec_id % 20 = 0) q JOIN (SELECT vec_id AS doc, unnest(map_entries(sparse)) AS e FROM vecs) c ON q.e.key = c.e.key AND query <> doc GROUP BY ALL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM dn), r2 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sp)"""


def _legs(spark, d, k=20):
    v = vectors(spark, d)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"), F.col("sparse").alias("qw"))
    return search.dense_top_k(v, q, "vec_id", "embedding", k), search.sparse_top_k(v, q, "vec_id", "sparse", k)


@query(f"""WITH {VECTORS}, {_DENSE_V}, s AS (SELECT query, doc, round(sum(1.0 / (rank + 60)), 9) AS score FROM (SELECT query, doc, rank FROM r1 WHERE rank <= 20 UNION ALL SELECT query, doc, rank FROM r2 WHERE rank <= 20) GROUP BY ALL)
{_TOP5}""")
def hybrid_fusion(spark, d):
    return search.fuse(list(_legs(spark, d)), 5)


@query(f"""WITH {VECTORS}, {_DENSE_V}, u AS (SELECT query, doc, min([0, rank]) AS m FROM r1 WHERE rank <= 5 GROUP BY ALL UNION ALL SELECT query, doc, min([1, rank]) FROM r2 WHERE rank <= 5 GROUP BY ALL),
g AS (SELECT query, doc, min(m) AS m FROM u GROUP BY ALL), o AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY m, doc) AS rank FROM g)
SELECT query, CAST(rank AS INTEGER) AS rank, doc FROM o WHERE rank <= 8""")
def dual_route(spark, d):
    return search.in_route_order(list(_legs(spark, d, 5)), 8).select("query", "rank", "doc")


@query("WITH " + _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="") + f""", t AS ({_TOP5}),
tok AS (SELECT sample_id AS query, list_distinct({_tokens('question')}) AS qt FROM eval_inputs), dt AS (SELECT doc_id AS doc, list_distinct({_tokens('text')}) AS x FROM documents),
n AS (SELECT t.query, t.rank, t.doc, round(CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, x)) / len(qt) ELSE 0 END, 6) AS new_score FROM t JOIN tok USING (query) JOIN dt USING (doc))
SELECT query, doc, new_score, CAST(row_number() OVER (PARTITION BY query ORDER BY new_score DESC, rank) AS INTEGER) AS new_rank FROM n""")  # fmt: skip
def bm25_reranked(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "eval_inputs").select(F.col("sample_id").alias("query"), "question"), "query")
    hits = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return search.rerank(hits, F.round(scorers.get("score")(F.col("question"), F.col("text")), 6), 5).select("query", "doc", "new_score", "new_rank")


@query("WITH " + _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="") + f""", t AS ({_TOP5})
SELECT query, string_agg('【' || rank || '】' || substr(text, 1, 1600), chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc = doc_id GROUP BY query""")
def answer_contexts(spark, d):
    hits = _bm25(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")
    return scorers.context(hits)


@query("""WITH c AS (SELECT label, [list_avg(list_transform(g, lambda v: v[i])) FOR i IN range(1, 65)] AS vec FROM (SELECT label, list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id) AS g FROM embeddings GROUP BY label)),
s AS (SELECT vec_id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), vec), 6) AS s FROM embeddings, c),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM s)
SELECT vec_id, CASE WHEN s >= 0.5 THEN CAST(label AS VARCHAR) ELSE 'other' END AS class FROM b WHERE r = 1""")
def nearest_class(spark, d):
    e = table(spark, d, "embeddings")
    # means by label: one row a dimension, added up before the shuffle
    long = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = long.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))
    return scorers.nearest_class(e, c, "vec_id", "embedding").select("vec_id", "class")


# --- ordered sets -----------------------------------------------------------------------------------------------
@query(f"WITH {STORE} SELECT text_id, uid FROM (SELECT md5(text) AS text_id, uid, row_number() OVER (PARTITION BY md5(text) ORDER BY uid) AS n FROM store WHERE text IS NOT NULL) WHERE n = 1")
def first_of_equal_texts(spark, d):
    s = store(spark, d).where("text is not null").select(F.md5("text").alias("text_id"), "uid")
    return s.groupBy("text_id").agg(F.min("uid").alias("uid"))


@query(f"""WITH {STORE}, k AS (SELECT coalesce(nullif(uid, ''), '') AS k1, concat_ws('|', coalesce(source, ''), coalesce(nullif(content_hash, ''), md5(trim(coalesce(text, ''))))) AS mkey, uid FROM store)
SELECT mkey, min(uid) AS uid, count(*) AS n FROM k GROUP BY mkey""")
def merge_by_content(spark, d):
    s = store(spark, d).withColumn("mkey", fusion.merge_key(F.lit(None).cast("string"), F.col("source"), F.col("content_hash"), F.col("text")))
    return s.groupBy("mkey").agg(F.min("uid").alias("uid"), F.count("*").alias("n"))


@query("WITH " + _BM25.format(lang_d="'all'", lang_q="'all'", idf=_LUCENE, more="") + """, a AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS pos, 0 AS l FROM s),
b AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score, doc) AS pos, 1 AS l FROM (SELECT * FROM a JOIN s USING (query, doc) WHERE pos <= 6)),
u AS (SELECT query, doc, pos, l FROM a WHERE pos <= 4 UNION ALL SELECT query, doc, pos, l FROM b WHERE pos <= 4), f AS (SELECT *, row_number() OVER (PARTITION BY query, doc ORDER BY l, pos) AS n FROM u)
SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY l, pos, doc) AS INTEGER) AS rank FROM f WHERE n = 1""")  # fmt: skip
def merge_two_rankings(spark, d):
    top = search.bm25(documents_index(spark, d), table(spark, d, "eval_inputs"), "sample_id", "question", 6)
    w = Window.partitionBy("query").orderBy("score", "doc")
    a = top.where("rank <= 4").select("query", "doc", F.col("rank").alias("pos"))
    b = top.withColumn("pos", F.row_number().over(w)).where("pos <= 4").select("query", "doc", "pos")
    return fusion.merge_results([a, b], "doc").select("query", "doc", "rank")


@query(f"""WITH {ROWS}, x AS (SELECT row_id, list_distinct(regexp_extract_all(lower(coalesce(input, '')), '[a-z][a-z0-9_-]*')) AS a, list_distinct(regexp_extract_all(lower(coalesce(output, '')), '[a-z][a-z0-9_-]*')) AS b FROM inst)
SELECT row_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6) AS jaccard FROM x""")
def question_answer_overlap(spark, d):
    return instructions(spark, d).select("row_id", F.round(fusion.jaccard(tx.overlap_set("input"), tx.overlap_set("output")), 6).alias("jaccard"))


# --- windows and layout -----------------------------------------------------------------------------------------
@query("""SELECT user_id, event_type, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run
FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) OR lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 0 ELSE 1 END AS c FROM events)) GROUP BY ALL""")
def consecutive_runs(spark, d):
    e = fusion.islands(table(spark, d, "events"), ["ts", "event_id"], ["event_type"], ["user_id"])
    return e.groupBy("user_id", "event_type", F.col("island").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


# --- metrics ----------------------------------------------------------------------------------------------------
_HITS = """WITH r AS (SELECT q.vec_id AS query, c.vec_id AS doc, q.label = c.label AS rel, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
 FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT query, doc, CAST(rel AS INTEGER) AS rel, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM r), t AS (SELECT * FROM k WHERE rank <= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, rank) AS ideal, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS cum FROM t),
m AS (SELECT query, sum(rel) AS nr, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS r5, min(CASE WHEN rel = 1 THEN rank END) AS f,
 sum(CASE WHEN rel = 1 THEN cum / rank ELSE 0 END) AS aps, sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 5 THEN rel / log2(ideal + 1.0) ELSE 0 END) AS idcg FROM o GROUP BY query)
"""


def _ranked(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    hits = search.dense_top_k(e, q, "vec_id", "embedding", 10)
    lab = e.select(F.col("vec_id").alias("doc"), F.col("label").alias("dl"))
    return hits.join(lab, "doc").join(lab.select(F.col("doc").alias("query"), F.col("dl").alias("ql")), "query").withColumn("label", (F.col("dl") == F.col("ql")).cast("int"))


@query(_HITS + "SELECT query, round(CAST(h AS DOUBLE), 6) AS hit_5, round(CASE WHEN nr > 0 THEN r5 / nr ELSE 0 END, 6) AS recall_5, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg_5, round(coalesce(1.0 / f, 0), 6) AS rr, round(CASE WHEN nr > 0 THEN aps / nr ELSE 0 END, 6) AS ap FROM m")
def ranking_metrics(spark, d):
    m = metrics.ranking_metrics(_ranked(spark, d), (5,))
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("hit_5", "recall_5", "ndcg_5", "rr", "ap")])


@query(_HITS + "SELECT count(*) AS queries, round(avg(h), 6) AS hit_5, round(avg(CASE WHEN nr > 0 THEN r5 / nr ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS ndcg_5, round(avg(coalesce(1.0 / f, 0)), 6) AS rr, round(avg(CASE WHEN nr > 0 THEN aps / nr ELSE 0 END), 6) AS ap FROM m")
def ranking_summary(spark, d):
    return metrics.macro_average(metrics.ranking_metrics(_ranked(spark, d), (5,)))


_F1 = f"""{ROWS}, x AS (SELECT row_id, regexp_extract_all(lower(coalesce(input, '')), '[一-鿿]|[a-z0-9]+') AS g, regexp_extract_all(lower(coalesce(output, '')), '[一-鿿]|[a-z0-9]+') AS s FROM inst),
a AS (SELECT row_id, t, count(*) AS n FROM (SELECT row_id, unnest(g) AS t FROM x) GROUP BY ALL), b AS (SELECT row_id, t, count(*) AS n FROM (SELECT row_id, unnest(s) AS t FROM x) GROUP BY ALL),
c AS (SELECT row_id, sum(least(a.n, b.n)) AS shared FROM a JOIN b USING (row_id, t) GROUP BY row_id)"""


@query(f"WITH {_F1} SELECT row_id, round(CASE WHEN len(g) + len(s) = 0 THEN 1.0 ELSE 2.0 * coalesce(shared, 0) / (len(g) + len(s)) END, 6) AS f1 FROM x LEFT JOIN c USING (row_id)")
def token_f1(spark, d):
    return metrics.token_f1_table(instructions(spark, d), "row_id", "input", "output").select("row_id", F.round("f1", 6).alias("f1"))


@query("""WITH g AS (SELECT CAST(floor(length(text) / 200) * 200 AS BIGINT) AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cumulative, round(100.0 * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 4) AS percent FROM g""")
def length_distribution(spark, d):
    return metrics.length_cdf(table(spark, d, "documents"), F.length("text"), 200)


@query("SELECT CAST(v AS INTEGER) AS score, count(p_size) AS n FROM range(1, 6) r(v) LEFT JOIN (SELECT greatest(1, least(5, p_size // 10)) AS b, p_size FROM part) ON b = v GROUP BY v")
def clamped_histogram(spark, d):
    return metrics.histogram(table(spark, d, "part"), F.floor(F.col("p_size") / 10), 1, 5)


@query(f"WITH {ROWS} SELECT coalesce(task_type, 'Average') AS task_type, round(avg(length(output)), 6) AS mean, count(*) AS n FROM inst GROUP BY GROUPING SETS ((task_type), ())")
def means_with_overall(spark, d):
    r = instructions(spark, d).withColumn("len", F.length("output"))
    return metrics.with_overall(r, "task_type", "len")


@query("""WITH a AS (SELECT suite, retrieval_time_seconds AS a, coalesce(rerank_time_seconds, 0) AS b, total_time_seconds AS c FROM eval_inputs)
SELECT suite, count(*) AS n, round(avg(a), 6) AS retrieval, round(avg(b), 6) AS rerank, round(avg(c), 6) AS total, round(median(c), 6) AS median_total, round(stddev_pop(c), 6) AS spread FROM a GROUP BY suite""")
def stage_timings(spark, d):
    e = table(spark, d, "eval_inputs")
    return e.groupBy("suite").agg(
        F.count("*").alias("n"), F.round(F.avg("retrieval_time_seconds"), 6).alias("retrieval"), F.round(F.avg(F.coalesce("rerank_time_seconds", F.lit(0.0))), 6).alias("rerank"),
        F.round(F.avg("total_time_seconds"), 6).alias("total"), F.round(F.median("total_time_seconds"), 6).alias("median_total"), F.round(F.stddev_pop("total_time_seconds"), 6).alias("spread"),
    )


@query("""WITH r AS (SELECT q.vec_id AS query, q.label = c.label AS rel, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score, c.vec_id AS doc FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(rel AS INTEGER) AS label FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10),
p AS (SELECT a.label - b.label AS gap, b.score - a.score AS d FROM k a JOIN k b USING (query) WHERE a.label > b.label)
SELECT round(sum(gap * (greatest(d, 0) + ln(1 + exp(-abs(d))))) / sum(gap), 6) AS ranknet FROM p""")
def ranknet_loss(spark, d):
    return losses.pairwise_ranknet(_ranked(spark, d)).select(F.round("loss", 6).alias("ranknet"))


@query("""WITH r AS (SELECT q.vec_id AS query, q.label = c.label AS rel, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score, c.vec_id AS doc FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(rel AS INTEGER) AS label FROM r QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10),
l AS (SELECT query, ln(sum(exp(score))) AS lse FROM k GROUP BY query), q AS (SELECT query, sum(label * (lse - score)) / nullif(sum(label), 0) AS x FROM k JOIN l USING (query) GROUP BY query)
SELECT round((SELECT avg(x) FROM q), 6) AS listwise, round((SELECT avg(pow(score - label, 2)) FROM k), 6) AS mse""")
def list_losses(spark, d):
    r = _ranked(spark, d)
    return losses.listwise_ce(r).select(F.round("loss", 6).alias("listwise")).join(F.broadcast(losses.pointwise_mse(r).select(F.round("loss", 6).alias("mse"))))


# --- dataset construction ---------------------------------------------------------------------------------------
@query(f"""WITH {ROWS}, h AS (SELECT row_id, CAST(('0x' || substr(md5(concat_ws('|', CAST(row_id AS VARCHAR), '7')), 1, 8)) AS BIGINT) / 4294967296.0 AS p FROM inst)
SELECT row_id, CASE WHEN p < 0.9 THEN 'train' ELSE 'test' END AS split FROM h""")
def hash_split(spark, d):
    return datasets.split_by_hash(instructions(spark, d), "row_id", 0.9, 7).select("row_id", "split")


@query(f"""WITH {ROWS}, h AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '7')), row_id) AS r, count(*) OVER () AS n FROM inst)
SELECT row_id, CASE WHEN r <= greatest(1, CAST(floor(0.9 * n) AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM h""")
def exact_split(spark, d):
    return datasets.split_exact(instructions(spark, d), "row_id", 0.9, 7).select("row_id", "split")


@query()
def group_split(spark, d):
    r = instructions(spark, d).where("source_uid is not null")
    return datasets.split_groups(r, "source_uid").groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("source_uid").alias("groups"))


@query(f"""WITH {ROWS} SELECT source_uid, row_id, CAST(place AS INTEGER) AS place FROM (SELECT source_uid, row_id, row_number() OVER (PARTITION BY source_uid ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '3')), row_id) AS place FROM inst) WHERE place <= 2""")
def few_shot_sample(spark, d):
    return datasets.few_shot(instructions(spark, d), 2, "source_uid", "row_id", 3).select("source_uid", "row_id", "place")


@query(f"WITH {ROWS} SELECT row_id, CAST(floor((row_number() OVER (ORDER BY row_id) - 1) / 64) AS BIGINT) AS batch FROM inst QUALIFY batch < floor(count(*) OVER () / 64)")
def fixed_batches(spark, d):
    return datasets.batches(instructions(spark, d).select("row_id"), 64, ["row_id"])


# --- fine-tuning data -------------------------------------------------------------------------------------------
_PROMPT = "array_to_string(list_filter([instruction, input], lambda x: x IS NOT NULL AND length(trim(x)) > 0), chr(10))"


@query(f"""WITH {ROWS} SELECT row_id, md5((CASE WHEN length(trim(coalesce(system, ''))) > 0 THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END) || '<|im_start|>user' || chr(10) || {_PROMPT} || '<|im_end|>' || chr(10)) AS prompt FROM inst""")
def chatml_prompts(spark, d):
    a = finetune.from_alpaca(instructions(spark, d))
    return a.select("row_id", F.md5(finetune.render_chatml(F.col("_system"), F.col("_prompt"))).alias("prompt"))


@query(f"WITH {ROWS}, x AS (SELECT row_id, CAST(strlen({_PROMPT}) AS BIGINT) AS s, CAST(strlen(coalesce(output, '')) + 1 AS BIGINT) AS t FROM inst), b AS (SELECT *, CAST(least(CASE WHEN t * 2 < 512 THEN 512 WHEN s * 2 < 512 THEN 512 - s ELSE floor(512 * (t / (s + t))) END, t) AS BIGINT) AS target FROM x) SELECT row_id, least(greatest(512 - target, 0), s) AS source, target FROM b")
def token_budgets(spark, d):
    a = finetune.from_alpaca(instructions(spark, d))
    s, t = F.octet_length(F.get("_prompt", F.lit(0))["content"]), F.octet_length(F.coalesce("output", F.lit(""))) + 1
    return a.withColumn("b", finetune.budget(s, t, 512)).select("row_id", "b.source", "b.target")


@query()
def packed_rows(spark, d):
    """Greedy packing of batches of 512 rows; the greedy choice depends on what came before, so SQL cannot say it."""
    a = finetune.from_alpaca(instructions(spark, d)).withColumn("batch", F.floor(F.col("row_id") / 512))
    a = a.withColumn("n", F.octet_length(F.coalesce("output", F.lit(""))) + 1)
    return finetune.pack_greedy(a, "batch", "row_id", "n", 2048)


@query(f"WITH {ROWS} SELECT row_id, lag(output) OVER (PARTITION BY file_name ORDER BY row_id) AS prev, md5(coalesce(coalesce(lag(output) OVER (PARTITION BY file_name ORDER BY row_id), last_value(output) OVER (PARTITION BY file_name ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), '')) AS other FROM inst")
def mismatched_responses(spark, d):
    r = instructions(spark, d)
    w = Window.partitionBy("file_name").orderBy("row_id")
    return finetune.mismatched(r.withColumn("prev", F.lag("output").over(w)), "file_name", "row_id", "output").select("row_id", "prev", F.md5(F.coalesce("other", F.lit(""))).alias("other"))


# --- streams (as batches here; the same plans run on readStream) -------------------------------------------------
@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return jobs.windowed(table(spark, d, "events"))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events),
s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"))


# --- beyond the reference: the relational tables ------------------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def revenue_by_nation(spark, d):
    t = {n: table(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    j = t["lineitem"].join(t["orders"], F.expr("l_orderkey = o_orderkey")).join(t["customer"], F.expr("c_custkey = o_custkey"))
    j = j.join(t["supplier"], F.expr("l_suppkey = s_suppkey and c_nationkey = s_nationkey")).join(t["nation"], F.expr("s_nationkey = n_nationkey")).join(t["region"], F.expr("n_regionkey = r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


# --- more metrics and sets ------------------------------------------------------------------------------------------
@query(_HITS + "SELECT query, count(*) AS n FROM t GROUP BY query HAVING count(DISTINCT rel) > 1")
def mixed_label_queries(spark, d):
    return metrics.mixed_label_groups(_ranked(spark, d), "query").groupBy("query").agg(F.count("*").alias("n"))


@query("SELECT CAST(greatest(ceil(least(l_discount, 0.1) / 0.02) - 1, 0) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY ALL")
def binned_values(spark, d):
    return metrics.binned(table(spark, d, "lineitem"), F.col("l_discount"), 0.0, 0.1, 5)


@query(_HITS + """, r2(low, high) AS (VALUES (0, 100), (100, 200), (200, 300), (300, 500), (500, 1000000))
SELECT low, high, count(*) AS n, round(avg(CASE WHEN h = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM m JOIN r2 ON query >= low AND query <= high GROUP BY ALL""")
def recall_by_position(spark, d):
    m = metrics.ranking_metrics(_ranked(spark, d), (5,)).select("query", "hit_5")
    ranges = spark.createDataFrame([(0, 100), (100, 200), (200, 300), (300, 500), (500, 1000000)], "low int, high int")
    return metrics.recall_by_range(m, ranges, "query", "hit_5")


@query(f"""WITH {ROWS}, x AS (SELECT file_name, regexp_matches(coalesce(output, ''), '[^' || substr('{WS}', 2)) AS full_ FROM inst)
SELECT file_name, CAST(count_if(full_) AS BIGINT) AS good, CAST(count_if(NOT full_) AS BIGINT) AS bad FROM x GROUP BY file_name""")
def label_balance(spark, d):
    full = tx.stripped(F.coalesce("output", F.lit(""))) != ""
    return instructions(spark, d).groupBy("file_name").agg(F.count_if(full).alias("good"), F.count_if(~full).alias("bad"))


@query(f"""WITH {ROWS} SELECT lower(trim(input)) AS low, min(row_id) AS row_id, count(*) AS n FROM inst WHERE length(trim(coalesce(input, ''))) > 0 GROUP BY lower(trim(input))""")
def case_insensitive_questions(spark, d):
    r = instructions(spark, d).where(F.length(F.trim(F.coalesce("input", F.lit("")))) > 0)
    return r.groupBy(F.lower(F.trim("input")).alias("low")).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


@query(f"WITH {ROWS} SELECT count(*) AS pairs, round(avg(CASE WHEN coalesce(length(output), 0) > coalesce(length(input), 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM inst")
def preference_accuracy(spark, d):
    r = instructions(spark, d).select(F.coalesce(F.length("output"), F.lit(0)).alias("a"), F.coalesce(F.length("input"), F.lit(0)).alias("b"))
    return metrics.preference_accuracy(r, "a", "b").select("pairs", "accuracy")


@query(f"""WITH {STORE}, x AS (SELECT DISTINCT source, page_no, orig_page_no FROM store WHERE level = 'parent')
SELECT source, count(*) AS pages, min(coalesce(page_no, 1000000000)) AS first_page FROM x GROUP BY source""")
def pages_by_source(spark, d):
    s = store(spark, d).where("level = 'parent'").select("source", "page_no", "orig_page_no").distinct()
    return s.groupBy("source").agg(F.count("*").alias("pages"), F.min(F.coalesce("page_no", F.lit(10**9))).alias("first_page"))


@query("""WITH f AS (SELECT unique_id AS uid, unnest(metadata.figure_refs) AS f FROM manual_info), g AS (SELECT DISTINCT uid, f.image_path AS image_path, f.page_no AS page_no FROM f)
SELECT uid, count(*) AS figures, min(image_path) AS first_image FROM g GROUP BY uid""")
def figures_of_documents(spark, d):
    m = table(spark, d, "manual_info").select(F.col("unique_id").alias("uid"), F.explode("metadata.figure_refs").alias("f")).distinct()
    return m.groupBy("uid").agg(F.count("*").alias("figures"), F.min("f.image_path").alias("first_image"))


# further queries register themselves
from . import pages, passages, training  # noqa: E402, F401
