"""Queries on training data: augmentation, lineage, ranking sets, encoders, losses. Their SQL holds its own literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import datasets, finetune, losses, metrics
from ..session import table
from .catalogue import ROWS, VECTORS, _collapse, instructions, query, vectors
from .passages import _X

# --- augmentation ---------------------------------------------------------------------------------------------------------
#: Pairs made of the instruction rows; keywords are the first three words of the answer, every fourth row has none.
_PAIRS = f"""pr AS (SELECT row_id AS id, {_collapse("coalesce(input, '')")} AS q, coalesce(output, '') AS a, CASE WHEN row_id % 4 = 0 THEN [] ELSE list_slice(regexp_extract_all(coalesce(output, ''), '[A-Za-z一-鿿]+'), 1, 3) END AS kw FROM inst),
 ty AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'definition' WHEN id % 3 = 1 THEN 'representation' ELSE 'other' END AS kind, regexp_matches(q, '[一-鿿]') AS zq, regexp_matches(a, '[一-鿿]') AS za, coalesce(kw[1], '') AS k1 FROM
  (SELECT id, CASE WHEN id % 9 = 0 THEN 'What is ' || q ELSE CASE WHEN id % 9 = 3 THEN '什么是' || q || '？' ELSE q END END AS q, a, kw FROM pr)),
 sb AS (SELECT *, zq OR za AS zh, {_collapse("CASE WHEN zq THEN regexp_extract(q, '^什么是(.+?)[？?]?$', 1) ELSE regexp_replace(regexp_extract(q, '(?i)^what (?:is|are)\\b\\s*(.*)$', 1), '[ ?]+$', '') END")} AS subject FROM ty),
 wr AS (SELECT *, CASE WHEN kind = 'definition' AND subject <> '' THEN subject || CASE WHEN zq THEN '不是信息检索中的具体概念，只是普通表达。' WHEN regexp_matches(lower(q), '^what are\\b') THEN ' are not used in information retrieval systems.' ELSE ' is not an information retrieval concept, but merely a general expression.' END
  WHEN kind = 'definition' AND k1 <> '' THEN k1 || CASE WHEN zq THEN '在信息检索中没有明确含义。' ELSE ' has no specific meaning in information retrieval.' END
  WHEN kind = 'representation' AND k1 <> '' THEN k1 || CASE WHEN zq THEN '不能被表示为任何结构化形式。' ELSE ' does not represent any specific concept in this context.' END
  WHEN kind = 'representation' THEN CASE WHEN zq THEN '该对象通常无法进行任何形式的表示。' ELSE 'This object does not represent any specific concept in this context.' END END AS wrong FROM sb),
 tm AS (SELECT *, CASE WHEN zq THEN CASE WHEN regexp_matches(q, '^什么是(.+?)[？?]?$') THEN subject ELSE k1 END ELSE CASE WHEN regexp_matches(lower(q), '^what (is|are)\\b') THEN subject ELSE k1 END END AS term, zh OR regexp_matches(coalesce(wrong, ''), '[一-鿿]') AS zf FROM wr),
 au AS (SELECT id || '_orig' AS id, 'qa' AS task_type, CASE WHEN zh THEN '请回答信息检索问题。' ELSE 'Please answer the information retrieval question.' END AS instruction, q AS input, a AS output FROM tm
  UNION ALL SELECT id || '_qkw', 'qa_with_keywords', CASE WHEN zh THEN '请根据问题和关键词给出准确回答。' ELSE 'Please answer accurately using the question and keywords.' END,
   CASE WHEN zh THEN '问题：' || q || chr(10) || '关键词：' ELSE 'Question: ' || q || chr(10) || 'Keywords: ' END || CASE WHEN len(kw) > 0 THEN array_to_string(kw, ', ') ELSE '无' END, a FROM tm
  UNION ALL SELECT id || '_term', 'term_explanation', CASE WHEN zq THEN '请解释下列信息检索术语。' ELSE 'Please explain the following information retrieval term.' END, term, a FROM tm WHERE kind = 'definition' AND term <> ''
  UNION ALL SELECT id || '_fix', 'error_correction', CASE WHEN zf THEN '判断下面说法是否正确；如果错误，请给出正确表述。' ELSE 'Determine whether the following statement is correct. If it is incorrect, provide the correct statement.' END, wrong,
   CASE WHEN zf THEN '该说法不准确。正确表述是：' ELSE 'This statement is inaccurate. The correct statement is: ' END || a FROM tm WHERE wrong IS NOT NULL)"""


def _pairs(spark, d):
    r, n = instructions(spark, d), F.col("row_id")
    q = tx.collapse(F.coalesce("input", F.lit("")))
    q = F.when(n % 9 == 0, F.concat(F.lit("What is "), q)).when(n % 9 == 3, F.concat(F.lit("什么是"), q, F.lit("？"))).otherwise(q)
    kw = F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.slice(F.regexp_extract_all(F.coalesce("output", F.lit("")), F.lit("[A-Za-z一-鿿]+"), F.lit(0)), 1, 3))
    kind = F.when(n % 3 == 0, "definition").when(n % 3 == 1, "representation").otherwise("other")
    return datasets.augment(r.select(n.alias("id"), q.alias("question"), F.coalesce("output", F.lit("")).alias("answer"), kw.alias("keywords"), kind.alias("k")), kind=F.col("k"))


@query(f"WITH {ROWS}, {_PAIRS} SELECT id, task_type, instruction, md5(input) AS input, md5(output) AS output FROM au")
def augmented_rows(spark, d):
    return _pairs(spark, d).select("id", "task_type", "instruction", F.md5("input").alias("input"), F.md5("output").alias("output"))


@query(f"WITH {ROWS}, {_PAIRS} SELECT instruction, count(*) AS n, CAST(sum(length(input)) AS BIGINT) AS chars FROM au GROUP BY instruction")
def alpaca_projection(spark, d):
    """Master rows (one an id, though given twice) as instruction, input, output and system."""
    a = _pairs(spark, d)
    rows = datasets.as_alpaca(datasets.master_rows(a.unionByName(a)))
    return rows.groupBy("instruction").agg(F.count("*").alias("n"), F.sum(F.length("input")).alias("chars"))


_PARA = f"pp AS (SELECT row_id AS uid, {_collapse("coalesce(input, '')")} AS q, ['  ' || coalesce(input, ''), 'Say: ' || coalesce(input, ''), 'Say: ' || coalesce(input, ''), ''] AS more, output AS a FROM inst WHERE {_collapse("coalesce(input, '')")} <> '')"


@query(f"WITH {ROWS}, {_PARA}, f AS (SELECT uid, 0 AS place, q, a FROM pp UNION ALL SELECT uid, 1, {_collapse("'Say: ' || q")}, a FROM pp) SELECT CAST(uid AS VARCHAR) AS source_uid, uid || '#' || place AS unique_id, md5(q) AS question, md5(coalesce(a, '')) AS answer FROM f")
def final_pairs(spark, d):
    r = instructions(spark, d).where(tx.collapse(F.coalesce("input", F.lit(""))) != "")
    qa = r.select(F.col("row_id").cast("string").alias("source_uid"), tx.collapse("input").alias("question"), F.coalesce("output", F.lit("")).alias("answer"))
    say = F.concat(F.lit("Say: "), F.col("question"))
    p = qa.select("source_uid", F.array(F.concat(F.lit("  "), F.col("question")), say, say, F.lit("")).alias("questions"))
    return datasets.final_pairs(qa, p).select("source_uid", "unique_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query(f"""WITH {ROWS}, s AS (SELECT unique_id AS uid, min(metadata.parent_id) AS parent_id FROM manual_info GROUP BY unique_id), q AS (SELECT lower({_collapse("coalesce(input, '')")}) AS question, min(source_uid) AS uid FROM inst WHERE source_uid IS NOT NULL GROUP BY ALL)
SELECT md5(question) AS question, q.uid, coalesce(parent_id, s.uid) AS parent FROM q LEFT JOIN s USING (uid) WHERE question <> ''""")
def question_sources(spark, d):
    r = instructions(spark, d).where("source_uid is not null").select("input", "source_uid")
    docs = table(spark, d, "manual_info").select(F.col("unique_id").alias("uid"), F.col("metadata.parent_id").alias("parent_id")).groupBy("uid").agg(F.min("parent_id").alias("parent_id"))
    return datasets.question_sources(r.withColumnRenamed("input", "q"), docs, "uid", "q").select(F.md5("question").alias("question"), "uid", "parent")


@query(f"""WITH {ROWS}, dn AS (SELECT row_id AS k, input FROM inst WHERE row_id % 3 = 0), tx AS (SELECT DISTINCT lower({_collapse('input')}) AS t FROM inst WHERE row_id % 5 = 0)
SELECT row_id FROM inst WHERE row_id % 3 <> 0 AND (input IS NULL OR lower({_collapse('input')}) NOT IN (SELECT t FROM tx WHERE t IS NOT NULL))""")
def not_yet_asked(spark, d):
    r = instructions(spark, d).select("row_id", "input")
    done = r.where("row_id % 3 = 0").unionByName(r.where("row_id % 5 = 0").withColumn("row_id", F.lit(None).cast("long")))
    return datasets.not_yet_asked(r, done, "row_id", "input").select("row_id")


@query(f"""WITH {ROWS}, g AS (SELECT source_uid, list(row_id ORDER BY row_id) AS l FROM inst WHERE source_uid IS NOT NULL GROUP BY source_uid) SELECT source_uid, array_to_string([l[1 + i % len(l)] FOR i IN range(5)], ',') AS five FROM g""")
def padded_lists(spark, d):
    g = instructions(spark, d).where("source_uid is not null").groupBy("source_uid").agg(F.sort_array(F.collect_list("row_id")).alias("l"))
    return g.select("source_uid", F.array_join(datasets.pad_list("l", 5).cast("array<string>"), ",").alias("five"))


@query(f"""WITH {ROWS}, q AS (SELECT source_uid AS uid, row_id, row_number() OVER (PARTITION BY source_uid ORDER BY row_id) - 1 AS position, {_collapse("coalesce(input, '')")} AS q, {_collapse("coalesce(output, '')")} AS a FROM inst WHERE source_uid IS NOT NULL)
SELECT uid || '#' || position AS source_uid, md5(q) AS question, md5(a) AS answer, 1 + position % 5 AS score FROM q WHERE q <> '' AND a <> '' AND 1 + position % 5 >= 4""")
def scored_qa_pairs(spark, d):
    r = instructions(spark, d).where("source_uid is not null")
    js = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "input", "output"))), lambda x: F.struct(x["input"].alias("question"), x["output"].alias("answer"))))
    g = r.groupBy("source_uid").agg(js.alias("raw"), F.transform(F.sequence(F.lit(0), F.count("*").cast("int") - 1), lambda i: i % 5 + 1).alias("sc"))
    p = datasets.qa_pairs(g, "source_uid", "raw", "sc", 4)
    return p.select("source_uid", F.md5("question").alias("question"), F.md5("answer").alias("answer"), F.col("score").cast("long").alias("score"))


@query(f"WITH {ROWS} SELECT row_id, array_to_string([greatest(1, least(5, coalesce(x, 1))) FOR x IN [row_id % 9, NULL, -3, 1, 1, 1][1:4]], ',') AS scores FROM inst")
def clamped_scores(spark, d):
    s = datasets.score_list(F.array((F.col("row_id") % 9).cast("int"), F.lit(None).cast("int"), F.lit(-3)), F.lit(4))
    return instructions(spark, d).select("row_id", F.array_join(s.cast("array<string>"), ",").alias("scores"))


@query(f"WITH {ROWS} SELECT md5('x') AS h, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT md5(concat_ws('|', CAST(row_id AS VARCHAR), '0')) AS k FROM inst UNION ALL SELECT md5(concat_ws('|', 'neg:' || md5(input), '0')) FROM inst WHERE row_id % 10 = 0 AND length(trim(input)) > 0)")
def with_negative_rows(spark, d):
    r = instructions(spark, d).withColumn("id", F.col("row_id").cast("string"))
    neg = r.where("row_id % 10 = 0").select(F.col("input").alias("question"))
    return datasets.with_negatives(r, neg, "Reply only if you know.", "none").agg(F.md5(F.lit("x")).alias("h"), F.count("*").alias("n"), F.count_distinct("shuffle_key").alias("keys"))


# --- ranking sets -----------------------------------------------------------------------------------------------------------
_HIT = f"hit AS (SELECT source_uid AS query_id, {_collapse("coalesce(input, '')")} AS content, CAST(row_id % 3 AS INT) AS label, row_id AS pos, row_id // 4 AS q FROM inst WHERE source_uid IS NOT NULL AND length(trim(coalesce(input, ''))) > 0)"


def _hits(spark, d):
    r = instructions(spark, d).where("source_uid is not null and length(trim(coalesce(input, ''))) > 0")
    return r.select("source_uid", tx.collapse("input").alias("content"), (F.col("row_id") % 3).cast("int").alias("label"), F.col("row_id").alias("pos"), F.floor(F.col("row_id") / 4).alias("query_id"), F.lit("q").alias("query"))


@query(f"WITH {ROWS}, {_HIT} SELECT q AS query_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, md5(string_agg(content, '|' ORDER BY pos)) AS contents FROM hit GROUP BY q")
def grouped_hits(spark, d):
    g = datasets.grouped_hits(_hits(spark, d))
    return g.select("query_id", F.size("hits").cast("long").alias("n"), F.aggregate("hits", F.lit(0), lambda a, h: a + h["label"]).cast("long").alias("labels"), F.md5(F.array_join(F.transform("hits", lambda h: h["content"]), "|")).alias("contents"))


@query(f"WITH {ROWS}, {_HIT} SELECT q AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY pos) - 1 AS INT) AS place, md5(content) AS content, label FROM hit")
def pointwise_rows(spark, d):
    return datasets.pointwise(datasets.grouped_hits(_hits(spark, d))).select("query_id", "place", F.md5("content").alias("content"), "label")


@query(f"WITH {ROWS}, {_HIT} SELECT q AS query_id, md5(content) AS doc, CAST(last(label ORDER BY pos) AS INT) AS label FROM hit GROUP BY q, content")
def query_labels(spark, d):
    return datasets.corpus_of(datasets.grouped_hits(_hits(spark, d)))[1]


@query(f"WITH {ROWS}, {_HIT} SELECT md5(content) AS doc, content FROM hit GROUP BY content")
def text_corpus(spark, d):
    return datasets.corpus_of(datasets.grouped_hits(_hits(spark, d)))[0]


@query(f"""WITH {ROWS}, {_HIT}, g AS (SELECT q AS query_id, pos AS doc FROM hit WHERE label = 2), j AS (SELECT q AS query_id, pos AS doc, label - 1 AS r FROM hit)
SELECT query_id, doc, CAST(1 AS INT) AS relevance, CAST(2 AS INT) AS grade FROM g UNION ALL SELECT query_id, doc, r, r + 1 FROM j WHERE (query_id, doc) NOT IN (SELECT query_id, doc FROM g)""")
def rank_labels(spark, d):
    h = _hits(spark, d).select("query_id", F.col("pos").alias("doc"), (F.col("label") - 1).alias("relevance"))
    return datasets.rank_labels(h, h.where("relevance = 1").select("query_id", "doc")).select("*", datasets.relevance_grade(F.col("relevance")).alias("grade"))


@query(f"""WITH {ROWS}, {_HIT}, n AS (SELECT *, count(*) OVER (PARTITION BY q) AS n, row_number() OVER (PARTITION BY q ORDER BY md5(concat_ws('|', CAST(q AS VARCHAR), CAST(pos AS VARCHAR), '5')), pos) - 1 AS r FROM hit),
 l AS (SELECT q, pos, label, r // 2 AS list_no FROM n WHERE n >= 2 UNION ALL SELECT q, pos, label, CAST(ceil(n / 2.0) AS BIGINT) - 1 FROM n WHERE n >= 2 AND r < CAST(ceil(n / 2.0) AS BIGINT) * 2 - n)
SELECT q AS query_id, CAST(list_no AS BIGINT) AS list_no, pos FROM l QUALIFY count(DISTINCT label) OVER (PARTITION BY q, list_no) > 1""")  # fmt: skip
def training_lists(spark, d):
    h = _hits(spark, d).select("query_id", "pos", "label")
    return datasets.training_lists(h, 2, 5, "query_id", "pos").select("query_id", F.col("list_no").cast("long").alias("list_no"), "pos")


@query(f"""WITH {ROWS}, {_HIT}, g AS (SELECT q AS query, list(content ORDER BY pos) FILTER (label = 2) AS pos, list(content ORDER BY pos) FILTER (label < 2) AS neg FROM hit GROUP BY q),
 p AS (SELECT query, unnest(pos) AS pos, list_sort(list_transform(neg, lambda x: {{'h': md5(x || '1'), 'x': x}})) AS n FROM g WHERE len(neg) > 0)
SELECT query, md5(pos) AS pos, md5(array_to_string([n[1 + i % len(n)].x FOR i IN range(3)], '|')) AS negs FROM p""")  # fmt: skip
def triplets(spark, d):
    s = F.sort_array(F.collect_list(F.struct("pos", "label", "content")))
    part = lambda f: F.transform(F.filter(s, f), lambda x: x["content"])
    g = _hits(spark, d).groupBy(F.col("query_id").alias("query")).agg(part(lambda x: x["label"] == 2).alias("pos"), part(lambda x: x["label"] < 2).alias("neg"))
    return datasets.triplets(g, 3, 1).select("query", F.md5("pos").alias("pos"), F.md5(F.array_join("negs", "|")).alias("negs"))


# --- converters and encoders ----------------------------------------------------------------------------------------------------
def _turns(names: tuple):
    """Turns of a row: a leading system turn in every third, one too many in every fifth, roles swapped in every seventh.

    names: of role and text, and of system, user, bot.
    """
    role, text, system, user, bot = names
    turn = lambda r, c: F.struct(F.lit(r).alias(role), c.alias(text))
    n, i, o = F.col("row_id"), F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))
    body = F.when(n % 7 == 0, F.array(turn(bot, o), turn(user, i))).otherwise(F.array(turn(user, i), turn(bot, o)))
    body = F.when(n % 5 == 0, F.concat(body, F.array(turn(user, i)))).otherwise(body)
    return F.when(n % 3 == 0, F.concat(F.array(turn(system, F.col("instruction"))), body)).otherwise(body)


_OK = "(row_id % 7 <> 0 AND row_id % 5 <> 0)"
_CONV = f"SELECT row_id, CASE WHEN row_id % 3 = 0 THEN instruction ELSE '' END AS system, CASE WHEN {_OK} THEN 'user:' || coalesce(input, '') ELSE '' END AS prompt, CASE WHEN {_OK} THEN 'assistant:' || coalesce(output, '') ELSE '' END AS response FROM inst"


def _shown(rows):
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return rows.select("row_id", F.col("_system").alias("system"), text("_prompt").alias("prompt"), text("_response").alias("response"))


@query(f"WITH {ROWS} {_CONV}")
def sharegpt_rows(spark, d):
    r = instructions(spark, d).withColumn("conversations", _turns(("from", "value", "system", "human", "gpt"))).drop("system")
    return _shown(finetune.from_sharegpt(r))


@query(f"WITH {ROWS} {_CONV.replace(_OK, '(row_id % 5 <> 0 AND row_id % 7 <> 0)')}")
def openai_rows(spark, d):
    r = instructions(spark, d).withColumn("messages", _turns(("role", "content", "system", "user", "assistant")))
    return _shown(finetune.from_openai(r))


@query(f"WITH {ROWS} SELECT row_id, '' AS system, 'user:' || coalesce(input, '') AS prompt, 'assistant:' || coalesce(output, '') || chr(10) || 'assistant:' || instruction AS response FROM inst")
def preference_rows(spark, d):
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    ask = turn("user", F.coalesce("input", F.lit("")))
    r = instructions(spark, d).select("row_id", F.array(ask, turn("assistant", F.coalesce("output", F.lit("")))).alias("chosen"), F.array(ask, turn("assistant", F.col("instruction"))).alias("rejected"))
    return _shown(finetune.from_pair(r))


@query(f"WITH {ROWS} SELECT row_id, {_OK} AS usable FROM inst")
def usable_rows(spark, d):
    r = instructions(spark, d).withColumn("conversations", _turns(("from", "value", "system", "human", "gpt"))).drop("system")
    c = finetune.from_sharegpt(r).select("row_id", F.col("_prompt").alias("prompt"), F.col("_response").alias("response"))
    return c.select("row_id", finetune.usable().alias("usable"))


_LEN = "ln AS (SELECT row_id, instruction, input, output, strlen(coalesce(input, '')) AS s, strlen(coalesce(output, '')) + 1 AS t, strlen(instruction) + 1 AS j FROM inst)"


def _budget(s: str, t: str, c: int) -> tuple[str, str]:
    new_t = f"CAST(least(CASE WHEN {t} * 2 < {c} THEN {c} WHEN {s} * 2 < {c} THEN {c} - {s} ELSE floor({c} * ({t} / ({s} + {t}))) END, {t}) AS BIGINT)"
    return f"least(greatest({c} - {new_t}, 0), {s})", new_t


_SB, _TB = _budget("s", "t", 256)
#: Sum of the first n bytes of a text, where every token is a byte.
_BYTES = "list_sum(list_transform(range(1, 1 + CAST({n} AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i - 1, 2) AS INT)))"


@query(f"WITH {ROWS}, {_LEN}, b AS (SELECT *, {_SB} AS sn, {_TB} AS tn FROM ln) SELECT row_id, CAST(sn + tn AS BIGINT) AS n, CAST(tn AS BIGINT) AS learned, CAST(coalesce({_BYTES.format(n='least(tn, t - 1)', x="coalesce(output, '')")}, 0) + CASE WHEN tn = t THEN 256 ELSE 0 END AS BIGINT) AS total FROM b")
def supervised_rows(spark, d):
    r = finetune.supervised(instructions(spark, d).select("row_id", F.coalesce("input", F.lit("")).alias("p"), F.coalesce("output", F.lit("")).alias("r")), "p", "r", 256)
    learned = F.filter("labels", lambda x: x != -100)
    return r.select("row_id", F.size("input_ids").cast("long").alias("n"), F.size(learned).cast("long").alias("learned"), F.aggregate(learned, F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query(f"WITH {ROWS}, {_LEN}, b AS (SELECT *, {_SB} AS sn, {_TB} AS tn FROM ln) SELECT row_id, CAST(sn AS BIGINT) AS ids, CAST(tn AS BIGINT) AS labels FROM b")
def unsupervised_rows(spark, d):
    r = finetune.unsupervised(instructions(spark, d).select("row_id", F.coalesce("input", F.lit("")).alias("p"), F.coalesce("output", F.lit("")).alias("r")), "p", "r", 256)
    return r.select("row_id", F.size("input_ids").cast("long").alias("ids"), F.size("labels").cast("long").alias("labels"))


_SP, _TP = _budget("s", "greatest(t, j)", 256)


@query(f"WITH {ROWS}, {_LEN}, b AS (SELECT *, {_SP} AS sn, {_TP} AS tn FROM ln) SELECT row_id, CAST(sn + least(tn, t) AS BIGINT) AS chosen, CAST(sn + least(tn, j) AS BIGINT) AS rejected, CAST(sn AS BIGINT) AS masked FROM b")
def preference_encoding(spark, d):
    r = finetune.preference(instructions(spark, d).select("row_id", F.coalesce("input", F.lit("")).alias("p"), F.coalesce("output", F.lit("")).alias("c"), F.col("instruction").alias("j")), "p", "c", "j", 256)
    return r.select("row_id", F.size("chosen_input_ids").cast("long").alias("chosen"), F.size("rejected_labels").cast("long").alias("rejected"), F.size(F.filter("chosen_labels", lambda x: x == -100)).cast("long").alias("masked"))


@query(f"WITH {ROWS}, {_LEN}, b AS (SELECT *, {_SB} AS sn, {_TB} AS tn FROM ln) SELECT row_id // 32 AS batch, count(*) AS n, CAST(max(least(sn + tn, 200)) AS BIGINT) AS width, CAST(sum(least(sn + tn, 200)) AS BIGINT) AS real FROM b GROUP BY ALL")
def padded_batches(spark, d):
    r = finetune.supervised(instructions(spark, d).select(F.floor(F.col("row_id") / 32).alias("batch"), F.coalesce("input", F.lit("")).alias("p"), F.coalesce("output", F.lit("")).alias("r")), "p", "r", 256)
    p = finetune.padded_batches(r, "batch", 200)
    return p.groupBy("batch").agg(F.count("*").alias("n"), F.max(F.size("labels")).cast("long").alias("width"), F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("real"))


@query(f"WITH {ROWS}, {_LEN}, p AS (SELECT *, lag(output) OVER (PARTITION BY row_id // 32 ORDER BY row_id) AS b4, last_value(output) OVER (PARTITION BY row_id // 32 ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM ln), k AS (SELECT *, strlen(coalesce(coalesce(b4, z), '')) + 1 AS u FROM p), b AS (SELECT *, {_SB} AS sn, {_TB} AS tn, {_budget('s', 'u', 256)[0]} AS ks, {_budget('s', 'u', 256)[1]} AS kt FROM k) SELECT row_id, CAST(sn + tn AS BIGINT) AS n, CAST(ks + kt AS BIGINT) AS kl, row_id % 2 = 0 AS wanted FROM b")
def feedback_encoding(spark, d):
    r = instructions(spark, d).withColumn("batch", F.floor(F.col("row_id") / 32)).select("row_id", "batch", F.coalesce("input", F.lit("")).alias("p"), "output")
    r = finetune.mismatched(r, "batch", "row_id", "output").withColumn("r", F.coalesce("output", F.lit(""))).withColumn("o", F.coalesce("other", F.lit(""))).withColumn("good", F.col("row_id") % 2 == 0)
    x = finetune.feedback(r, "p", "r", "good", "o", 256)
    return x.select("row_id", F.size("input_ids").cast("long").alias("n"), F.size("kl_labels").cast("long").alias("kl"), F.col("kto_tags").alias("wanted"))


@query(f"WITH {ROWS}, {_LEN} SELECT row_id, CASE WHEN s <= 150 THEN CASE WHEN s + t - 1 <= 150 THEN 2 ELSE 1 END ELSE 0 END AS kept FROM ln")
def turns_within_limit(spark, d):
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    r = instructions(spark, d).select("row_id", F.array(turn("user", F.coalesce("input", F.lit(""))), turn("assistant", F.coalesce("output", F.lit("")))).alias("m"))
    return r.select("row_id", F.size(finetune.truncated_turns("m", lambda m: F.octet_length(m["content"]), 150)).alias("kept"))


@query(f"WITH {ROWS}, g AS (SELECT row_id // 64 AS batch, sum(strlen(coalesce(output, ''))) AS n FROM inst GROUP BY ALL) SELECT batch, CAST(unnest(range(0, CAST(n // 512 AS BIGINT))) AS INT) AS block, CAST(512 AS BIGINT) AS size FROM g")
def token_blocks(spark, d):
    r = instructions(spark, d).select(F.floor(F.col("row_id") / 64).alias("batch"), "row_id", finetune.byte_tokens(F.coalesce("output", F.lit(""))).alias("tokens"))
    return finetune.blocks(r, "batch", "row_id", "tokens", 512).select("batch", "block", F.size("ids").cast("long").alias("size"))


@query(f"WITH {ROWS} SELECT row_id, CAST((1 + row_id % 4) * (2 + row_id % 4) / 2 + (1 + row_id % 3) * (2 + row_id % 3) / 2 AS BIGINT) AS seen FROM inst")
def block_masks(spark, d):
    n = F.col("row_id")
    seg = F.concat(F.array_repeat(F.lit(1), (n % 4 + 1).cast("int")), F.array_repeat(F.lit(2), (n % 3 + 1).cast("int")), F.array_repeat(F.lit(0), (n % 2).cast("int")))
    m = instructions(spark, d).select("row_id", finetune.block_mask(seg).alias("m"))
    return m.select("row_id", F.size(F.filter(F.flatten("m"), lambda x: x)).cast("long").alias("seen"))


@query(f"WITH {ROWS}, x AS (SELECT row_id, [i % 5 FOR i IN range(row_id, row_id + 8)] AS p, [CASE WHEN i % 3 = 0 THEN -100 ELSE (i + row_id % 2) % 5 END FOR i IN range(row_id, row_id + 8)] AS l FROM inst), y AS (SELECT row_id, [(l[i + 1] = p[i]) FOR i IN range(1, 8) IF l[i + 1] <> -100] AS e FROM x) SELECT row_id, round(len(list_filter(e, lambda b: b)) / len(e), 6) AS accuracy FROM y")
def token_accuracy(spark, d):
    i = F.sequence(F.col("row_id"), F.col("row_id") + 7)
    p, lab = F.transform(i, lambda x: x % 5), F.transform(i, lambda x: F.when(x % 3 == 0, -100).otherwise((x + F.col("row_id") % 2) % 5))
    return instructions(spark, d).select("row_id", lab.alias("l"), p.alias("p")).select("row_id", F.round(metrics.masked_accuracy(F.col("l"), F.col("p")), 6).alias("accuracy"))


@query(f"WITH {ROWS}, s AS (SELECT file_name, row_id, row_number() OVER (PARTITION BY file_name ORDER BY md5(concat_ws('|', CAST(row_id AS VARCHAR), '2')), row_id) AS r, count(*) OVER (PARTITION BY file_name) AS n FROM inst), t AS (SELECT file_name, row_id, r / (1 + length(file_name) % 3) AS place, n / (1 + length(file_name) % 3) AS ends FROM s WHERE file_name IN (SELECT DISTINCT file_name FROM inst ORDER BY 1 LIMIT 3)) SELECT file_name, row_id, round(place, 6) AS place FROM t WHERE place <= (SELECT min(ends) FROM t)")
def interleaved_sets(spark, d):
    r = instructions(spark, d).select("file_name", "row_id")
    names = [x[0] for x in r.select("file_name").distinct().orderBy("file_name").limit(3).collect()]
    m = finetune.interleave([r.where(F.col("file_name") == n) for n in names], [1 + len(n) % 3 for n in names], "row_id", 2)
    return m.select("file_name", "row_id", F.round("place", 6).alias("place"))


@query(f"WITH {ROWS}, c AS (SELECT count(*) AS n FROM inst) SELECT CAST(i AS INT) AS copy, CASE WHEN i < CAST(floor(2.5 * n) AS BIGINT) // n THEN n ELSE CAST(floor(2.5 * n) AS BIGINT) % n END AS rows FROM c, range(0, 3) r(i)")
def resampled_sets(spark, d):
    r = instructions(spark, d).select("row_id")
    return finetune.resample(r, "row_id", int(2.5 * r.count()), 1).groupBy("copy").agg(F.count("*").alias("rows"))


@query("SELECT sample_id, 'system:The following are multiple choice questions (with answers) about ' || suite || '.' || chr(10) || chr(10) || '|user:Before?' || chr(10) || 'A. yes' || chr(10) || 'B. no' || chr(10) || 'Answer:|assistant:B|user:' || question || chr(10) || 'A. ' || suite || chr(10) || 'B. none' || chr(10) || 'Answer:' AS prompt FROM eval_inputs")
def few_shot_prompts(spark, d):
    ask = lambda q, a, b, w: F.struct(q.alias("question"), F.array(a, b).alias("choices"), F.lit(w).alias("answer"))
    shots = F.array(ask(F.lit("Before?"), F.lit("yes"), F.lit("no"), "B"))
    p = finetune.few_shot_prompt(shots, ask(F.col("question"), F.col("suite"), F.lit("none"), ""), F.col("suite"))
    return table(spark, d, "eval_inputs").select("sample_id", F.array_join(F.transform(p, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("prompt"))


@query(f"WITH {ROWS} SELECT row_id, 'find_' || row_id AS name, '{{\"n\": ' || row_id || '}}' AS arguments FROM inst WHERE row_id % 3 <> 0")
def tool_calls(spark, d):
    n = F.col("row_id").cast("string")
    t = F.when(F.col("row_id") % 3 == 0, "No tool.").otherwise(F.concat(F.lit("Thought\n"), finetune.tool_text(F.concat(F.lit("find_"), n), F.concat(F.lit('{"n": '), n, F.lit("}")))))
    return instructions(spark, d).select("row_id", finetune.tool_call(t).alias("c")).where("c is not null").select("row_id", "c.name", "c.arguments")


@query(f"WITH {ROWS} SELECT row_id, regexp_replace(coalesce(output, ''), '^\\s+', '') AS content FROM inst")
def without_thoughts(spark, d):
    m = F.array(F.struct(F.lit("assistant").alias("role"), F.concat(F.lit("<think>a\nb</think>\n"), F.coalesce("output", F.lit(""))).alias("content")))
    return instructions(spark, d).select("row_id", F.get(finetune.drop_thoughts(m), F.lit(0))["content"].alias("content"))


# --- scores of texts ----------------------------------------------------------------------------------------------------------
_GRAMS = """tk AS (SELECT row_id, regexp_extract_all(lower(coalesce(input, '')), '[一-鿿]|[a-z0-9]+') AS g, regexp_extract_all(lower(coalesce(output, '')), '[一-鿿]|[a-z0-9]+') AS s FROM inst),
 gr AS (SELECT row_id, k, unnest([array_to_string(g[i:i + k - 1], ' ') FOR i IN range(1, len(g) - k + 2)]) AS t FROM tk, range(1, 5) r(k)), sr AS (SELECT row_id, k, unnest([array_to_string(s[i:i + k - 1], ' ') FOR i IN range(1, len(s) - k + 2)]) AS t FROM tk, range(1, 5) r(k)),
 gc AS (SELECT row_id, k, t, count(*) AS n FROM gr GROUP BY ALL), sc AS (SELECT row_id, k, t, count(*) AS n FROM sr GROUP BY ALL), ov AS (SELECT row_id, k, sum(least(gc.n, sc.n)) AS hit FROM gc JOIN sc USING (row_id, k, t) GROUP BY ALL),
 al AS (SELECT row_id, len(g) AS gn, len(s) AS sn, k, coalesce(hit, 0) AS hit FROM (SELECT * FROM tk, range(1, 5) r(k)) LEFT JOIN ov USING (row_id, k))"""


@query(f"""WITH {ROWS}, {_GRAMS}, z AS (SELECT *, count(*) FILTER (hit = 0) OVER (PARTITION BY row_id ORDER BY k) AS zeros, greatest(sn - k + 1, 1) AS total FROM al),
 b AS (SELECT row_id, any_value(gn) AS gn, any_value(sn) AS sn, avg(ln(CASE WHEN hit > 0 THEN hit / total ELSE 1.0 / (pow(2, zeros) * total) END)) AS l FROM z GROUP BY row_id)
SELECT row_id, round(CASE WHEN sn = 0 THEN 0.0 ELSE exp(l) * CASE WHEN sn >= gn THEN 1.0 ELSE exp(1 - gn / sn) END END, 6) AS bleu, (SELECT round(CASE WHEN gn + sn = 0 THEN 1.0 ELSE 2.0 * hit / (gn + sn) END, 6) FROM al WHERE al.row_id = b.row_id AND k = 1) AS rouge_1,
 (SELECT round(CASE WHEN greatest(gn - 1, 0) + greatest(sn - 1, 0) = 0 THEN 1.0 ELSE 2.0 * hit / (greatest(gn - 1, 0) + greatest(sn - 1, 0)) END, 6) FROM al WHERE al.row_id = b.row_id AND k = 2) AS rouge_2 FROM b""")  # fmt: skip
def answer_quality(spark, d):
    """ROUGE-1, -2 and BLEU of outputs against inputs; ROUGE-L is tested against a plain table."""
    m = metrics.text_scores(tx.mixed_tokens("input"), tx.mixed_tokens("output"))
    return instructions(spark, d).select("row_id", m.alias("m")).select("row_id", *[F.round(f"m.{c}", 6).alias(c) for c in ("rouge_1", "rouge_2", "bleu")])


@query(f"WITH {ROWS} SELECT row_id, round(1 / (1 + exp(-(row_id % 7 - 3))), 6) AS sigmoid, round(exp(-(row_id % 5)) / (exp(-(row_id % 5)) + exp(-10.0)), 6) AS yes FROM inst")
def model_scores(spark, d):
    from ..operators import search

    n = F.col("row_id")
    return instructions(spark, d).select("row_id", F.round(vx.sigmoid(n % 7 - 3), 6).alias("sigmoid"), F.round(search.yes_no_probability(-(n % 5).cast("double"), F.lit(None).cast("double")), 6).alias("yes"))


@query(f"WITH {VECTORS}, p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL) SELECT vec_id, round(sqrt(list_dot_product(x, x)), 4) AS norm, round(CASE WHEN list_dot_product(x, x) * list_dot_product(y, y) > 1e-20 THEN list_cosine_similarity(x, y) ELSE 0 END, 5) AS cosine FROM p")
def vector_arithmetic(spark, d):
    v = vectors(spark, d).where("embedding is not null").select("vec_id", "embedding")
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return p.select("vec_id", F.round(vx.norm("embedding"), 4).alias("norm"), F.round(vx.cosine("embedding", "next"), 5).alias("cosine"))


# --- losses ------------------------------------------------------------------------------------------------------------------------
_PAIR8 = "b8 AS (SELECT a.vec_id // 8 AS batch, a.vec_id AS i, CAST(a.embedding AS DOUBLE[]) AS q, CAST(b.embedding AS DOUBLE[]) AS p, CAST(c.embedding AS DOUBLE[]) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings) JOIN embeddings c ON c.vec_id = (a.vec_id + 2) % (SELECT count(*) FROM embeddings))"


def _triples(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    shift = lambda k, c: e.select(F.pmod(F.col("vec_id") - k, F.lit(n)).alias("vec_id"), F.col("embedding").alias(c))
    j = e.join(shift(1, "p"), "vec_id").join(shift(2, "n"), "vec_id")
    return j.select(F.floor(F.col("vec_id") / 8).alias("batch"), F.col("vec_id").alias("i"), F.col("embedding").alias("q"), "p", "n")


@query(f"WITH {_PAIR8}, s AS (SELECT a.batch, a.i, b.i AS j, list_dot_product(a.q, b.p) / 0.05 AS s FROM b8 a JOIN b8 b USING (batch)), m AS (SELECT batch, i, max(s) AS m FROM s GROUP BY ALL), l AS (SELECT batch, i, any_value(m) + ln(sum(exp(s - m))) AS lse, max(CASE WHEN i = j THEN s END) AS own, any_value(m) AS m FROM s JOIN m USING (batch, i) GROUP BY ALL) SELECT round(avg(lse - own), 5) AS loss, round(avg(CASE WHEN own >= m THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM l")
def in_batch_loss(spark, d):
    t = _triples(spark, d).select("batch", "i", F.col("q").alias("qvec"), F.col("p").alias("dvec"))
    return losses.in_batch_softmax(t).select(F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {_PAIR8}, s AS (SELECT list_dot_product(q, p) / 0.05 AS a, list_dot_product(q, n) / 0.05 AS b FROM b8) SELECT round(avg(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) - a), 5) AS loss, round(avg(CASE WHEN a >= b THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s")
def triplet_loss(spark, d):
    t = _triples(spark, d).select(F.col("q").alias("qvec"), F.col("p").alias("pvec"), F.array("n").alias("nvecs"))
    return losses.triplet_softmax(t).select(F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {_PAIR8}, k(dim) AS (VALUES (16), (64)), u AS (SELECT dim, batch, i, [x / sqrt(list_dot_product(q[1:dim], q[1:dim])) FOR x IN q[1:dim]] AS s, [x / sqrt(list_dot_product(p, p)) FOR x IN p] AS t, [x / sqrt(list_dot_product(p[1:dim], p[1:dim])) FOR x IN p[1:dim]] AS w FROM b8, k),
 r AS (SELECT a.dim, a.batch, a.i, b.i AS j, list_dot_product(a.s, b.s) AS s, list_dot_product(a.t, b.t) AS t FROM u a JOIN u b ON a.dim = b.dim AND a.batch = b.batch), c AS (SELECT dim, avg(1 - list_dot_product(s, w)) AS c FROM u GROUP BY dim), m AS (SELECT dim, avg(pow(s - t, 2)) AS m FROM r GROUP BY dim),
 h AS (SELECT x.dim, avg(greatest(0.0, y.s - x.s + 0.015)) AS h FROM r x JOIN r y ON x.dim = y.dim AND x.batch = y.batch AND x.i = y.i WHERE x.i <> x.j AND y.i <> y.j AND x.t > y.t GROUP BY x.dim)
SELECT CAST(dim AS INT) AS dim, round(c, 5) AS cosine, round(m, 5) AS similarity, round(h, 5) AS triplet, round(10 * c + 200 * m + 20 * h, 4) AS loss FROM c JOIN m USING (dim) JOIN h USING (dim)""")  # fmt: skip
def distillation_loss(spark, d):
    t = _triples(spark, d).select("batch", "i", F.col("q").alias("student"), F.col("p").alias("teacher"))
    x = losses.distillation(t, (16, 64))
    return x.select("dim", *[F.round(c, 5).alias(c) for c in ("cosine", "similarity", "triplet")], F.round("loss", 4).alias("loss"))


@query(f"WITH {_PAIR8}, s AS (SELECT i // 8 AS query, list_dot_product(q, p) AS score, i % 2 AS label, list_dot_product(q, n) AS teacher FROM b8), m AS (SELECT query, max(score) AS ms, max(teacher) AS mt FROM s GROUP BY query), e AS (SELECT query, sum(exp(score - ms)) AS es, sum(exp(teacher - mt)) AS et FROM s JOIN m USING (query) GROUP BY query), k AS (SELECT query, sum(exp(teacher - mt) / et * ((teacher - mt - ln(et)) - (score - ms - ln(es)))) AS kl FROM s JOIN m USING (query) JOIN e USING (query) GROUP BY query) SELECT (SELECT round(avg(kl), 5) FROM k) AS kl, (SELECT round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 5) FROM s) AS bce")
def score_losses(spark, d):
    t = _triples(spark, d).select(F.floor(F.col("i") / 8).alias("query"), vx.dot("q", "p").alias("score"), (F.col("i") % 2).alias("label"), vx.dot("q", "n").alias("teacher"))
    return losses.kl_to_scores(t).select(F.round("loss", 5).alias("kl")).join(F.broadcast(losses.pointwise_bce(t).select(F.round("loss", 5).alias("bce"))))


@query("WITH h AS (SELECT vec_id, vec_id % 600 AS place, label FROM embeddings), c AS (SELECT *, unnest([('0-100', place < 100), ('100-200', place >= 100 AND place < 200), ('200-300', place >= 200 AND place < 300), ('300-400', place >= 300 AND place < 400), ('400-500', place >= 400 AND place < 500), ('500+', place >= 500)]) AS x FROM h) SELECT x[1] AS class, count(*) AS n, round(avg(label), 6) AS label FROM c WHERE x[2] GROUP BY ALL")
def scores_by_span(spark, d):
    e = table(spark, d, "embeddings").withColumn("label", F.col("label").cast("double"))
    return metrics.score_by_class(e, metrics.span_classes(F.col("vec_id") % 600), ("label",))


@query(f"WITH {_PAIR8} SELECT i % 4 AS place, count(*) AS n, round(avg(list_cosine_similarity(q, p)), 6) AS cosine FROM b8 GROUP BY ALL")
def segment_similarity(spark, d):
    t = _triples(spark, d)
    return metrics.segment_cosines(t.select(F.col("i").alias("doc"), (F.col("i") % 4).alias("place"), F.col("q").alias("vec")), t.select(F.col("i").alias("doc"), F.col("p").alias("vec")))


@query(f"WITH t AS (SELECT {_X} AS x, coalesce(lang, '') AS l FROM documents) SELECT l AS lang, count(*) AS n, count(DISTINCT x) AS texts FROM t GROUP BY l")
def distinct_texts(spark, d):
    t = table(spark, d, "documents").select(tx.collapse(F.coalesce("text", F.lit(""))).alias("x"), F.coalesce("lang", F.lit("")).alias("l"))
    return t.groupBy(F.col("l").alias("lang")).agg(F.count("*").alias("n"), F.count_distinct("x").alias("texts"))


@query(f"WITH {ROWS}, {_PAIRS}, x AS (SELECT id, CASE WHEN task_type = 'qa_with_keywords' THEN CASE WHEN starts_with(input, 'Q') THEN regexp_extract({_collapse('input')}, '^Question:\\s*(.*?)\\s*Keywords:\\s*.*$', 1) ELSE regexp_extract({_collapse('input')}, '^问题：\\s*(.*?)\\s*关键词：\\s*.*$', 1) END ELSE {_collapse('input')} END AS q FROM au) SELECT id, md5(q) AS q FROM x")
def retrieval_queries(spark, d):
    return _pairs(spark, d).select("id", F.md5(datasets.retrieval_query(F.col("input"), F.col("task_type"))).alias("q"))


@query(f"WITH {ROWS} SELECT row_id, round((row_id % 5) / 4.0, 6) AS label FROM inst")
def continuous_labels(spark, d):
    return instructions(spark, d).select("row_id", F.round(datasets.continuous_label(F.col("row_id") % 5, 0, 4), 6).alias("label"))


@query(f"WITH {ROWS} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'a,b' WHEN row_id % 3 = 1 THEN CAST(row_id AS VARCHAR) ELSE '' END AS ids FROM inst")
def normalised_query_ids(spark, d):
    n = F.col("row_id")
    many = F.when(n % 3 == 0, F.array(F.lit(" a "), F.lit(""), F.lit("b"))).when(n % 3 == 1, F.array(F.lit(" ")))
    return instructions(spark, d).select("row_id", F.array_join(datasets.query_ids(many, F.when(n % 3 == 1, n.cast("string")).otherwise(" ")), ",").alias("ids"))


@query(f"WITH {ROWS}, {_HIT}, c AS (SELECT q, pos, row_number() OVER (PARTITION BY q ORDER BY pos) - 1 AS place FROM hit), s AS (SELECT *, CASE WHEN place % 3 <> 2 THEN pos % 7 END AS score FROM c) SELECT q AS query_id, pos AS doc, CAST(place AS INT) AS place, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC NULLS LAST, place) AS INT) AS rank FROM s")
def scored_candidates(spark, d):
    from pyspark.sql.window import Window

    h = _hits(spark, d).select("query_id", F.col("pos").alias("doc"), (F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1).alias("place"))
    s = h.where("place % 3 <> 2").select("query_id", "place", (F.col("doc") % 7).cast("double").alias("score"))
    return datasets.query_pairs(h.select("query_id").distinct(), h, s)


@query(f"WITH {ROWS}, {_LEN}, b AS (SELECT *, {_TB} AS tn FROM ln) SELECT row_id // 32 AS batch, CAST(sum(tn) AS BIGINT) AS tokens FROM b GROUP BY ALL")
def valid_token_counts(spark, d):
    r = finetune.supervised(instructions(spark, d).select(F.floor(F.col("row_id") / 32).alias("batch"), F.coalesce("input", F.lit("")).alias("p"), F.coalesce("output", F.lit("")).alias("r")), "p", "r", 256)
    return r.groupBy("batch").agg(F.sum(finetune.valid_tokens("labels")).alias("tokens"))


@query(f"WITH {ROWS}, n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM inst) SELECT row_id, place FROM n WHERE place >= 10 AND place < 90 AND (place - 10) % 4 = 0")
def rows_at_places(spark, d):
    return finetune.rows_at(instructions(spark, d).select("row_id"), ["row_id"], 10, 90, 4)


@query(f"WITH {ROWS} SELECT row_id, md5(CASE WHEN length(trim(coalesce(system, ''))) > 0 THEN system || chr(10) || chr(10) ELSE '' END || 'Human: ' || coalesce(input, '') || chr(10) || 'Assistant:' || coalesce(output, '') || chr(10)) AS text FROM inst")
def plain_conversations(spark, d):
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), F.coalesce(c, F.lit("")).alias("content"))
    m = F.array(turn("user", F.col("input")), turn("assistant", F.col("output")))
    return instructions(spark, d).select("row_id", F.md5(finetune.render_plain(F.coalesce("system", F.lit("")), m)).alias("text"))


@query("SELECT a.vec_id, round(list_dot_product(CAST(list_concat(a.embedding, b.embedding) AS DOUBLE[]), CAST(list_concat(b.embedding, a.embedding) AS DOUBLE[])), 5) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def joined_teachers(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), "vec")
    j = finetune.joined_vectors(e, other, "vec_id").join(finetune.joined_vectors(other, e, "vec_id").withColumnRenamed("vec", "w"), "vec_id")
    return j.select("vec_id", F.round(vx.dot("vec", "w"), 5).alias("x"))


@query(f"""WITH {ROWS}, t AS (SELECT row_id, coalesce(output, '') AS o, length(coalesce(output, '')) AS n, length(coalesce(output, '')) // 3 AS k FROM inst), p AS (SELECT row_id, o, n, [{{'h': md5(concat_ws('|', CAST(row_id AS VARCHAR), '1')), 'p': substr(o, 1, k)}}, {{'h': md5(concat_ws('|', CAST(row_id AS VARCHAR), '2')), 'p': substr(o, k + 1, k)}}, {{'h': md5(concat_ws('|', CAST(row_id AS VARCHAR), '3')), 'p': substr(o, 2 * k + 1)}}] AS ps FROM t)
SELECT row_id, md5(CASE WHEN n >= 3 AND CAST('0x' || substr(md5(concat_ws('|', CAST(row_id AS VARCHAR), '0')), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 THEN array_to_string(list_transform(list_sort(ps), lambda x: x.p), '') ELSE o END) AS text FROM p""")  # fmt: skip
def shuffled_texts(spark, d):
    return instructions(spark, d).select("row_id", F.md5(datasets.shuffled_text(F.coalesce("output", F.lit("")), "row_id", 0.5)).alias("text"))
