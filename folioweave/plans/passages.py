"""Queries on the rules for passages, questions and answers. Their SQL holds its own literals, so that a slip in the
engine's fixed values shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, datasets, metrics, quality
from ..session import table
from .catalogue import ROWS, STORE, WS, _collapse, instructions, query, store

_X = _collapse("coalesce(text, '')")
_XI = _collapse("coalesce(input, '')")
_W = r"[\pL\pN_]"


def word(x: str, words: str, flags: str = "") -> str:
    """Whether one of the words stands alone in x, by Unicode."""
    return f"regexp_matches({x}, '{flags}(?:^|[^\\pL\\pN_])(?:{words})(?:$|[^\\pL\\pN_])')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


_IR = "information retrieval|inverted index|postings list|boolean retrieval|vector space model|tf-idf|bm25|query|document|term frequency|tokenization|stemming|ranking|indexing|relevance feedback|cosine similarity|precision|recall|dictionary|retrieval model|collection|vocabulary"
_N = f"len(regexp_extract_all({_X}, '[^ ]+'))"
_SENTS = f"len(list_filter(string_split_regex(regexp_replace({_X}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))"
_NOISE = f"(CASE WHEN {_X} = '' THEN 1.0 ELSE len(regexp_extract_all({_X}, '[^\\pL\\pN_ .,;:!?()\\-\\[\\]/%]+')) / length({_X}) END)"
_LOWINFO = f"({_X} = '' OR regexp_matches({_X}, '(?i)^(chapter\\s+\\d+|exercise\\s+\\d+|references?$|bibliography$|index$|summary$|in this chapter|we will see|this chapter)'))"
_STARTS = f"({_X} = '' OR regexp_matches({_X}, '^[.,;:)]') OR regexp_matches(lower(substr({_X}, 1, 80)), '^(however|but|thus|therefore|moreover|furthermore|for example|for instance|in this case|in particular|they|it|this|these|such|he|she|we)'))"
_ENDS = f"({_X} = '' OR (NOT regexp_matches({_X}, '[.!?]$') AND (regexp_matches({_X}, '[,:;(-]$') OR regexp_matches(lower(right({_X}, 30)), '(^|[^\\pL\\pN_])(and|or|of|to|for|with|by|in|on|that)$'))))"
_HIGH = f"(regexp_matches(lower({_X}), '{_IR}') OR ({word(f'lower({_X})', 'is|are|refers to|defined as|means|consists of|can be')} AND {_N} >= 8))"
_CAPTION = f"regexp_matches({_X}, '(?i)^[◮]?\\s*(figure|fig\\.?|table|algorithm)\\s+\\d+(\\.\\d+)*($|[^\\pL\\pN_])')"
_EXERCISE = f"regexp_matches({_X}, '(?i)(^|[^\\pL\\pN_])exercise\\s+\\d+(\\.\\d+)*($|[^\\pL\\pN_])')"
# marks such as 1. before a word, counted by splitting at the dots
_DOTS = f"string_split({_X}, '.')"
_MARKS = f"len(list_filter(range(1, len({_DOTS})), lambda i: regexp_matches({_DOTS}[i], '(^|[^\\pL\\pN_])\\d+$') AND regexp_matches({_DOTS}[i + 1], '^[\\pL\\pN_]')))"
_STEPS = f"(regexp_matches({_X}, '^[A-Za-z]\\.|^\\d+\\.\\s') OR {_MARKS} >= 2)"
_KNOWS = f"({word(f'lower({_X})', 'is|are|refers to|defined as|means|unlike|in contrast|distinguished|compared with|compared to|because|therefore|thus|so that|allows|used to|by|algorithm|process|method|procedure|step')})"
_SHOWN = f"(NOT {_CAPTION} AND ({word(_X, 'figure|fig|table|algorithm|as shown in|see|shown in', '(?i)')} OR regexp_matches({_X}, '(?i)(^|[^\\pL\\pN_])fig\\.[\\pL\\pN_]')) AND NOT has_figure)"
_ROUTE = f"""CASE WHEN {_X} = '' THEN 'drop/empty' WHEN {_NOISE} > 0.08 THEN 'drop/too_noisy' WHEN {_LOWINFO} THEN 'drop/low_information'
 WHEN {_STARTS} AND {_ENDS} THEN 'drop/incomplete_both_ends' WHEN {_EXERCISE} THEN 'drop/exercise_or_question_block' WHEN {_SHOWN} THEN 'drop/caption_or_strong_figure_dependency'
 WHEN {_N} >= 50 AND {_SENTS} >= 2 AND NOT {_STEPS} AND NOT {_STARTS} AND {_KNOWS} THEN 'core_rule/rule_high_quality'
 WHEN {_HIGH} AND {_N} BETWEEN 8 AND 49 AND {_SENTS} <= 2 AND NOT {_STARTS} AND NOT {_STEPS} THEN 'extra_rule/rule_short_but_complete'
 WHEN {_HIGH} AND {_N} >= 8 THEN 'need_llm/borderline_high_value' ELSE 'need_llm/borderline' END"""
FIGURED = "fig AS (SELECT unique_id AS uid, page_content AS text, coalesce(len(metadata.figure_refs), 0) > 0 AS has_figure FROM manual_info QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ingested_at) = 1)"


def figured(spark, d):
    m = table(spark, d, "manual_info").select(F.col("unique_id").alias("uid"), F.col("page_content").alias("text"), (F.coalesce(F.size("metadata.figure_refs"), F.lit(0)) > 0).alias("has_figure"), "ingested_at")
    from ..operators import fusion

    return fusion.first_of(m, ["uid"], ["ingested_at"])


@query(f"WITH {FIGURED} SELECT uid, split_part({_ROUTE}, '/', 1) AS route, split_part({_ROUTE}, '/', 2) AS reason FROM fig")
def quality_routes(spark, d):
    return quality.with_quality(figured(spark, d), "text", F.col("has_figure")).select("uid", "route", "reason")


@query(f"WITH {FIGURED}, r AS (SELECT {_ROUTE} AS r FROM fig) SELECT split_part(r, '/', 1) AS route, split_part(r, '/', 2) AS reason, count(*) AS n FROM r GROUP BY r")
def quality_route_counts(spark, d):
    return quality.route_counts(quality.with_quality(figured(spark, d), "text", F.col("has_figure")))


@query(f"SELECT doc_id, {_STARTS} AS starts, {_ENDS} AS ends, {_HIGH} AS high, {_EXERCISE} AS exercise FROM documents")
def quality_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.starts_incomplete("text").alias("starts"), tx.ends_incomplete("text").alias("ends"), tx.high_value("text").alias("high"), F.coalesce(tx.is_exercise("text"), F.lit(False)).alias("exercise"))


@query(f"SELECT doc_id, CAST({_N} AS BIGINT) AS words, CAST({_SENTS} AS BIGINT) AS sentences, round({_NOISE}, 6) AS noise, {_CAPTION} AS caption, {_STEPS} AS steps, {_KNOWS} AS knowledge, {_LOWINFO} AS low_information, {_SHOWN} AS needs_figure FROM (SELECT *, doc_id % 3 = 0 AS has_figure FROM documents)")
def passage_flags(spark, d):
    f = quality.passage_flags("text", F.col("doc_id") % 3 == 0)
    return table(spark, d, "documents").select(
        "doc_id", f["words"].cast("long").alias("words"), f["sentences"].cast("long").alias("sentences"), F.round(f["noise"], 6).alias("noise"), *[f[c].alias(c) for c in ("caption", "steps", "knowledge", "low_information", "needs_figure")]
    )


_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'extra' WHEN 2 THEN 'drop' ELSE 'unsure' END"


@query(f"""WITH x AS (SELECT *, {_LABEL} AS raw, doc_id % 3 = 0 AS has_figure FROM documents), y AS (SELECT *, CASE WHEN raw = 'unsure' THEN 'extra' ELSE raw END AS label FROM x)
SELECT doc_id, label, CASE WHEN raw = 'unsure' THEN 'llm_error_fallback_extra:invalid_label:unsure' ELSE 'unknown' END AS reason,
 CASE WHEN {_EXERCISE} OR {_SHOWN} THEN label <> 'drop' ELSE (label = 'core' AND ({_N} < 35 OR {_SENTS} <= 1)) OR (label = 'drop' AND {_HIGH} AND {_N} >= 18)
  OR (label = 'core' AND {_ROUTE} = 'need_llm/borderline_high_value' AND NOT {_KNOWS}) END AS again FROM y""")  # fmt: skip
def labels_to_judge_again(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, "core").when(F.col("doc_id") % 4 == 1, "extra").when(F.col("doc_id") % 4 == 2, "drop").otherwise("unsure")
    x = table(spark, d, "documents").withColumn("j", quality.judged_label(raw, F.lit(None).cast("string"))).select("*", "j.label", "j.reason")
    fig = F.col("doc_id") % 3 == 0
    return x.select("doc_id", "label", "reason", quality.asks_again("text", F.col("label"), quality.quality_route("text", fig)["reason"], F.col("reason"), fig).alias("again"))


@query(f"SELECT doc_id, CASE WHEN (CASE a WHEN 'drop' THEN 0 WHEN 'extra' THEN 1 ELSE 2 END) <= (CASE b WHEN 'drop' THEN 0 WHEN 'extra' THEN 1 ELSE 2 END) THEN a ELSE b END AS label FROM (SELECT doc_id, ['drop', 'extra', 'core'][1 + doc_id % 3] AS a, ['drop', 'extra', 'core'][1 + (doc_id // 3) % 3] AS b FROM documents)")
def stricter_labels(spark, d):
    pick = lambda x: F.element_at(F.array(F.lit("drop"), F.lit("extra"), F.lit("core")), (x + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", quality.stricter(pick(F.col("doc_id") % 3), pick(F.floor(F.col("doc_id") / 3) % 3)).alias("label"))


# --- lines and units ---------------------------------------------------------------------------------------------------
_LINES = f"l AS (SELECT uid, unnest(string_split(text, chr(10))) AS raw FROM store), x AS (SELECT uid, raw, {_collapse('raw')} AS line, {strip('raw')} AS s FROM l)"


def _lines(spark, d):
    return store(spark, d).select("uid", F.explode(F.split("text", "\n")).alias("raw"))


@query(f"""WITH {STORE}, {_LINES} SELECT line, count(*) AS n FROM x
WHERE regexp_matches(line, '(?i)^(\\d+|page\\s+\\d+|page\\s+\\d+\\s+of\\s+\\d+|-\\s*\\d+\\s*-|\\[\\d+\\]|\\d+\\s*/\\s*\\d+|p\\.\\s*\\d+|page\\s*[ivxlcdm]+|[ivxlcdm]+)$') GROUP BY line""")
def page_number_lines(spark, d):
    return _lines(spark, d).select(tx.collapse("raw").alias("line")).where(tx.is_page_number("line")).groupBy("line").agg(F.count("*").alias("n"))


_CAP = "'(?i)^[◮•●■□]*\\s*(figure|fig\\.?|table|tab\\.?|algorithm|box)\\s+(\\d+(?:\\.\\d+)?)($|[^\\pL\\pN_])'"


@query(f"""WITH {STORE}, {_LINES} SELECT uid, line, CASE WHEN lower(regexp_extract(line, {_CAP}, 1)) LIKE 'fig%' THEN 'figure' WHEN lower(regexp_extract(line, {_CAP}, 1)) LIKE 'tab%' THEN 'table' ELSE lower(regexp_extract(line, {_CAP}, 1)) END AS kind,
 regexp_extract(line, {_CAP}, 1) || ' ' || regexp_extract(line, {_CAP}, 2) AS name FROM x WHERE regexp_matches(line, {_CAP})""")
def captions(spark, d):
    return _lines(spark, d).select("uid", tx.collapse("raw").alias("line")).select("*", tx.caption_kind("line").alias("kind"), tx.caption_name("line").alias("name")).where("kind is not null")


_HEAD = "(length(s) > 0 AND length(s) <= 150 AND (regexp_matches(s, '^\\d+(\\.\\d+)*\\s+[A-Z]|^(Chapter|CHAPTER)\\s+\\d|^(Appendix|APPENDIX)\\s+[A-Z0-9]|^(Figure|Table)\\s+\\d+(\\.\\d+)?($|[^a-zA-Z0-9_])|^(References|REFERENCES|Bibliography|BIBLIOGRAPHY|Index|INDEX)$') OR (len(regexp_extract_all(s, '\\pL')) BETWEEN 1 AND 40 AND len(regexp_extract_all(s, '\\p{Lu}')) > 0.75 * len(regexp_extract_all(s, '\\pL')))))"
_SECTION = f"({_HEAD} OR regexp_matches(s, '^\\d+(\\.\\d+)*\\s+[A-Z]'))"


@query(f"""WITH {STORE}, {_LINES} SELECT uid, raw, count(*) AS n, any_value({_HEAD}) AS heading, any_value(regexp_matches(s, '[A-Za-z0-9,(\\[-]$')) AS unfinished,
 any_value(length(s) > 0 AND NOT {_SECTION} AND regexp_matches(s, '^[a-z]|^[)\\],;:]|^\\d+\\.\\s|(?i)^(and|or|but|that|which|who|where|when|with|by|to|of|for|in|on|as|is|are|was|were|be|been|being)($|[^\\pL\\pN_])')) AS goes_on,
 any_value(regexp_matches(line, '(?i)^(figure|fig\\.?|table)\\s+\\d+(\\.\\d+)*($|[^\\pL\\pN_])')) AS caption FROM x GROUP BY uid, raw""")
def line_flags(spark, d):
    x = _lines(spark, d).groupBy("uid", "raw").agg(F.count("*").alias("n"))
    return x.select("uid", "raw", "n", tx.looks_like_heading("raw").alias("heading"), tx.ends_unfinished("raw").alias("unfinished"), tx.starts_as_continuation("raw").alias("goes_on"), tx.starts_caption("raw").alias("caption"))


_SIMPLE = f"string_split(regexp_replace({_X}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""WITH s AS (SELECT doc_id, unnest({_SIMPLE}) AS t FROM documents), x AS (SELECT doc_id, t, lower(t) AS l FROM s WHERE t <> '')
SELECT CASE WHEN regexp_matches(l, '^(however|in contrast|on the other hand|at the other extreme|in between|by contrast|nevertheless|thus|meanwhile|instead)($|[^\\pL\\pN_])') THEN 'transition'
 WHEN regexp_matches(l, '^(for example|for instance|as an example|consider)($|[^\\pL\\pN_])') OR {word('l', 'such as')} THEN 'example'
 WHEN {word('l', 'is defined as|refers to|is the task of|is finding|the term|means|is a model for')} THEN 'definition'
 WHEN regexp_matches(l, '^(\\(?\\d+\\)|\\d+\\.)\\s+|^(first|second|third)($|[^\\pL\\pN_])') THEN 'enumeration' ELSE 'normal' END AS role, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY role""")  # fmt: skip
def body_roles(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.explode(tx.simple_sentences("text")).alias("t"))
    return s.groupBy(tx.body_role("t").alias("role")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


# sentences: abbreviations held, parts cut before capitals, list items apart
_PROTECT = ["e.g.", "i.e.", "etc.", "Fig.", "Figs.", "Eq.", "Eqs.", "Dr.", "Mr.", "Mrs.", "vs.", "No.", "Sec.", "Ch."]
_HELD = _X
for _i, _a in enumerate(_PROTECT):
    _HELD = f"replace({_HELD}, '{_a}', chr({0xE000 + _i}))"
# RE2 has no look-ahead: the character after the cut is put back
_CUT = f"string_split(regexp_replace({_HELD}, '([.!?]) +([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(f"SELECT doc_id, CAST(len({_CUT}) AS BIGINT) AS n, CAST(list_max(list_transform({_CUT}, lambda s: length(s))) AS BIGINT) AS longest FROM documents WHERE {_X} <> '' AND NOT regexp_matches({_X}, '(^|[^\\pL\\pN_])(\\(?\\d+\\)|\\d+\\.|[A-Za-z]\\)) +[A-Z]') AND NOT regexp_matches({_HELD}, '[.!?] [A-Z0-9\"''][.!?] ')")
def plain_sentences(spark, d):
    """Sentences of the texts without list marks (those with marks are tested against a plain version)."""
    x = tx.collapse("text")
    t = table(spark, d, "documents").where((x != "") & ~x.rlike(r"(?:^|[^\p{L}\p{N}_])(?:\(?\d+\)|\d+\.|[A-Za-z]\)) +[A-Z]"))
    held = x
    for i, a in enumerate(_PROTECT):
        held = F.replace(held, F.lit(a), F.lit(chr(0xE000 + i)))
    t = t.where(~held.rlike(r"[.!?] [A-Z0-9\"'][.!?] "))
    s = F.filter(tx.sentences("text", 0), lambda p: F.length(p) > 0)

    def short(p):
        # a held abbreviation is one character in the other query
        for a in _PROTECT:
            p = F.replace(p, F.lit(a), F.lit("#"))
        return p

    s = F.transform(s, short)  # a second parameter of the function would be the place in the array
    return t.select("doc_id", F.size(s).cast("long").alias("n"), F.array_max(F.transform(s, lambda p: F.length(p))).cast("long").alias("longest"))


@query(f"""WITH {STORE}, m AS (SELECT uid, generate_subscripts(f, 1) AS i, unnest(f) AS ref FROM (SELECT uid, regexp_extract_all({_X}, '(?i)\\b(?:figure|fig\\.?|table)\\s+\\d+(?:\\.\\d+)*\\b') AS f FROM store)),
 r AS (SELECT uid, i, (CASE WHEN lower(ref) LIKE 'table%' THEN 'Table ' ELSE 'Figure ' END) || regexp_extract(ref, '(\\d+(?:\\.\\d+)*)$', 1) AS ref FROM m)
SELECT uid, ref, CAST(min(i) AS BIGINT) AS first FROM r GROUP BY uid, ref""")
def figure_references(spark, d):
    s = store(spark, d).select("uid", F.regexp_extract_all(tx.collapse("text"), F.lit(r"(?i)\b(?:Figure|Fig\.?|Table)\s+\d+(?:\.\d+)*\b"), F.lit(0)).alias("all"), tx.references("text").alias("refs"))
    s = s.select("uid", F.explode("refs").alias("ref"), F.transform("all", tx.caption_label).alias("all"))
    return s.select("uid", "ref", F.array_position("all", F.col("ref")).alias("first"))


_NOTE_STOPS = "the a an and or but if then else of to in on for with by as at from is are was were be been being this that these those it its he she they them their we our you your i my do does did done have has had not no yes can could may might must should would than such into about over under also however there here thus"


def note_set(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) >= 2 AND NOT list_contains(string_split('{_NOTE_STOPS}', ' '), w)))"


@query(f"""WITH {ROWS}, t AS (SELECT row_id, {note_set('output')} AS s, {note_set('input')} AS n FROM inst), o AS (SELECT row_id, s, n, list_intersect(s, n) AS k FROM t)
SELECT row_id, round(CASE WHEN len(k) = 0 THEN 0.0 ELSE least(1.0, 0.65 * len(k) / greatest(len(n), 1) + 0.25 * len(k) / greatest(len(s), 1) + list_sum(list_transform(k, lambda w: CASE WHEN length(w) >= 6 THEN 0.08 WHEN length(w) >= 4 THEN 0.04 ELSE 0.0 END))
 + CASE WHEN len(list_filter(k, lambda w: length(w) >= 5)) > 0 THEN 0.08 ELSE 0.0 END) END, 6) AS score FROM o""")  # fmt: skip
def footnote_scores(spark, d):
    return instructions(spark, d).select("row_id", F.round(chunking.footnote_score("output", "input"), 6).alias("score"))


@query(f"""WITH {ROWS} SELECT row_id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_distinct(w)) AS BIGINT) AS kinds FROM (SELECT row_id, list_filter(regexp_extract_all(lower(coalesce(output, '')), '[a-z]+(?:-[a-z]+)?|\\d+(?:\\.\\d+)*'),
 lambda w: NOT list_contains(string_split('the a an of to in on for and or by with as at from is are was were be', ' '), w) AND (length(w) > 1 OR regexp_matches(w, '^\\d$'))) AS w FROM inst)""")
def overlap_tokens(spark, d):
    w = tx.overlap_list("output")
    return instructions(spark, d).select("row_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("kinds"))


# --- questions and answers ---------------------------------------------------------------------------------------------
_QTYPE = f"""CASE WHEN regexp_matches(q, '[一-鿿]') THEN CASE WHEN regexp_matches(q, '^什么是') THEN 'definition' WHEN regexp_matches(q, '代表什么|如何表示|怎么表示|是如何表示的|含义是什么') THEN 'representation'
 WHEN regexp_matches(q, '区别|不同|相比|相比之下|优于|劣于|哪个更|哪一个更') THEN 'comparison' WHEN regexp_matches(q, '^为什么|为何|原因是什么') THEN 'reason' WHEN regexp_matches(q, '^如何|怎样|怎么|如何处理|如何工作|如何实现|如何构建') THEN 'mechanism'
 WHEN regexp_matches(q, '^(谁|何时|什么时候|哪里|哪种|哪些|多少|多长时间|哪个)') THEN 'factoid' ELSE 'other' END
 ELSE CASE WHEN regexp_matches(q, '^what (is|are)($|[^\\pL\\pN_])') THEN 'definition' WHEN (regexp_matches(q, '^(what does|how are)($|[^\\pL\\pN_])') AND contains(q, 'represent')) OR contains(q, 'represented') THEN 'representation'
 WHEN {word('q', 'difference|compare|compared|versus|vs|better|worse|more commonly')} OR regexp_matches(q, '(^|[^\\pL\\pN_])vs\\.[\\pL\\pN_]') THEN 'comparison' WHEN regexp_matches(q, '^why($|[^\\pL\\pN_])') THEN 'reason' WHEN regexp_matches(q, '^how($|[^\\pL\\pN_])') THEN 'mechanism'
 WHEN regexp_matches(q, '^(when|where|who|which|how many|how long)($|[^\\pL\\pN_])') THEN 'factoid' ELSE 'other' END END"""


@query(f"WITH {ROWS}, x AS (SELECT row_id, lower({_XI}) AS q FROM inst) SELECT row_id, {_QTYPE} AS type FROM x")
def question_types(spark, d):
    return instructions(spark, d).select("row_id", tx.question_type("input").alias("type"))


@query(f"WITH q AS (SELECT sample_id, lower({_collapse('question')}) AS q FROM eval_inputs) SELECT {_QTYPE} AS type, count(*) AS n FROM q GROUP BY type")
def eval_question_types(spark, d):
    return table(spark, d, "eval_inputs").groupBy(tx.question_type("question").alias("type")).agg(F.count("*").alias("n"))


def _norm(x: str) -> str:
    return f"lower({_collapse(f'''regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')''')})"


def _none(x: str) -> str:
    return f"(replace({_norm(x)}, ' ', '') IN ('不知道', '不清楚', '无法回答', '无法根据当前知识回答') OR starts_with(replace({_norm(x)}, ' ', ''), '无答案'))"


#: Answers that are compared with the next row's: every seventh says that there is none.
_SAID = "p AS (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN '无答案。' WHEN row_id % 11 = 0 THEN ' 不 知道 ' ELSE output END AS gold, CASE WHEN row_id % 5 = 0 THEN '无法回答' WHEN row_id % 3 = 0 THEN '<i>' || output || '</i>' ELSE input END AS said FROM inst)"


def _said(spark, d):
    r, n = instructions(spark, d), F.col("row_id")
    gold = F.when(n % 7 == 0, "无答案。").when(n % 11 == 0, " 不 知道 ").otherwise(F.col("output"))
    return r.select("row_id", gold.alias("gold"), F.when(n % 5 == 0, "无法回答").when(n % 3 == 0, F.concat(F.lit("<i>"), F.col("output"), F.lit("</i>"))).otherwise(F.col("input")).alias("said"))


@query(f"WITH {ROWS}, {_SAID} SELECT row_id, {_none('gold')} AS gold_none, {_none('said')} AS said_none FROM p")
def no_answer_rows(spark, d):
    return _said(spark, d).select("row_id", tx.is_no_answer("gold").alias("gold_none"), tx.is_no_answer("said").alias("said_none"))


_STATUS = f"CASE WHEN {_norm('gold')} = {_norm('said')} THEN 'exact_match' WHEN {_none('gold')} AND {_none('said')} THEN 'correct_no_answer' WHEN {_none('gold')} THEN 'missed_no_answer' WHEN {_none('said')} THEN 'false_no_answer' ELSE 'content_mismatch' END"


@query(f"WITH {ROWS}, {_SAID} SELECT row_id, {_STATUS} AS status FROM p")
def answer_statuses(spark, d):
    return _said(spark, d).select("row_id", metrics.answer_status("gold", "said").alias("status"))


_MIX = "'[一-鿿]|[a-z0-9]+'"
_F1 = f"""t AS (SELECT row_id, gold, said, regexp_extract_all({_norm('gold')}, {_MIX}) AS g, regexp_extract_all({_norm('said')}, {_MIX}) AS s FROM p),
 a AS (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest(g) AS w FROM t) GROUP BY ALL), b AS (SELECT row_id, w, count(*) AS n FROM (SELECT row_id, unnest(s) AS w FROM t) GROUP BY ALL),
 c AS (SELECT row_id, sum(least(a.n, b.n)) AS k FROM a JOIN b USING (row_id, w) GROUP BY row_id), f AS (SELECT t.*, CASE WHEN len(g) + len(s) = 0 THEN 1.0 ELSE 2.0 * coalesce(k, 0) / (len(g) + len(s)) END AS f1, {_none('gold')} AS gn, {_none('said')} AS sn, {_norm('gold')} = {_norm('said')} AS same FROM t LEFT JOIN c USING (row_id))"""


@query(f"""WITH {ROWS}, {_SAID}, {_F1} SELECT count(*) AS sample_count, count_if(NOT gn) AS answerable_count, count_if(gn) AS unanswerable_count, round(avg(CAST(same AS INT)), 6) AS exact_match, round(avg(f1), 6) AS token_f1, round(avg(f1), 6) AS rouge_l_f1,
 round(avg(CAST(gn = sn AS INT)), 6) AS no_answer_accuracy, round(coalesce(avg(f1) FILTER (NOT gn), 0), 6) AS avg_token_f1_answerable, round(coalesce(avg(f1) FILTER (gn), 0), 6) AS avg_token_f1_unanswerable, count_if(NOT gn AND sn) AS false_no_answer_count,
 count_if(gn AND NOT sn) AS missed_no_answer_count, CAST(count_if(same) AS BIGINT) AS exact_match_count, round(stddev_pop(f1), 6) AS token_f1_std FROM f""")  # fmt: skip
def prediction_report(spark, d):
    """The report's ROUGE-L column gets token F1 here, as SQL has no longest common subsequence."""
    p = _said(spark, d).select("*", tx.comparable("gold").alias("g"), tx.comparable("said").alias("s"))
    f1 = metrics.token_f1_table(p, "row_id", "g", "s")
    return metrics.prediction_report(p.join(f1, "row_id"), rouge="f1")


@query(f"WITH {ROWS}, {_SAID}, {_F1} SELECT row_id, round(f1, 6) AS f1 FROM f ORDER BY f1, row_id LIMIT 10")
def worst_predictions(spark, d):
    p = _said(spark, d).select("*", tx.comparable("gold").alias("g"), tx.comparable("said").alias("s"))
    f1 = metrics.token_f1_table(p, "row_id", "g", "s")
    return metrics.extreme_cases(f1, ("f1",), 10, "row_id").select("row_id", F.round("f1", 6).alias("f1"))


@query(f"""WITH {ROWS}, x AS (SELECT row_id, '<think>so' || chr(10) || 'on</think><answer> ' || coalesce(output, '') || '【1，3】【2, 3】【x】</answer>' AS raw, coalesce(output, '') AS o FROM inst)
SELECT row_id, {_collapse("regexp_replace(regexp_replace(o || '【1，3】【2, 3】【x】', '<[^>]+>', '', 'g'), '【[^】]*】', '', 'g')")} AS answer, '1,3,2' AS cited FROM x WHERE NOT regexp_matches(o, '【|<')""")
def cited_answers(spark, d):
    raw = F.concat(F.lit("<think>so\non</think><answer> "), F.coalesce("output", F.lit("")), F.lit("【1，3】【2, 3】【x】</answer>"))
    r = instructions(spark, d).where(~F.coalesce("output", F.lit("")).rlike("【|<")).withColumn("raw", raw)
    return r.select("row_id", tx.answer_text("raw").alias("answer"), F.array_join(tx.citations("raw").cast("array<string>"), ",").alias("cited"))


@query(f"""WITH {ROWS}, w AS (SELECT row_id, list_filter(list_transform(string_split(coalesce(output, ''), ','), lambda w: trim({_collapse('w')}, ',，;； ')), lambda w: w <> '') AS k FROM inst),
 u AS (SELECT row_id, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM w), f AS (SELECT row_id, w, i FROM u QUALIFY row_number() OVER (PARTITION BY row_id, lower(w) ORDER BY i) = 1), t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY i) <= 5)
SELECT row_id, string_agg(w, '|' ORDER BY i) AS keywords FROM t GROUP BY row_id""")
def clean_keywords(spark, d):
    k = tx.clean_keywords(F.split(F.coalesce("output", F.lit("")), ","))
    return instructions(spark, d).select("row_id", F.array_join(k, "|").alias("keywords")).where(F.size(k) > 0)


@query(f"""WITH {ROWS}, r AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{{"n": ' || row_id || '}}' || chr(10) || '```' WHEN 1 THEN '<result> [' || row_id || ', 2] </result>' WHEN 2 THEN 'I say {{"n": ' || row_id || '}} here' ELSE 'none' END AS t FROM inst)
SELECT row_id, CASE row_id % 4 WHEN 1 THEN '[' || row_id || ', 2]' ELSE '{{"n": ' || row_id || '}}' END AS payload FROM r WHERE row_id % 4 <> 3""")
def json_payloads(spark, d):
    n = F.col("row_id").cast("string")
    t = (
        F.when(F.col("row_id") % 4 == 0, F.concat(F.lit('Sure:\n```json\n{"n": '), n, F.lit("}\n```"))).when(F.col("row_id") % 4 == 1, F.concat(F.lit("<result> ["), n, F.lit(", 2] </result>")))
        .when(F.col("row_id") % 4 == 2, F.concat(F.lit('I say {"n": '), n, F.lit("} here"))).otherwise("none")
    )
    return instructions(spark, d).select("row_id", tx.json_payload(t).alias("payload")).where("payload is not null")


@query(f"""WITH {ROWS}, w AS (SELECT row_id, list_filter(list_transform(string_split(coalesce(output, ''), chr(10)), lambda w: {_collapse("regexp_replace(w, '^\\s*\\d+[.)、]\\s*', '')")}), lambda w: w <> '') AS k FROM inst),
 u AS (SELECT row_id, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM w), f AS (SELECT row_id, w, i FROM u QUALIFY row_number() OVER (PARTITION BY row_id, lower(w) ORDER BY i) = 1)
SELECT row_id, md5(string_agg(w, '|' ORDER BY i)) AS lines, count(*) AS n FROM f GROUP BY row_id""")
def numbered_lines(spark, d):
    k = datasets.numbered_lines(F.col("output"))
    return instructions(spark, d).select("row_id", F.md5(F.array_join(k, "|")).alias("lines"), F.size(k).cast("long").alias("n")).where("n > 0")


_YES = lambda x: f"CASE WHEN {x} THEN '是' ELSE '否' END"
_SHOW = f"""'正文：' || chr(10) || {_X} || chr(10) || chr(10) || '辅助信息：' || chr(10) || '- 是否涉及图表引用: ' || {_YES('has_figure')} || chr(10) || '- 是否有关联脚注: 否' || chr(10) || '- 是否像图题/表题: ' || {_YES(_CAPTION)} || chr(10) || '- 是否像练习题/题目: ' || {_YES(_EXERCISE)}
 || chr(10) || '- 是否像编号步骤/选项: ' || {_YES(_STEPS)} || chr(10) || '- 是否强依赖图表: ' || {_YES(_SHOWN)} || chr(10) || '- 文档层级: doc'"""


@query(f"SELECT doc_id, md5({_SHOW}) AS shown FROM (SELECT *, doc_id % 3 = 0 AS has_figure FROM documents)")
def texts_for_judges(spark, d):
    return _shown(spark, d).select("doc_id", F.md5("shown").alias("shown"))


def _shown(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", quality.judge_text("text", F.col("doc_id") % 3 == 0, F.lit(False), level=F.lit("doc")).alias("shown"))


@query("WITH x AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) SELECT r // 8 AS batch, CAST(count(*) AS INT) AS n, md5(string_agg('<doc unique_id=\"' || doc_id || '\">' || chr(10) || source || chr(10) || '</doc>', chr(10) || chr(10) ORDER BY doc_id)) AS text FROM x GROUP BY r // 8")
def judge_batches(spark, d):
    return quality.judge_batches(table(spark, d, "documents"), "doc_id", "source", 8).select("batch", "n", F.md5("text").alias("text"))
