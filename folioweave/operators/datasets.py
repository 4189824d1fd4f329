"""Building training sets: parsing, fan-out, negatives, splits, labels, training groups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from . import fusion

QA = "array<struct<question:string,answer:string>>"


def qa_pairs(docs: DataFrame, key: str = "unique_id", raw: str = "raw_resp", scores: str | None = None, least: int = 4) -> DataFrame:
    """(source_uid, position, question, answer, score) from JSON answers; pairs without text and, where there are
    scores (missing 0), those under `least` drop out. Unreadable JSON gives no rows."""
    d = docs.select(F.col(key).alias("uid"), (F.col(scores) if scores else F.lit(None).cast("array<int>")).alias("sc"), F.posexplode(F.from_json(raw, QA)).alias("position", "qa"))
    score = F.coalesce(F.get("sc", F.col("position")), F.lit(0)) if scores else F.lit(None).cast("int")
    d = d.select(F.concat_ws("#", "uid", "position").alias("source_uid"), "position", tx.collapse("qa.question").alias("question"), tx.collapse("qa.answer").alias("answer"), score.alias("score"))
    d = d.where((F.col("question") != "") & (F.col("answer") != ""))
    return d.where(F.col("score") >= least) if scores else d


def numbered_lines(t) -> Column:
    """Texts of '1. q' lines, distinct by lower case."""
    lines = F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda x: tx.collapse(F.regexp_replace(x, r"^\s*\d+[.)、]\s*", "")))
    keep = F.filter(lines, lambda x: x != "")
    low = F.transform(keep, F.lower)
    return F.filter(keep, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def as_numbered(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def score_list(scores: Column, n: Column) -> Column:
    """Scores clamped to 1..5, padded with 1 and cut to n."""
    ok = F.transform(F.coalesce(scores, F.array().cast("array<int>")), lambda s: F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(s, F.lit(1)))))
    return F.slice(F.concat(ok, F.array_repeat(F.lit(1), n)), F.lit(1), n)


# --- fixed values: texts of augmented rows by script ----------------------------------------------------------------
TASKS = {
    "zh": {
        "orig": "请回答信息检索问题。", "qkw": "请根据问题和关键词给出准确回答。", "term": "请解释下列信息检索术语。", "fix": "判断下面说法是否正确；如果错误，请给出正确表述。",
        "question": "问题：", "keywords": "关键词：", "right": "该说法不准确。正确表述是：",
        "no_subject": "不是信息检索中的具体概念，只是普通表达。", "no_meaning": "在信息检索中没有明确含义。", "no_form": "不能被表示为任何结构化形式。", "no_object": "该对象通常无法进行任何形式的表示。",
    },
    "en": {
        "orig": "Please answer the information retrieval question.", "qkw": "Please answer accurately using the question and keywords.",
        "term": "Please explain the following information retrieval term.",
        "fix": "Determine whether the following statement is correct. If it is incorrect, provide the correct statement.",
        "question": "Question: ", "keywords": "Keywords: ", "right": "This statement is inaccurate. The correct statement is: ",
        "no_subject": " is not an information retrieval concept, but merely a general expression.", "no_subjects": " are not used in information retrieval systems.",
        "no_meaning": " has no specific meaning in information retrieval.", "no_form": " does not represent any specific concept in this context.",
        "no_object": "This object does not represent any specific concept in this context.",
    },
}
NO_KEYWORDS = "无"
# --------------------------------------------------------------------------------------------------------------------


def asked_subject(question) -> Column:
    """What a definition question asks for ('' if it has another form)."""
    q = tx.collapse(question)
    zh = F.regexp_extract(q, r"^什么是(.+?)[？?]?$", 1)
    en = F.regexp_replace(F.regexp_extract(q, r"(?i)^what (?:is|are)\b\s*(.*)$", 1), r"[ ?]+$", "")
    return F.coalesce(tx.collapse(F.when(q.rlike("[一-鿿]"), zh).otherwise(en)), F.lit(""))


def augment(qa: DataFrame, key: str = "id", question: str = "question", answer: str = "answer", keywords: str = "keywords", kind: Column | None = None, system: str = "") -> DataFrame:
    """Training rows of each pair: the question (orig), with its keywords (qkw), the term that a definition asks for
    (term), and a wrong statement to correct for definitions and representations (fix).

    kind: the question type; by rule where it is not given. Rows: (id, source_uid, task_type, question_type,
    instruction, input, output, system). Null questions and answers count as ''.
    """
    d = qa.select(F.col(key).alias("uid"), F.coalesce(question, F.lit("")).alias("q"), F.coalesce(answer, F.lit("")).alias("a"), F.coalesce(F.col(keywords), F.array().cast("array<string>")).alias("kw"), (kind if kind is not None else tx.question_type(question)).alias("kind"))
    han = lambda c: F.col(c).rlike("[一-鿿]")
    d = d.withColumn("zq", han("q")).withColumn("zh", han("q") | han("a")).withColumn("subject", asked_subject("q")).withColumn("kw1", F.coalesce(F.get("kw", F.lit(0)), F.lit("")))

    def say(what: str, zh: Column) -> Column:
        return F.when(zh, TASKS["zh"].get(what, "")).otherwise(TASKS["en"].get(what, ""))

    definition, representation = F.col("kind") == "definition", F.col("kind") == "representation"
    named, plural = F.col("subject") != "", ~F.col("zq") & F.lower("q").rlike(r"^what are\b")
    denied = F.when(plural, TASKS["en"]["no_subjects"]).otherwise(say("no_subject", F.col("zq")))
    about = lambda what: F.concat("kw1", say(what, F.col("zq")))
    keyed = F.col("kw1") != ""
    wrong = (
        F.when(definition & named, F.concat("subject", denied)).when(definition & keyed, about("no_meaning"))
        .when(representation & keyed, about("no_form")).when(representation, say("no_object", F.col("zq")))
    )
    # a question of the asking form is answered by its subject alone; keywords stand in for other forms
    form = F.when(F.col("zq"), F.col("q").rlike(r"^什么是(.+?)[？?]?$")).otherwise(F.lower("q").rlike(r"^what (?:is|are)\b"))
    term = F.when(form, F.col("subject")).otherwise(tx.collapse("kw1"))
    words = F.when(F.size("kw") > 0, F.array_join("kw", ", ")).otherwise(NO_KEYWORDS)
    zf = F.col("zh") | wrong.rlike("[一-鿿]")

    def row(mark: str, task: str, zh: Column, text: Column, output: Column, when: Column) -> Column:
        r = F.struct(F.lit(mark).alias("mark"), F.lit(task).alias("task_type"), say(mark, zh).alias("instruction"), text.alias("input"), output.alias("output"))
        return F.when(F.coalesce(when, F.lit(False)), r)

    rows = F.array(
        row("orig", "qa", F.col("zh"), F.col("q"), F.col("a"), F.lit(True)),
        row("qkw", "qa_with_keywords", F.col("zh"), F.concat(say("question", F.col("zh")), F.col("q"), F.lit("\n"), say("keywords", F.col("zh")), words), F.col("a"), F.lit(True)),
        row("term", "term_explanation", F.col("zq"), term, F.col("a"), definition & (term != "")),
        row("fix", "error_correction", zf, wrong, F.concat(say("right", zf), F.col("a")), wrong.isNotNull()),
    )
    x = d.select("uid", "kind", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    return x.select(
        F.concat_ws("_", F.col("uid").cast("string"), "r.mark").alias("id"), F.col("uid").alias("source_uid"), "r.task_type", F.col("kind").alias("question_type"), "r.instruction", "r.input", "r.output", F.lit(system).alias("system")
    )


def master_rows(augmented: DataFrame, order: str = "id") -> DataFrame:
    """One row an id: the first by all other columns where an id comes several times."""
    rest = [c for c in augmented.columns if c != order]
    return augmented.groupBy(order).agg(F.min(F.struct(*rest)).alias("_r")).select(order, *[F.col("_r")[c].alias(c) for c in rest])


def as_alpaca(rows: DataFrame) -> DataFrame:
    """Only instruction, input, output and system."""
    return rows.select("instruction", "input", "output", "system")


def final_pairs(qa: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """(source_uid, unique_id, question, answer): each pair under its own question and under each of its paraphrases.

    paraphrases: (source_uid, questions: array). Paraphrases equal to the question or to an earlier one, by lower
    case, are left out; the pair itself is number 0.
    """
    p = qa.join(paraphrases, "source_uid", "left").withColumn("_all", F.concat(F.array("question"), F.coalesce("questions", F.array().cast("array<string>"))))
    flat = F.transform("_all", tx.collapse)
    low = F.transform(flat, F.lower)
    keep = F.filter(F.transform(flat, lambda x, i: F.struct(i.alias("i"), x.alias("q"))), lambda s: (s["q"] != "") & (F.array_position(low, F.lower(s["q"])) == s["i"] + 1))
    d = p.select("source_uid", "answer", F.posexplode(keep).alias("place", "s"))
    return d.select("source_uid", F.concat_ws("#", "source_uid", F.col("place").cast("string")).alias("unique_id"), F.col("s.q").alias("question"), "answer")


def question_sources(questions: DataFrame, docs: DataFrame, uid: str = "uid", question: str = "question") -> DataFrame:
    """(question, uid, parent): the document that a question came from, and its parent.

    questions: (question, source_uid), source_uid being a document's uid, before '#' where it has a position. Of equal
    questions, by lower case and single blanks, the smallest uid counts. docs: (uid, parent_id).
    """
    q = questions.select(F.lower(tx.collapse(question)).alias("question"), F.split_part("source_uid", F.lit("#"), F.lit(1)).alias("uid")).where("question <> ''")
    q = q.groupBy("question").agg(F.min("uid").alias("uid"))
    d = docs.select(F.col(uid).alias("uid"), F.coalesce("parent_id", F.col(uid)).alias("parent"))
    return q.join(d, "uid", "left").select("question", "uid", "parent")


def not_yet_asked(todo: DataFrame, done: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that neither their key nor, where finished rows lost it, their text shows as done."""
    rest = todo.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    said = done.where(F.col(key).isNull()).select(F.lower(tx.collapse(text)).alias("_t")).distinct()
    return rest.withColumn("_t", F.lower(tx.collapse(text))).join(said, "_t", "left_anti").drop("_t")


def pad_list(items, n: int) -> Column:
    """An array filled up with its own elements in turn, or cut, to n; an empty one stays empty."""
    x = F.col(items) if isinstance(items, str) else items
    times = F.ceil(F.lit(n) / F.greatest(F.size(x), F.lit(1))).cast("int")
    return F.when(F.size(x) > 0, F.slice(F.flatten(F.array_repeat(x, times)), 1, n)).otherwise(x)


def with_negatives(base: DataFrame, negatives: DataFrame, instruction: str, reply: str, seed: int = 0) -> DataFrame:
    """Rows (id, instruction, input, output) and questions (question) that get the fixed reply, in random order."""
    neg = negatives.where(F.length(F.trim("question")) > 0).select(
        F.concat(F.lit("neg:"), F.md5("question")).alias("id"), F.lit(instruction).alias("instruction"), F.col("question").alias("input"), F.lit(reply).alias("output")
    )
    both = base.select("id", "instruction", "input", "output").unionByName(neg)
    return both.withColumn("shuffle_key", tx.hash_order("id", seed=seed))


def split_by_hash(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """`rows` with split train or test, decided by the hash of the key alone: stateless, stable when rows come and go."""
    part = F.conv(F.substring(tx.hash_order(key, seed=seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return rows.withColumn("split", F.when(part < share, "train").otherwise("test"))


def split_exact(rows: DataFrame, key: str, share: float, seed: int = 0, least: int = 1) -> DataFrame:
    """Exactly int(share*n) train rows (at least `least`), in hash order.

    The order is global, but only the hashes of the rows near the cut are ranked: counts by hash prefix find the
    bucket of the cut first.
    """
    h = tx.hash_order(key, seed=seed)
    d = rows.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = {r["_b"]: r["count"] for r in d.groupBy("_b").count().collect()}  # at most 4096 rows
    n = sum(counts.values())
    want = max(least, int(share * n)) if n else 0
    cut, before = 4096, 0
    for b in sorted(counts):
        if before + counts[b] > want:
            cut = b
            break
        before += counts[b]
    w = Window.partitionBy("_b").orderBy("_h", key)
    edge = F.when(F.col("_b") == cut, F.row_number().over(w)).otherwise(0)
    train = (F.col("_b") < cut) | ((F.col("_b") == cut) & (edge <= want - before))
    return d.withColumn("split", F.when(train, "train").otherwise("test")).drop("_h", "_b")


# --- fixed values of the search for a balanced split: rounds, size of a small group, weight of too many of them -------
ROUNDS_A_GROUP, LEAST_ROUNDS, MOST_ROUNDS, SMALL, SMALL_WEIGHT = 30, 300, 3000, 12, 2.0
# ----------------------------------------------------------------------------------------------------------------------


def balanced_choice(sizes: list[int], share: float, seed: int = 0) -> tuple[list[int], float]:
    """(places of the chosen groups, score): of many random orders the one whose leading groups are nearest to `share` of
    rows and groups without more small groups than all have.

    The score adds the distances in rows and in groups, as parts of what is wanted, and the excess of small groups.
    Every order is cut where its running size is nearest to the wanted one; all orders of a round are arrays.
    """
    n = np.array(sizes, np.int64)
    if not n.size:
        return [], 0.0
    total = int(n.sum())
    rows = min(max(int(round(total * share)), 1 if share > 0 and total > 1 else 0), max(1, total - 1))
    groups = min(max(1, round(n.size * share)), max(1, n.size - 1)) if share > 0 else 0
    small = n <= SMALL
    rng, best = np.random.default_rng(seed), (np.inf, [])
    for _ in range(min(MOST_ROUNDS, max(LEAST_ROUNDS, n.size * ROUNDS_A_GROUP))):
        order = rng.permutation(n.size)
        k = int(np.abs(np.cumsum(n[order]) - rows).argmin()) + 1
        chosen = order[:k]
        excess = max(0.0, small[chosen].mean() - small.mean())
        score = abs(int(n[chosen].sum()) - rows) / max(rows, 1) + abs(k - groups) / max(groups, 1) + SMALL_WEIGHT * excess
        if score < best[0]:
            best = (score, chosen.tolist())
    return best[1], float(best[0])


def split_groups(rows: DataFrame, group: str, share: float = 0.9, seed: int = 0, most_groups: int = 50_000) -> DataFrame:
    """Whole groups to train or test, so that rows, groups and small groups are near `share`; a null group is one.

    Only group sizes come to the driver, `most_groups` at most; beyond that groups go by their hash, which at such
    numbers is as balanced.
    """
    g = rows.groupBy(group).agg(F.count("*").alias("n"))
    if g.limit(most_groups + 1).count() > most_groups:
        return split_by_hash(rows, group, share, seed)
    sizes = [(r[0], r[1]) for r in g.orderBy(group).collect()]
    chosen, _ = balanced_choice([n for _, n in sizes], 1 - share, seed)
    kind = rows.schema[group].dataType.simpleString()
    test = rows.sparkSession.createDataFrame([(sizes[i][0], 1) for i in chosen], f"_g {kind}, _t int")
    return rows.join(F.broadcast(test), F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("split", F.when(F.col("_t") == 1, "test").otherwise("train")).drop("_t", "_g")


def rank_labels(judged: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, doc, relevance): gold documents get 1; judged ones of -1..1 follow without the gold ones."""
    g = gold.select("query_id", "doc", F.lit(1).alias("relevance"))
    rest = judged.join(gold.select("query_id", "doc"), ["query_id", "doc"], "left_anti").select("query_id", "doc", F.col("relevance").cast("int").alias("relevance"))
    return g.unionByName(rest).distinct()


def relevance_grade(relevance) -> Column:
    """-1, 0, 1 to 0, 1, 2; anything else is an error."""
    return F.when(relevance.isin(-1, 0, 1), relevance + 1).otherwise(F.raise_error(F.concat(F.lit("unknown relevance "), relevance.cast("string"))).cast("int"))


def continuous_label(label, low: float, high: float) -> Column:
    """A label of low..high as a number of 0..1; anything outside is an error, null stays null."""
    share = (label - F.lit(low)) / F.lit(high - low)
    return F.when(label.isNull() | label.between(low, high), share).otherwise(F.raise_error(F.concat(F.lit("label out of range: "), label.cast("string"))).cast("double"))


def retrieval_query(text, task) -> Column:
    """What to search with: of a question with keywords the question alone, else the text, single-spaced."""
    x = tx.collapse(F.coalesce(text, F.lit("")))
    en, zh = (F.regexp_extract(x, p, 1) for p in (r"(?s)^Question:\s*(.*?)\s*Keywords:\s*.*$", r"(?s)^问题：\s*(.*?)\s*关键词：\s*.*$"))
    keyed = task == "qa_with_keywords"
    return F.when(keyed & x.rlike(r"(?s)^Question:.*Keywords:"), en).when(keyed & x.rlike("(?s)^问题：.*关键词："), zh).otherwise(x)


def query_ids(many, one) -> Column:
    """Ids of a row: the non-blank ones of an array, else a single one, else none."""
    listed = F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    single = F.filter(F.array(F.trim(one)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(listed) > 0, listed).otherwise(single)


def query_pairs(queries: DataFrame, docs: DataFrame, scores: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, doc, place, score, rank): candidates of each query with their scores by position, best first, null last."""
    p = queries.select(key).join(docs, key).join(scores, [key, "place"], "left")
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "place")
    return p.select(key, "doc", "place", "score").withColumn("rank", F.row_number().over(w))


def shuffled_text(text, key, share: float = 0.15, seed: int = 0) -> Column:
    """A text with its three thirds in another order, for about `share` of the keys; which and how, the key's hash says."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    parts = F.array(F.substr(text, F.lit(1), third), F.substr(text, third + 1, third), F.substr(text, 2 * third + 1, n))
    h = lambda i: tx.hash_order(key, seed=seed + i)
    order = F.array_sort(F.array(*[F.struct(h(i + 1).alias("h"), F.get(parts, F.lit(i)).alias("p")) for i in range(3)]))
    draw = F.conv(F.substring(h(0), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return F.when((draw < share) & (n >= 3), F.array_join(F.transform(order, lambda x: x["p"]), "")).otherwise(text)


def grouped_hits(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Pointwise rows (query_id, query, content, label, pos) to one row for each run of neighbouring rows of a query."""
    d = fusion.islands(rows, [order], ["query_id", "query"])
    g = d.groupBy("island", "query_id", "query").agg(F.sort_array(F.collect_list(F.struct(order, "content", "label"))).alias("l"))
    return g.select("query_id", "query", F.transform("l", lambda x: F.struct(x["content"].alias("content"), x["label"].alias("label"))).alias("hits"))


def pointwise(grouped: DataFrame) -> DataFrame:
    """One row a hit: (query_id, query, place, content, label)."""
    return grouped.select("query_id", "query", F.posexplode("hits").alias("place", "h")).select("query_id", "query", "place", "h.content", "h.label")


def training_lists(rows: DataFrame, size: int, seed: int = 0, query: str = "query_id", key: str = "doc") -> DataFrame:
    """Lists of exactly `size` rows a query, shuffled; a short last list is filled with other rows of the query;
    lists with one label, and queries with fewer rows than `size`, drop out."""
    w = Window.partitionBy(query)
    h = tx.hash_order(query, key, seed=seed)
    d = rows.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= size).withColumn("_r", F.row_number().over(w.orderBy(h, key)) - 1)
    lists = F.ceil(F.col("_n") / size)
    own = d.withColumn("list_no", F.floor(F.col("_r") / size).cast("int"))
    missing = lists * size - F.col("_n")
    fill = d.where(F.col("_r") < missing).withColumn("list_no", (lists - 1).cast("int"))
    both = own.unionByName(fill)
    g = Window.partitionBy(query, "list_no")
    return both.where("_n is not null").withColumn("_k", F.size(F.collect_set("label").over(g))).where("_k > 1").drop("_n", "_r", "_k")


def triplets(rows: DataFrame, negatives: int, seed: int = 0, query: str = "query") -> DataFrame:
    """(query, pos, negs): each positive with n negatives in hash order, the list repeated where it is short."""
    neg = F.array_sort(F.transform("neg", lambda x: F.named_struct(F.lit("h"), F.md5(F.concat(x, F.lit(str(seed)))), F.lit("x"), x)))
    d = rows.select(query, F.explode("pos").alias("pos"), F.transform(neg, lambda s: s["x"]).alias("n")).where(F.size("n") > 0)
    times = F.ceil(F.lit(negatives) / F.size("n")).cast("int")
    return d.select(query, "pos", F.slice(F.flatten(F.array_repeat("n", times)), 1, negatives).alias("negs"))


def corpus_of(grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, qrels) of grouped hits: distinct contents by md5; of several labels of a pair the last counts."""
    p = grouped.select("query_id", F.posexplode("hits").alias("place", "h")).where(F.length(F.trim("h.content")) > 0)
    p = p.select("query_id", "place", F.md5("h.content").alias("doc"), F.col("h.content").alias("content"), F.col("h.label").alias("label"))
    corpus = p.groupBy("doc").agg(F.min("content").alias("content"))
    return corpus, p.groupBy("query_id", "doc").agg(F.max_by("label", "place").alias("label"))


def batches(rows: DataFrame, size: int, order: list, drop_last: bool = True) -> DataFrame:
    """`rows` with batch: fixed-size batches in order, made of places that no task counts alone."""
    d = fusion.numbered(rows, order, "_g").withColumn("batch", F.floor(F.col("_g") / size))
    if drop_last:
        total = rows.agg(F.count("*").alias("_t"))
        d = d.join(F.broadcast(total)).where((F.col("batch") + 1) * size <= F.col("_t")).drop("_t")
    return d.drop("_g")


def few_shot(rows: DataFrame, n: int, by: str, key: str, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(by).orderBy(tx.hash_order(key, seed=seed), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
