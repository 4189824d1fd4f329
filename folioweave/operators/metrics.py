"""Ranking and answer-quality metrics as aggregations."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as tx


def ranking_metrics(ranked: DataFrame, ks: tuple = (1, 3, 5), query: str = "query", rank: str = "rank", label: str = "label", total: str | None = None) -> DataFrame:
    """Per query: hit@k, recall@k (0 where nothing is relevant), rr, ap, ndcg@k.

    `ranked` has graded labels (null is 0; relevant is > 0) and ranks from 1. `total` names a column with the
    number of relevant documents of the query; without it the ranked ones are all.
    """
    lab = F.coalesce(F.col(label), F.lit(0)).cast("double")
    rel = (lab > 0).cast("int")
    w = Window.partitionBy(query)
    d = ranked.select(F.col(query).alias("query"), F.col(rank).alias("r"), lab.alias("l"), rel.alias("rel"), (F.col(total) if total else F.lit(None).cast("long")).alias("t"))
    w = Window.partitionBy("query")
    d = d.withColumn("ideal", F.row_number().over(w.orderBy(F.desc("l"), F.asc("r"))))
    d = d.withColumn("cum", F.sum("rel").over(w.orderBy("r").rowsBetween(Window.unboundedPreceding, 0)))
    gain = F.pow(F.lit(2.0), F.col("l")) - 1
    n_rel = F.coalesce(F.max("t"), F.sum("rel"))
    aggs = []
    for k in ks:
        inside = F.col("r") <= k
        hits = F.sum(F.when(inside, F.col("rel")).otherwise(0))
        dcg = F.sum(F.when(inside, gain / F.log2(F.col("r") + 1.0)).otherwise(0.0))
        idcg = F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0))
        aggs += [
            F.max(F.when(inside, F.col("rel")).otherwise(0)).cast("double").alias(f"hit_{k}"),
            F.when(n_rel > 0, hits / n_rel).otherwise(0.0).alias(f"recall_{k}"),
            F.when(idcg > 0, dcg / idcg).otherwise(0.0).alias(f"ndcg_{k}"),
        ]
    rr = F.coalesce(F.lit(1.0) / F.min(F.when(F.col("rel") == 1, F.col("r"))), F.lit(0.0)).alias("rr")
    ap = F.when(n_rel > 0, F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("r")).otherwise(0.0)) / n_rel).otherwise(0.0).alias("ap")
    return d.groupBy("query").agg(*aggs, rr, ap)


def macro_average(per_query: DataFrame, digits: int = 6) -> DataFrame:
    """One row: the mean of every metric over the queries (0 without queries), and their number."""
    cols = [c for c in per_query.columns if c != "query"]
    return per_query.agg(F.count("*").alias("queries"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), digits).alias(c) for c in cols])


def exact_match(a, b, normal=tx.comparable) -> Column:
    return (normal(a) == normal(b)).cast("int")


@F.pandas_udf(T.IntegerType())
def shared_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of two token arrays."""
    return a.combine(b, lambda x, y: 0 if x is None or y is None else (Counter(x) & Counter(y)).total()).astype("int32")


def token_f1(gold, said) -> Column:
    """F1 of token multisets; 1 where both are empty, 0 where one is. Both are arrays of tokens."""
    shared = shared_tokens(gold, said)
    n = F.size(gold) + F.size(said)
    return F.when(n == 0, 1.0).otherwise(2.0 * shared / n)


def token_f1_table(rows: DataFrame, key: str, gold: str, said: str) -> DataFrame:
    """(key, f1) by counting tokens on both sides: for long texts, where arrays would be compared in squares."""
    def counts(c: str, n: str) -> DataFrame:
        return rows.select(key, F.explode(tx.mixed_tokens(c)).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias(n))

    both = counts(gold, "a").join(counts(said, "b"), [key, "tok"]).groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"))
    size = rows.select(key, F.size(tx.mixed_tokens(gold)).alias("x"), F.size(tx.mixed_tokens(said)).alias("y"))
    f1 = F.when(F.col("x") + F.col("y") == 0, 1.0).otherwise(2.0 * F.coalesce("shared", F.lit(0)) / (F.col("x") + F.col("y")))
    return size.join(both, key, "left").select(key, f1.alias("f1"))


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, with bits of integers as the table's rows."""
    place: dict = {}
    for i, t in enumerate(b):
        place[t] = place.get(t, 0) | (1 << i)
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for t in a:
        m = row & place.get(t, 0)
        row = ((row + m) | (row - m)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays."""
    return a.combine(b, lambda x, y: 0 if x is None or y is None else _lcs(list(x), list(y))).astype("int32")


@F.pandas_udf(T.IntegerType())
def longest_shared_run(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest run of equal neighbouring tokens of two arrays."""

    def run(x, y):
        best, prev = 0, {}
        where: dict = {}
        for j, t in enumerate(y):
            where.setdefault(t, []).append(j)
        for t in x:
            cur = {j: prev.get(j - 1, 0) + 1 for j in where.get(t, ())}
            best = max([best, *cur.values()])
            prev = cur
        return best

    return a.combine(b, lambda x, y: 0 if x is None or y is None else run(list(x), list(y))).astype("int32")


def _prf(hit: int, n: int) -> float:
    return 2.0 * hit / n if n else 1.0


def _bleu(gold: list, said: list, most: int = 4) -> float:
    if not said:
        return 0.0
    logs, zeros = 0.0, 0
    for n in range(1, most + 1):
        g, s = (Counter(zip(*(t[i:] for i in range(n)))) for t in (gold, said))
        hit, total = (g & s).total(), max(s.total(), 1)
        if not hit:
            zeros += 1
        logs += math.log(hit / total if hit else 1 / (2**zeros * total))
    short = 1.0 if len(said) >= len(gold) else math.exp(1 - len(gold) / len(said))
    return short * math.exp(logs / most)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu")]))
def text_scores(gold: pd.Series, said: pd.Series) -> pd.DataFrame:
    """ROUGE-1, -2 and -L F1 and sentence BLEU-4 of two token arrays (null as empty).

    Two empty sides score 1 in ROUGE; BLEU of an empty answer is 0. BLEU halves the k-th zero precision.
    """
    rows = []
    for g, s in zip(gold, said):
        g, s = list(g) if g is not None else [], list(s) if s is not None else []
        r = [_prf((Counter(zip(*(g[i:] for i in range(n)))) & Counter(zip(*(s[i:] for i in range(n))))).total(), max(len(g) - n + 1, 0) + max(len(s) - n + 1, 0)) for n in (1, 2)]
        rows.append((*r, _prf(_lcs(g, s), len(g) + len(s)), _bleu(g, s)))
    return pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu"], dtype="float64")


def answer_status(gold, said, normal=tx.comparable) -> Column:
    """Outcome of an answer: the same text, or who of both says that there is no answer (fixed names)."""
    g, s = tx.is_no_answer(gold), tx.is_no_answer(said)
    return (
        F.when(exact_match(gold, said, normal) == 1, "exact_match").when(g & s, "correct_no_answer").when(g, "missed_no_answer").when(s, "false_no_answer")
        .otherwise("content_mismatch")
    )


def prediction_report(rows: DataFrame, gold: str = "gold", said: str = "said", f1: str = "f1", rouge: str = "rouge_l") -> DataFrame:
    """One row of means, counts and deviations over predictions; answerable rows are those whose gold text is an answer."""
    g, s = tx.is_no_answer(gold), tx.is_no_answer(said)
    same = exact_match(gold, said)
    mean = lambda x, d=6: F.round(F.coalesce(F.avg(x), F.lit(0.0)), d)
    return rows.agg(
        F.count("*").alias("sample_count"), F.count_if(~g).alias("answerable_count"), F.count_if(g).alias("unanswerable_count"), mean(same).alias("exact_match"),
        mean(F.col(f1)).alias("token_f1"), mean(F.col(rouge)).alias("rouge_l_f1"), mean((g == s).cast("int")).alias("no_answer_accuracy"),
        mean(F.when(~g, F.col(f1))).alias("avg_token_f1_answerable"), mean(F.when(g, F.col(f1))).alias("avg_token_f1_unanswerable"),
        F.count_if(~g & s).alias("false_no_answer_count"), F.count_if(g & ~s).alias("missed_no_answer_count"), F.sum(same).alias("exact_match_count"),
        F.round(F.coalesce(F.stddev_pop(f1), F.lit(0.0)), 6).alias("token_f1_std"),
    )


def extreme_cases(rows: DataFrame, by: tuple, n: int, key: str, best: bool = False) -> DataFrame:
    """The n worst (or best) rows by the columns `by`, ties by key; a top-k, so no task sorts all rows."""
    order = [F.desc(c) if best else F.asc(c) for c in by]
    return rows.orderBy(*order, key).limit(n)


def score_by_class(rows: DataFrame, classes: Column, scores: tuple) -> DataFrame:
    """(class, n, mean of each score): a row counts in every class of the array `classes`."""
    return rows.select(F.explode(classes).alias("class"), *scores).groupBy("class").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in scores])


def span_classes(place, edges: tuple = (100, 200, 300, 400, 500)) -> Column:
    """Names of the position spans that hold `place`: (previous edge, edge], and 'edge+' beyond the last."""
    lows = (0, *edges[:-1])
    names = [F.when((place >= lo) & (place < hi), f"{lo}-{hi}") for lo, hi in zip(lows, edges)] + [F.when(place >= edges[-1], f"{edges[-1]}+")]
    return F.filter(F.array(*names), lambda x: x.isNotNull())


def segment_cosines(segments: DataFrame, whole: DataFrame, key: str = "doc", place: str = "place", vector: str = "vec") -> DataFrame:
    """(place, n, cosine): mean cosine of the segments at each place of their texts with the vectors of the whole texts."""
    from ..functions import vectors as vx

    j = segments.join(whole.select(key, F.col(vector).alias("_w")), key)
    return j.groupBy(place).agg(F.count("*").alias("n"), F.round(F.avg(vx.cosine(vector, "_w")), 6).alias("cosine"))


def length_cdf(rows: DataFrame, length: Column, step: int) -> DataFrame:
    """(bucket, n, cumulative, percent): lengths by steps, running count and share."""
    g = rows.where(length.isNotNull()).groupBy((F.floor(length / step) * step).alias("bucket")).agg(F.count("*").alias("n"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    return g.withColumn("cumulative", F.sum("n").over(w)).withColumn("percent", F.round(100.0 * F.col("cumulative") / F.sum("n").over(every), 4))


def histogram(rows: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """(score, n): counts of clamped values, empty ones with 0; null counts as `low`."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(low)))).cast("int")
    g = rows.groupBy(v.alias("score")).agg(F.count("*").alias("n"))
    dense = rows.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("score"))
    return dense.join(g, "score", "left").na.fill(0, ["n"])


def with_overall(rows: DataFrame, category: str, value: str) -> DataFrame:
    """Mean of `value` by category, and overall (category 'Average'), in one pass."""
    g = rows.groupingSets([[category], []], category).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), F.grouping(category).alias("g"))
    return g.select(F.when(F.col("g") == 1, "Average").otherwise(F.col(category)).alias(category), F.round("mean", 6).alias("mean"), "n")


def preference_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return rows.agg(F.round(F.avg((F.col(chosen) > F.col(rejected)).cast("double")), 6).alias("accuracy"), F.count("*").alias("pairs"))


def masked_accuracy(labels, predicted, ignore: int = -100) -> Column:
    """Share of right tokens where the label counts, labels shifted by one against predictions."""
    lab = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.filter(F.arrays_zip(lab.alias("l"), predicted.alias("p")), lambda x: x["l"].isNotNull() & (x["l"] != ignore))
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda x: x["l"] == x["p"])) / F.size(pairs)).otherwise(F.lit(0.0))


def mixed_label_groups(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows of the groups with more than one distinct label."""
    keep = rows.groupBy(group).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a < _b").select(group)
    return rows.join(keep, group, "left_semi")


def binned(rows: DataFrame, value: Column, low: float, high: float, n: int) -> DataFrame:
    """(bin, n) of equal bins; the first bin that holds a value counts it, so edges belong to the lower one."""
    step = (high - low) / n
    k = F.when(value.between(low, high), F.greatest(F.ceil((value - low) / step) - 1, F.lit(0)))
    return rows.where(k.isNotNull()).groupBy(k.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def recall_by_range(hits: DataFrame, ranges: DataFrame, value: str, hit: str) -> DataFrame:
    """(low, high, n, recall) over ranges that include both ends and may overlap; a row counts in each that holds it.

    ranges: (low, high), a fixed handful; checked before it is broadcast.
    """
    if ranges.limit(1001).count() > 1000:
        raise ValueError("more ranges than may be broadcast")
    j = hits.join(F.broadcast(ranges), (F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))
    return j.groupBy("low", "high").agg(F.count("*").alias("n"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("recall"))
