"""Seams for models: embedding, translation, pair scores, judging. Defaults are deterministic and need no model;
their quality is not that of a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from .chunking import hashed_vector
from .search import lexical_overlap_score

REGISTRY: dict[str, dict[str, Callable]] = {"embed": {}, "translate": {}, "score": {}, "judge": {}}


def register(kind: str, name: str):
    """Register a scorer: a function of columns to a column (wrap models as Arrow-batched pandas UDFs)."""

    def add(fn):
        REGISTRY[kind][name] = fn
        return fn

    return add


def get(kind: str, name: str = "default") -> Callable:
    return REGISTRY[kind][name]


@register("embed", "default")
def embed(t, dim: int = 64) -> Column:
    return hashed_vector(tx.search_tokens(t), dim)


@register("translate", "default")
def translate(t, to: str = "en") -> Column:
    return t


@register("score", "default")
def score(query, doc) -> Column:
    return lexical_overlap_score(query, doc)


@register("judge", "default")
def judge(text) -> Column:
    """A label and a reason in JSON."""
    return F.to_json(F.struct(F.when(tx.high_value(text), "core").otherwise("extra").alias("label"), F.lit("rule").alias("reason")))


def nearest_class(rows: DataFrame, centroids: DataFrame, key: str, vector: str, least: float = 0.5) -> DataFrame:
    """(key, class, cosine): the class centroid nearest to each vector, 'other' under `least`.

    centroids: one row for each class (label, vec); a handful, checked to be at most 10,000 before it is broadcast.
    """
    if centroids.limit(10_001).count() > 10_000:
        raise ValueError("too many classes to broadcast; use an index")
    c = centroids.select("label", "vec")
    s = rows.select(key, F.col(vector).alias("v")).join(F.broadcast(c)).withColumn("s", F.round(vx.cosine("v", "vec"), 6))
    best = s.groupBy(key).agg(F.min_by(F.struct("label", "s"), F.struct(-F.col("s"), F.col("label"))).alias("b"))
    return best.select(key, F.when(F.col("b.s") >= least, F.col("b.label").cast("string")).otherwise("other").alias("class"), F.col("b.s").alias("cosine"))


def context(hits: DataFrame, query: str = "query", rank: str = "rank", text: str = "text", most: int = 1600) -> DataFrame:
    """(query, context): the numbered texts of each query's hits."""
    g = hits.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(rank, F.substring(text, 1, most).alias("t")))).alias("l"))
    return g.select(query, F.array_join(F.transform("l", lambda x: F.concat(F.lit("【"), x[rank].cast("string"), F.lit("】"), x["t"])), "\n").alias("context"))


def cited(answers: DataFrame, hits: DataFrame, query: str = "query", answer: str = "answer", rank: str = "rank", doc: str = "doc") -> DataFrame:
    """(query, place, doc): the documents an answer cites, in order; numbers beyond the hits drop out."""
    c = answers.select(query, F.posexplode(tx.citations(answer)).alias("place", "n"))
    return c.join(hits.select(query, F.col(rank).alias("n"), doc), [query, "n"]).select(query, "place", doc)
