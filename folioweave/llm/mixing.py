"""Problem 9: mix sources to target weights by weighted fair queueing.

Every use of a record gets a virtual finish time: the tokens of its source up to and with it, in shuffled
order, divided by the source's weight. Sorting all uses by that time serves every source at its rate; the mix
ends where the total reaches the budget. Running sums are made in two steps, over buckets of the shuffled
order and inside them, so no source is ever summed in one task.
"""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

#: Splitting pattern of the byte-level vocabulary; a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict = {}


def _encoder(name: str, ranks: bytes):
    if name not in _encoders:
        import tiktoken

        pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})
    return _encoders[name]


def token_counts(spark: SparkSession, vocabulary: str):
    """Column function: number of tokens of a text in the vocabulary file at the path `vocabulary`; null for a null text.

    The file is read where the plan is made and sent to the executors, which need no copy of it; it is of a fixed size.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    sent, name = spark.sparkContext.broadcast(ranks), os.path.basename(vocabulary)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = _encoder(name, sent.value)
        return s.map(lambda t: None if t is None else len(enc.encode_ordinary(t))).astype("Int64")

    return count


def _running(d: DataFrame, group: list[str], order: str, amount: str, buckets: int, bits: int = 30) -> DataFrame:
    """`d` with run: the sum of `amount` up to and with each row, by group in the order of the hash `order`."""
    d = d.withColumn("bucket", F.shiftright(F.col(order), 63 - bits).cast("long") % (1 << bits))
    d = d.withColumn("bucket", F.floor(F.col("bucket") * F.lit(buckets) / F.lit(1 << bits)).cast("int"))
    sums = d.groupBy(*group, "bucket").agg(F.sum(amount).alias("s"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*group, "bucket").orderBy(order, "key").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("part", F.sum(amount).over(inside))
    return d.join(sums, [*group, "bucket"]).withColumn("run", F.col("base") + F.col("part")).drop("bucket", "part", "base")


def mix(
    docs: DataFrame, targets: DataFrame, vocabulary: str, budget: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: int = 11, rows_per_bucket: int = 50_000,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares).

    mix: (key, source, copy, tokens, finish), range-sorted by finish; copy counts a record's uses from 1.
    shares: (source, target_share, wanted, records, tokens, share): the target, that target among the sources
    that can be served, and what was reached.

    Sources without a target, with a null or zero one, and null or blank texts take no part. Targets of sources
    without records are spread over the others in proportion. Without `budget` the total is the largest at
    which no source runs out (tokens times max_repeats); with one, sources that run out fall short and the
    others go on. A repeated key is a record of its own; null repeats count as 1.
    """
    w = targets.where("source is not null and target_share > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("reps")
    )
    w = w.where("reps > 0")
    kd = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("t")).where(F.length(F.trim("t")) > 0)
    d = d.join(w.select("source"), "source", "left_semi")
    d = materialize(d.select("key", "source", token_counts(docs.sparkSession, vocabulary)("t").alias("tokens")).where("tokens > 0"), "tokens")
    have = d.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    state = [r.asDict() for r in have.join(w, "source").collect()]  # one row for each listed source
    goal = sum(r["target_share"] for r in state)
    if not state or goal <= 0:
        empty = docs.sparkSession.createDataFrame([], f"{key} {kd}, source string, copy int, tokens long, finish double")
        return empty, _shares(empty, w, {}, docs.sparkSession)
    wanted = {r["source"]: r["target_share"] / goal for r in state}
    if budget is None:
        budget = int(min(r["have"] * r["reps"] / wanted[r["source"]] for r in state))
    buckets = max(1, -(-max(r["n"] for r in state) // rows_per_bucket))
    # uses that the budget cannot reach are left out early: a source never needs more rounds than its share takes
    rounds = {r["source"]: min(r["reps"], int(2 + budget / max(r["have"], 1))) for r in state}
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, float(wanted[s]), rounds[s]) for s in wanted], "source string, weight double, rounds int")
    uses = d.join(F.broadcast(plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    uses = uses.withColumn("h", F.xxhash64("key", "copy", F.lit(seed)) .bitwiseAND(F.lit((1 << 63) - 1)))
    uses = _running(uses, ["source", "copy"], "h", "tokens", buckets)
    # a record's later uses come after all records of its source have been used once more
    whole = spark.createDataFrame([(r["source"], int(r["have"])) for r in state], "source string, have long")
    uses = uses.join(F.broadcast(whole), "source").withColumn("run", F.col("run") + (F.col("copy") - 1) * F.col("have"))
    uses = uses.withColumn("finish", F.col("run") / F.col("weight")).select("key", "source", "copy", "tokens", "finish")
    uses = materialize(uses, "uses")
    # the total passes the budget in one bucket of finish times, which is divided until few rows are left in it
    lo, hi = 0.0, float(uses.agg(F.max("finish")).first()[0])
    total, steps = 0, 4096
    while True:
        inside = uses.where((F.col("finish") > lo) & (F.col("finish") <= hi))
        at = F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.ceil((F.col("finish") - lo) / F.lit(hi - lo) * steps) - 1)).cast("int")
        part = inside.groupBy(at.alias("b")).agg(F.sum("tokens").alias("s"), F.count("*").alias("n"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        cut, before = None, lo
        for r in part.orderBy("b").collect():  # at most `steps` rows
            if total + r["s"] > budget:
                cut = r
                break
            total, before = total + r["s"], r["last"]
        if cut is None:
            out = uses
            break
        lo, hi = before, cut["last"]
        if cut["n"] <= rows_per_bucket or cut["first"] == cut["last"]:
            order = Window.orderBy("finish", "source", "key", "copy").rowsBetween(Window.unboundedPreceding, 0)
            edge = uses.where((F.col("finish") > lo) & (F.col("finish") <= hi)).withColumn("run", F.sum("tokens").over(order)).where(F.col("run") <= budget - total).drop("run")
            out = uses.where(F.col("finish") <= lo).unionByName(edge)
            break
    out = out.repartitionByRange("finish", "source", "key", "copy").sortWithinPartitions("finish", "source", "key", "copy").withColumnRenamed("key", key)
    return out, _shares(out, w, wanted, spark)


def _shares(out: DataFrame, w: DataFrame, wanted: dict, spark) -> DataFrame:
    got = out.groupBy("source").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    want = spark.createDataFrame(list(wanted.items()), "source string, wanted double")
    x = w.select("source", "target_share").join(want, "source", "left").join(got, "source", "left").na.fill(0, ["wanted", "records", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())
    return x.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
