"""Ordered sets and lookups: distinct with order, result merging, parents, upserts and synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def first_of(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in `order`; null keys form a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_at_first_place(df: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key, at the place of its first: an ordered map that is overwritten."""
    vals = F.struct(*[c for c in df.columns if c not in (key, position)])
    g = df.groupBy(key).agg(F.min(position).alias(position), F.max_by(vals, position).alias("_v"))
    return g.select(*[F.col("_v")[c].alias(c) if c not in (key, position) else F.col(c) for c in df.columns])


def merge_key(uid, source, content_hash, text) -> Column:
    """unique_id where there is one, else source and content hash (or md5 of the trimmed text)."""
    h = F.coalesce(F.nullif(content_hash, F.lit("")), F.md5(F.trim(F.coalesce(text, F.lit("")))))
    return F.coalesce(F.nullif(uid, F.lit("")), F.concat_ws("|", F.coalesce(source, F.lit("")), h))


def merge_results(lists: list[DataFrame], key: str = "mkey") -> DataFrame:
    """Rows (query, pos, mkey, ...) of several retrievers in order: the earlier list first, each key once a query."""
    both = None
    for i, d in enumerate(lists):
        p = d.withColumn("list_no", F.lit(i))
        both = p if both is None else both.unionByName(p)
    kept = first_of(both, ["query", key], ["list_no", "pos"])
    w = Window.partitionBy("query").orderBy("list_no", "pos", key)
    return kept.withColumn("rank", F.row_number().over(w))


def to_parents(hits: DataFrame, docs: DataFrame, query: str = "query", doc: str = "doc", rank: str = "rank", fallback: bool = True) -> DataFrame:
    """Hits on children as hits on their parents (docs: uid, parent_id), each parent once at its best rank.

    fallback: a hit whose parent is not in `docs` stays itself; else it drops out.
    """
    d = docs.select(F.col("uid").alias("_u"), F.col("parent_id").alias("_p"))
    have = docs.select(F.col("uid").alias("_h"))
    x = hits.join(d, F.col(doc) == F.col("_u"), "left").join(have, F.col("_p") == F.col("_h"), "left")
    target = F.coalesce(F.col("_h"), F.col(doc)) if fallback else F.col("_h")
    x = x.withColumn("parent", target).where(F.col("parent").isNotNull())
    g = x.groupBy(query, "parent").agg(F.min(rank).alias("best"))
    w = Window.partitionBy(query).orderBy("best", "parent")
    return g.withColumn("rank", F.row_number().over(w)).select(query, "rank", "parent")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows without a new one, and the new rows; of equal new keys the last by columns wins, null keys drop."""
    n = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    return old.join(n.select(key), key, "left_anti").unionByName(n, allowMissingColumns=True)


def sync_source(old: DataFrame, new: DataFrame, source_value: str, key: str = "uid", source: str = "source", position: str = "pos"):
    """(rebuilt table, stale keys): all rows of one source replaced by `new` (last value at the first place)."""
    fresh = last_at_first_place(new.where(F.col(key).isNotNull()), key, position)
    rest = old.where(~F.col(source).eqNullSafe(F.lit(source_value)))
    stale = old.where(F.col(source).eqNullSafe(F.lit(source_value))).select(key).join(fresh.select(key), key, "left_anti").distinct()
    return rest.unionByName(fresh, allowMissingColumns=True), stale


def remaining(todo: DataFrame, done: list[DataFrame], key: str) -> DataFrame:
    """What is still to do: rows whose key is in none of the finished outputs."""
    for d in done:
        todo = todo.join(d.select(key).distinct(), key, "left_anti")
    return todo


def jaccard(a, b) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """`df` written in `order`, with _p (range) and _i (place in it): what running sums over all rows start from.

    A range sort deals the rows out; it is written once, as its limits are sampled and must not change between uses.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(d.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "ranges")


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """`df` with the place of each row in `order`, from 0. No task sees all rows; only counts by range are summed in one."""
    s = in_ranges(df, order)
    counts = s.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))  # a row a range
    return s.join(F.broadcast(base), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def carried(df: DataFrame, order: list, begins, name: str, need: list) -> DataFrame:
    """`df` with `name`: how many rows up to and with each one begin something new, in `order`, the first one not counted.

    begins: a function that gets `prev` (from a column's name, one of `need`, to its value in the row before) and returns
    a boolean column. Ranges are summed apart; the row before a range's first one, and sums of ranges, are carried over.
    """
    s = in_ranges(df, order)
    w = Window.partitionBy("_p").orderBy("_i")
    ends = s.groupBy("_p").agg(F.max_by(F.struct(*need), "_i").alias("_last"))
    over = Window.orderBy("_p")
    carry = ends.select("_p", F.lag("_last").over(over).alias("_before"))  # a row a range
    d = s.join(F.broadcast(carry), "_p").withColumn("_one", F.row_number().over(w) == 1).withColumn("_prev", F.when(F.col("_one"), F.col("_before")).otherwise(F.lag(F.struct(*need)).over(w)))
    new = F.when(F.col("_prev").isNull(), 0).otherwise(begins(lambda c: F.col("_prev")[c]).cast("int"))
    d = d.withColumn("_new", new).withColumn("_sum", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = d.groupBy("_p").agg(F.sum("_new").alias("_s")).select("_p", F.coalesce(F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return d.join(F.broadcast(sums), "_p").select(*df.columns, (F.col("_base") + F.col("_sum")).alias(name))


def islands(df: DataFrame, order: list, keys: list, partition: list | None = None) -> DataFrame:
    """`df` with island: a number that grows whenever the keys differ from those of the row before.

    With `partition` islands are numbered in each of its groups, else over all rows, in ranges.
    """
    if not partition:

        def differs(prev) -> Column:
            out = F.lit(False)
            for k in keys:
                out = out | ~F.col(k).eqNullSafe(prev(k))
            return out

        return carried(df, order, differs, "island", keys)
    w = Window.partitionBy(*partition).orderBy(*order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    d = df.withColumn("_c", F.when(F.row_number().over(w) == 1, 0).when(same, 0).otherwise(1))
    return d.withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
