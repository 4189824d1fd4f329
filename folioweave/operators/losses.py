"""Ranking losses as aggregations over scored rows (query, doc, score, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pointwise_mse(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("loss"))


def pointwise_bce(rows: DataFrame) -> DataFrame:
    """Binary cross entropy of logits."""
    x = F.col("score")
    return rows.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * F.col("label") + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def pairwise_ranknet(rows: DataFrame) -> DataFrame:
    """Mean over ordered pairs of a query (label i > label j) of log(1+exp(s_j-s_i)), weighted by the label gap."""
    a = rows.select("query", F.col("score").alias("si"), F.col("label").alias("li"))
    b = rows.select("query", F.col("score").alias("sj"), F.col("label").alias("lj"))
    p = a.join(b, "query").where(F.col("li") > F.col("lj"))
    gap = F.col("li") - F.col("lj")
    d = F.col("sj") - F.col("si")
    loss = F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))
    return p.agg((F.sum(gap * loss) / F.sum(gap)).alias("loss"))


def listwise_ce(rows: DataFrame) -> DataFrame:
    """Mean over queries of the label-weighted negative log softmax; rows with label 0 give no target."""
    w = Window.partitionBy("query")
    m = F.max("score").over(w)
    d = rows.withColumn("m", m)
    d = d.withColumn("lse", F.col("m") + F.log(F.sum(F.exp(F.col("score") - F.col("m"))).over(w)))
    q = d.groupBy("query").agg((F.sum(F.when(F.col("label") > 0, F.col("label") * (F.col("lse") - F.col("score")))) / F.sum("label")).alias("l"))
    return q.agg(F.avg("l").alias("loss"))


def kl_to_scores(rows: DataFrame, teacher: str = "teacher") -> DataFrame:
    """Mean over queries of KL(softmax(teacher) || softmax(score))."""
    w = Window.partitionBy("query")
    d = rows.withColumn("ms", F.max("score").over(w)).withColumn("mt", F.max(teacher).over(w))
    d = d.withColumn("ls", F.col("score") - F.col("ms") - F.log(F.sum(F.exp(F.col("score") - F.col("ms"))).over(w)))
    d = d.withColumn("lt", F.col(teacher) - F.col("mt") - F.log(F.sum(F.exp(F.col(teacher) - F.col("mt"))).over(w)))
    return d.groupBy("query").agg(F.sum(F.exp("lt") * (F.col("lt") - F.col("ls"))).alias("l")).agg(F.avg("l").alias("loss"))


def in_batch_softmax(pairs: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Loss and accuracy of pairs (batch, i, qvec, dvec): each query against all documents of its bounded batch."""
    from ..functions import vectors as vx

    q, d = pairs.select("batch", "i", "qvec"), pairs.select("batch", F.col("i").alias("j"), "dvec")
    s = q.join(d, "batch").withColumn("s", vx.dot("qvec", "dvec") / temperature)
    w = Window.partitionBy("batch", "i")
    s = s.withColumn("m", F.max("s").over(w))
    s = s.withColumn("lse", F.col("m") + F.log(F.sum(F.exp(F.col("s") - F.col("m"))).over(w)))
    own = s.where("i = j")
    return own.agg(F.avg(F.col("lse") - F.col("s")).alias("loss"), F.avg((F.col("s") >= F.col("m")).cast("double")).alias("accuracy"))


def triplet_softmax(rows: DataFrame, temperature: float = 0.05) -> DataFrame:
    """Loss and accuracy of rows (qvec, pvec, nvecs: array of vectors): softmax of the positive over it and its negatives."""
    from ..functions import vectors as vx

    p = vx.dot("qvec", "pvec") / temperature
    n = F.transform("nvecs", lambda v: vx.dot(F.col("qvec"), v) / temperature)
    d = rows.select(p.alias("p"), F.concat(F.array(p), n).alias("all"))
    m = F.array_max("all")
    lse = m + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - m)))
    return d.agg(F.avg(lse - F.col("p")).alias("loss"), F.avg((F.col("p") >= m).cast("double")).alias("accuracy"))


#: Weights of the three parts of the distillation loss, and the margin of its triplets.
COSINE_WEIGHT, SIMILARITY_WEIGHT, TRIPLET_WEIGHT, MARGIN = 10.0, 200.0, 20.0, 0.015


def distillation(batch: DataFrame, dims: tuple, margin: float = MARGIN) -> DataFrame:
    """(dim, cosine, similarity, triplet, loss) for each leading length of the student's vectors.

    batch: (batch, i, student, teacher), bounded batches. cosine: mean of 1-cos with the teacher (for full length only
    where lengths agree); similarity: mean squared difference of all similarities of a batch; triplet: mean hinge over
    ordered pairs (a, b) of others where the teacher says a is nearer to i.
    """
    from ..functions import vectors as vx

    out = None
    for n in dims:
        d = batch.select("batch", "i", vx.unit(F.slice("student", 1, n)).alias("s"), vx.unit("teacher").alias("t"), vx.unit(F.slice("teacher", 1, n)).alias("u"))
        pairs = d.alias("a").join(d.alias("b"), "batch").select("batch", F.col("a.i").alias("i"), F.col("b.i").alias("j"), vx.dot("a.s", "b.s").alias("s"), vx.dot("a.t", "b.t").alias("t"))
        sim = pairs.agg(F.avg(F.pow(F.col("s") - F.col("t"), 2)).alias("similarity"))
        x, y = (pairs.where("i <> j").select("batch", "i", F.col("j").alias(f"j{k}"), F.col("s").alias(f"s{k}"), F.col("t").alias(f"t{k}")) for k in "xy")
        tri = x.join(y, ["batch", "i"]).where("tx > ty").agg(F.avg(F.greatest(F.lit(0.0), F.col("sy") - F.col("sx") + margin)).alias("triplet"))
        cos = d.agg(F.avg(1 - vx.dot("s", "u")).alias("cosine"))
        one = cos.join(F.broadcast(sim)).join(F.broadcast(tri)).withColumn("dim", F.lit(n))
        out = one if out is None else out.unionByName(one)
    loss = COSINE_WEIGHT * F.col("cosine") + SIMILARITY_WEIGHT * F.col("similarity") + TRIPLET_WEIGHT * F.coalesce("triplet", F.lit(0.0))
    return out.select("dim", "cosine", "similarity", "triplet", loss.alias("loss"))
