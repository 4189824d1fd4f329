"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector over its norm; a zero vector stays as it is."""
    n = F.greatest(norm(a), F.lit(EPS))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 where a vector is zero or null."""
    p = norm(a) * norm(b)
    return F.coalesce(F.when(p > EPS, dot(a, b) / p), F.lit(0.0))


def sparse_dot(a, b) -> Column:
    """Inner product of two maps of weights: the sum over their shared keys."""
    shared = F.array_intersect(F.map_keys(_c(a)), F.map_keys(_c(b)))
    return F.aggregate(shared, F.lit(0.0), lambda s, k: s + F.element_at(_c(a), k).cast("double") * F.element_at(_c(b), k).cast("double"))


def mean(vectors) -> Column:
    """Mean of an array of vectors of one length; null where there is none."""
    v = _c(vectors)
    n = F.size(v)
    total = F.aggregate(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get(v, F.lit(0)), lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x, lambda p, q: p + q.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def softmax(scores) -> Column:
    s = _c(scores)
    m = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(x - m))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))
