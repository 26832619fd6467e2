"""Vector Column functions on ARRAY<FLOAT|DOUBLE>, computed in DOUBLE with a
sequential left fold (same summation order in every engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def sq_l2(a, b) -> Column:
    """Squared euclidean distance (what a flat L2 index reports)."""
    return _sum(F.zip_with(_c(a), _c(b),
                           lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a) -> Column:
    """Divide by the L2 norm; an all-zero vector is left unchanged."""
    n = norm(a)
    return F.when(n == 0, F.transform(_c(a), lambda x: x.cast("double"))).otherwise(
        F.transform(_c(a), lambda x: x.cast("double") / n))


def l2_similarity(a, b) -> Column:
    """1 / (1 + squared L2 distance)."""
    return 1.0 / (1.0 + sq_l2(a, b))


def normalize_column(df, col: str, out: str | None = None):
    """DataFrame form of ``l2_normalize``: the norm is materialised as a
    column first, so it is computed once per row rather than per element."""
    out = out or col
    tmp = f"__norm_{col}"
    d = df.withColumn(tmp, norm(col))
    d = d.withColumn(out, F.when(F.col(tmp) == 0, F.transform(col, lambda x: x.cast("double")))
                     .otherwise(F.transform(col, lambda x: x.cast("double") / F.col(tmp))))
    return d.drop(tmp)
