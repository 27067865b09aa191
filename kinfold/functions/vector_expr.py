"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.hashing import as_col


def difference(mut: str | Column, wt: str | Column) -> Column:
    return F.zip_with(as_col(mut), as_col(wt), lambda a, b: a.cast("double") - b.cast("double"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: str | Column) -> Column:
    return F.sqrt(
        F.aggregate(as_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def direction(a: str | Column, eps: float = 1e-8) -> Column:
    """The vector over its length, with the length floored by ``eps``."""
    length = norm(a) + F.lit(eps)
    return F.transform(as_col(a), lambda x: x.cast("double") / length)


def argmax_label(proba: str | Column, classes) -> Column:
    """The declared class with the largest share; the first declared one on a tie."""
    p = as_col(proba)
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
