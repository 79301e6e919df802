"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """Uniform 32-bit integer from the md5 of the text of ``parts``.

    Used wherever the work calls for random order or random groups, so that a
    retried task or another engine gets the same draw.
    """
    text = F.concat(*[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def l2_norm(vec: Column | str) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(vec: Column | str) -> Column:
    """``vec`` divided by its L2 norm; the zero vector stays as it is."""
    norm = l2_norm(vec)
    return F.transform(vec, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def euclidean(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
