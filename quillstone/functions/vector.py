"""Vectors as array columns, in double precision, and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import vocabulary as V


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Unequal sizes are an error."""
    total = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of unequal size")).cast("double"))


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(c), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Zero where either norm is zero."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def priority_score(c: Column) -> Column:
    out = F.when(c.isNull(), F.lit(0.5))
    for k, v in V.PRIORITY_SCORES.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(0.5))


def recency_score(year: Column, current_year: int = V.CURRENT_YEAR) -> Column:
    age, out = F.lit(current_year) - year, F.when(year.isNull(), F.lit(0.5))
    for most, score in V.RECENCY_STEPS:
        out = out.when(age <= most, F.lit(score))
    return out.otherwise(F.lit(0.4))


#: Weights of cosine, model, priority and recency scores.
WEIGHTS = (0.95, 0.0, 0.025, 0.025)
MODEL_WEIGHTS = (0.50, 0.40, 0.05, 0.05)


def final_score(cosine_score: Column, model_score: Column, priority: Column, recency: Column, with_model: bool = False, weights=WEIGHTS) -> Column:
    """Linear fusion. With a model its own weights hold; without one its weight goes to the cosine."""
    c, m, p, r = MODEL_WEIGHTS if with_model else (weights[0] + weights[1], 0.0, weights[2], weights[3])
    return F.lit(c) * cosine_score + F.lit(m) * model_score + F.lit(p) * priority + F.lit(r) * recency
