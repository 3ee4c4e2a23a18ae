"""Expressions on ``array<double>`` columns that stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside lambdas, where nothing is hoisted."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Divide by the norm, which is held at ``eps`` or above."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda length: F.transform(v, lambda x: x / length))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def log_sum_exp(v: Column) -> Column:
    return let(
        F.array_max(v),
        lambda peak: peak + F.ln(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - peak))))


def softmax(v: Column) -> Column:
    return let(log_sum_exp(v), lambda mass: F.transform(v, lambda x: F.exp(x - mass)))


def ranked_classes(logits: Column) -> Column:
    """Structs ``(neg, cls)`` from the largest logit down; equal logits keep the lower class first."""
    return F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("cls"))))


def top_classes(logits: Column, k: int) -> Column:
    return F.transform(F.slice(ranked_classes(logits), 1, k), lambda s: s["cls"])


def all_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
