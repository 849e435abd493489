"""Arithmetic on two-component labels held as a pair of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec2 = tuple[Column, Column]


def vec(a: str | Column, b: str | Column) -> Vec2:
    return (F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def add(x: Vec2, y: Vec2) -> Vec2:
    return x[0] + y[0], x[1] + y[1]


def sub(x: Vec2, y: Vec2) -> Vec2:
    """``x - y`` in the ordinary order."""
    return x[0] - y[0], x[1] - y[1]


def div(x: Vec2, y: Vec2) -> Vec2:
    return x[0] / y[0], x[1] / y[1]


def scale(x: Vec2, k: float | Column) -> Vec2:
    return x[0] * k, x[1] * k


def maximum(x: Vec2, y: Vec2) -> Vec2:
    return F.greatest(x[0], y[0]), F.greatest(x[1], y[1])


def total(x: Vec2) -> Column:
    return x[0] + x[1]


def mean(x: Vec2) -> Column:
    return (x[0] + x[1]) / 2


def largest(x: Vec2) -> Column:
    return F.greatest(*x)


def smallest(x: Vec2) -> Column:
    return F.least(*x)


def sq(x: Vec2) -> Column:
    """Squared length."""
    return x[0] * x[0] + x[1] * x[1]


def component(x: Vec2, direction: Column) -> Column:
    """Component 1 or 2, chosen per row."""
    return F.when(direction == 1, x[0]).when(direction == 2, x[1])
