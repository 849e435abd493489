"""Five-sum sufficient statistics of a weighted two-component label and the impurity built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the sufficient statistics, in storage order.
STATS = ("n", "s1", "s2", "q1", "q2")


def row_terms(y1: Column, y2: Column, w: Column | None = None) -> dict[str, Column]:
    """What one row adds to each statistic."""
    terms = {"n": F.lit(1.0), "s1": y1, "s2": y2, "q1": y1 * y1, "q2": y2 * y2}
    if w is not None:
        terms = {name: term * w for name, term in terms.items()}
    return terms


def sums(y1: Column, y2: Column, w: Column | None = None) -> list[Column]:
    """Aggregates for ``groupBy(...).agg(*sums(...))``."""
    return [F.sum(term).alias(name) for name, term in row_terms(y1, y2, w).items()]


def variance_sql(prefix: str) -> str:
    """Sum of the two channel variances of the statistics ``<prefix>_n, <prefix>_s1, ...``; 0 for an empty set."""
    n, s1, s2, q1, q2 = (f"{prefix}_{name}" for name in STATS)
    return f"CASE WHEN {n} > 0 THEN greatest(({q1} + {q2} - ({s1} * {s1} + {s2} * {s2}) / {n}) / {n}, 0.0D) ELSE 0.0D END"


def gain(impurity: Column, n: Column, nl: Column, impl: Column, nr: Column, impr: Column) -> Column:
    return impurity - nl / n * impl - nr / n * impr


IMPURITIES: dict[str, Callable[[str], str]] = {"variance": variance_sql}


def impurity_sql(name: str) -> Callable[[str], str]:
    """The named impurity as a builder of SQL text from a column prefix."""
    if name not in IMPURITIES:
        raise ValueError(f"unknown impurity {name!r}; known: {sorted(IMPURITIES)}")
    return IMPURITIES[name]
