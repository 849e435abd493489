"""Text helpers: report parsing, natural ordering, run stamps, list notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed text of the evaluation report that later runs parse back.
BEST_RAND_LINE = "Best Threshold for Rand F-score: "


def best_threshold_in(report: Column) -> Column:
    return F.regexp_extract(report, BEST_RAND_LINE + r"([0-9.]*)", 1).try_cast("double")


def natural_key(name: Column, digits: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers: each run is left-padded with zeros."""
    padded = F.regexp_replace(name, r"(\d+)", "0" * digits + "$1")
    return F.regexp_replace(padded, r"\d*(\d{" + str(digits) + "})", "$1")
