"""URL filter: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvagrid.llm.common import lower_ascii

#: Hex digits of a digest that the join uses.
PREFIX = 8


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(lower_ascii(host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty where the URL is null or has no ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    return F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has columns host, path and verdict. A rule fits its host and every subdomain
    if the URL's path starts with the rule's path. The longest rule (host and path
    together) wins, then the longer host, then ``block``; without a fitting rule the verdict is ``default``.

    A URL is expanded into one expression per shape (labels of the host suffix, length of the path
    prefix) that occurs among the rules; the distinct shapes come to the driver, at most 127
    labels times the path lengths in use. Null and odd URLs have an empty host and path and fit no rule with
    a host. Repeated rows come back as often as they came; a null key is a key like any
    other; other columns are ignored; rules with a null field never fit.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct().select(
        "*", _labels(F.col("host")).alias("labels"), F.length("path").alias("length"))
    shapes = sorted((r.labels, r.length) for r in rules.select("labels", "length").distinct().collect())
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"), F.concat("host", "path").alias("rule"),
        "verdict", F.length("host").alias("host_length"))
    known = known.withColumn("short", F.substring("rule_digest", 1, PREFIX))

    parts = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.groupBy("key", "host", "path").agg(F.count("*").alias("copies"))
    keys = ["key", "host", "path", "copies"]
    expressions = [
        F.when((_labels(F.col("host")) >= labels) & (F.length("path") >= length),
               _digest(F.substring_index("host", ".", -labels), F.substring("path", 1, length)))
        for labels, length in shapes
    ]
    digests = F.filter(F.array(*expressions).cast("array<string>"), lambda x: x.isNotNull())
    asked = parts.select(*keys, F.explode_outer(digests).alias("digest"))
    asked = asked.withColumn("short", F.substring("digest", 1, PREFIX))
    met = asked.join(known, "short", "left").select(
        *keys, F.when(F.col("digest") == F.col("rule_digest"), F.struct(
            F.length("rule").alias("length"), "host_length", (F.col("verdict") == "block").alias("blocks"),
            "rule", "verdict")).alias("fit"))
    best = met.groupBy(*keys).agg(F.max("fit").alias("fit"))
    return best.select(
        F.col("key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")
