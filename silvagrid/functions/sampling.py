"""Reproducible pseudo-random numbers computed from keys, the same on every retry and in any SQL engine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the mixing rule: a prime modulus, a multiplier and a seed stride.
MODULUS = 2147483647
MULTIPLIER = 48271
SEED_STRIDE = 40503


def mix(key: Column, seed: Column | int) -> Column:
    """A BIGINT in [0, MODULUS): one linear and one quadratic step modulo a prime."""
    seed_col = F.lit(seed) if isinstance(seed, int) else seed
    start = F.pmod(key.cast("bigint") + seed_col.cast("bigint") * SEED_STRIDE, F.lit(MODULUS))
    spread = F.pmod(start * MULTIPLIER, F.lit(MODULUS))
    return F.pmod(spread * spread + spread, F.lit(MODULUS))


def uniform(key: Column, seed: Column | int) -> Column:
    """A DOUBLE in [0, 1) decided by ``key`` and ``seed``."""
    return mix(key, seed) / float(MODULUS)


def uniform_array(keys: np.ndarray, seed: int) -> np.ndarray:
    """``uniform`` for a batch of keys inside a task."""
    start = (keys + seed * SEED_STRIDE) % MODULUS
    spread = start * MULTIPLIER % MODULUS
    return (spread * spread + spread) % MODULUS / float(MODULUS)


def mix_sql(key: str, seed: str) -> str:
    """The same rule as text for an SQL engine with BIGINT arithmetic."""
    spread = f"((({key} + {seed} * {SEED_STRIDE}) % {MODULUS}) * {MULTIPLIER}) % {MODULUS}"
    return f"(({spread}) * ({spread}) + ({spread})) % {MODULUS}"


@dataclass(frozen=True)
class FeatureDraw:
    """The ``tried`` features of a node: those of the least mixed keys, decided by seed, tree and node alone."""

    seed: int
    num_features: int
    tried: int

    def apply(self, nodes: DataFrame) -> DataFrame:
        """Rows of ``nodes`` (tree, node_id, ...), one per drawn ``feature``: a bottom-k inside each row."""
        key = F.col("node_id").cast("bigint") * self.num_features
        scores = F.transform(F.sequence(F.lit(0), F.lit(self.num_features - 1)), lambda f: F.struct(
            mix(key + f, F.col("tree") + self.seed).alias("score"), f.cast("int").alias("feature")))
        return nodes.withColumn("_drawn", F.explode(F.slice(F.array_sort(scores), 1, self.tried))).withColumn(
            "feature", F.col("_drawn.feature")).drop("_drawn")

    def mask(self, tree: int, node_id: int) -> np.ndarray:
        """The same draw inside a task, as one flag per feature."""
        scores = uniform_array(np.int64(node_id) * self.num_features + np.arange(self.num_features), tree + self.seed)
        found = np.zeros(self.num_features, bool)
        found[np.argsort(scores, kind="stable")[: self.tried]] = True
        return found

    def sql(self, node: str, feature: str, tree: int) -> str:
        """The score as text for an SQL engine."""
        return mix_sql(f"({node} * {self.num_features} + {feature})", str(tree + self.seed))
