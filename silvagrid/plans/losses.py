"""Pluggable losses: a scored frame in, training rows with gradients and a loss column out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvagrid.functions import vec2
from silvagrid.operators import malis


class Loss(Protocol):
    """``scored`` carries labels y1, y2 and predictions f1, f2; the result adds g1, g2 (the
    direction in which to move the prediction) and ``loss``. ``mean_loss`` aggregates it."""

    def gradients(self, scored: DataFrame, seed: int) -> DataFrame: ...

    def mean_loss(self) -> Column: ...


class SquaredLoss:
    """``|y - f|^2`` per row, with gradient rows ``2 (y - f)``."""

    def gradients(self, scored: DataFrame, seed: int = 0) -> DataFrame:
        diff = vec2.sub(vec2.vec("y1", "y2"), vec2.vec("f1", "f2"))
        g1, g2 = vec2.scale(diff, 2.0)
        return scored.withColumns({"g1": g1, "g2": g2, "loss": vec2.sq(diff)})

    def mean_loss(self) -> Column:
        return F.avg("loss")


class MalisLoss:
    """Pair-counting loss on sampled windows; rows outside the windows vanish and rows in
    several windows appear once per window. Needs tile, r, c and a ``dims`` frame."""

    def __init__(self, dims: DataFrame, subsample: float = 1.0, size: int = 64) -> None:
        self.dims, self.subsample, self.size = dims, subsample, size

    def gradients(self, scored: DataFrame, seed: int = 0) -> DataFrame:
        windows = malis.sample_windows(self.dims, self.subsample, seed, self.size)
        return malis.window_gradients(scored, windows, self.size)

    def mean_loss(self) -> Column:
        # ``loss`` sits on the first pixel of each window and already carries 1/(windows of its
        # tile), so the sum over rows divided by the number of tiles is the mean over tiles.
        return F.sum("loss") / F.count_distinct("tile")


LOSSES: dict[str, Callable[..., Loss]] = {"squared": SquaredLoss, "malis": MalisLoss}


def named_loss(name: str, dims: DataFrame | None = None, subsample: float = 1.0) -> Loss:
    """The loss of this name; the pair-counting one needs the tile dimensions and takes the window proportion."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(LOSSES)}")
    if name != "malis":
        return LOSSES[name]()
    if dims is None:
        raise ValueError("the malis loss needs tile dimensions")
    return LOSSES[name](dims, subsample)
