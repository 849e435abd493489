"""Seconds and row counts of the phases of a run, counted by Spark while the phases' own jobs run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Phase:
    """One phase: its name, seconds and counters."""

    name: str
    seconds: float = 0.0
    counters: dict[str, float] = field(default_factory=dict)

    def add(self, **counters: float | None) -> None:
        for name, value in counters.items():
            self.counters[name] = self.counters.get(name, 0) + (value or 0)


class PhaseLog:
    """Phases in order. Counters of a frame are an ``Observation``: no job of their own, and no second pass."""

    def __init__(self) -> None:
        self.phases: list[Phase] = []
        self._open: list[tuple[Phase, Observation]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[Phase]:
        """Time a phase; observed frames must have been run when it ends."""
        phase, started = Phase(name), time.time()
        self.phases.append(phase)
        try:
            yield phase
            for owner, seen in self._open:
                owner.add(**seen.get)
        finally:
            phase.seconds = time.time() - started
            self._open.clear()

    def watch(self, df: DataFrame, **counters: Column) -> DataFrame:
        """Count rows (and what ``counters`` name) of ``df`` in the current phase, whenever an action reads it."""
        seen = Observation()
        self._open.append((self.phases[-1], seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counters.items()])

    def lines(self) -> list[str]:
        return [f"{p.name}: {p.seconds:.1f} s" + "".join(f", {name} {value:g}" for name, value in p.counters.items()) for p in self.phases]
