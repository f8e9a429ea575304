"""Wall-clock times of a job's phases."""

from __future__ import annotations

import time


class Timer:
    """Seconds since the last mark, and in all."""

    def __init__(self):
        self.begun = self.last = time.perf_counter()
        self.phases: list[tuple[str, float]] = []

    def mark(self, name: str) -> float:
        """Ends a phase; returns its seconds."""
        now = time.perf_counter()
        delta, self.last = now - self.last, now
        self.phases.append((name, delta))
        return delta

    @property
    def total(self) -> float:
        return time.perf_counter() - self.begun
