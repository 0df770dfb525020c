"""Candidates that wait for a decision before they are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Staging:
    """Batches by name, in the order they were emitted. Nothing is evaluated until they are promoted."""

    def __init__(self):
        self._held: dict[str, DataFrame] = {}

    def emit(self, name: str, batch: DataFrame) -> None:
        if name in self._held:
            raise ValueError(f"{name!r} is staged already")
        self._held[name] = batch

    def list(self) -> list[str]:
        return list(self._held)

    def take(self, name: str) -> DataFrame:
        if name not in self._held:
            raise KeyError(f"nothing is staged as {name!r}")
        return self._held.pop(name)

    def discard(self, name: str) -> bool:
        return self._held.pop(name, None) is not None

    def promote_all(self, commit: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
        """Commit everything in order; what was committed is no longer staged."""
        return {name: commit(self.take(name)) for name in self.list()}
