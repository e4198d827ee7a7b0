"""Contracts on streams.  Admits, transforms and flags keep no state, so the view's
plan holds for streams as it stands; verdict counters are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..compiler import Compiled
from ..operators.governed import Caller, validate, view


def governed_stream(stream: DataFrame, c: Compiled, caller: Caller) -> DataFrame:
    return view(stream, c, caller)


class Counters:
    """Mergeable part of the verdict over a stream: rows and failures by rule."""

    def __init__(self, c: Compiled):
        self.c, self.rows, self.failures, self.batches = c, 0, dict.fromkeys((i for i, _, _ in c.asserts), 0), set()

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        """For ``foreachBatch``; a batch that is replayed counts once."""
        if epoch in self.batches:
            return
        v = validate(batch, self.c)
        self.batches.add(epoch)
        self.rows += v.row_count
        for k, n in v.failures.items():
            self.failures[k] += n

    def pass_rate(self, rule: str) -> float:
        return 1.0 - self.failures[rule] / self.rows if self.rows else 1.0
