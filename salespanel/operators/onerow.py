"""Single-row findings that can share one aggregation pass.

Many findings are one-row aggregates of the same table (counts, means,
null counts, correlations, bounds). Each is described as its aggregate
expressions plus the projection that turns the one-row result into the
finding, so a caller can evaluate any number of them in ONE scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass
class OneRow:
    aggs: list[Column]                          # uniquely aliased aggregates
    finish: Callable[[DataFrame], DataFrame]    # one-row result -> finding


def run(df: DataFrame, spec: OneRow) -> DataFrame:
    """Evaluate one finding on its own."""
    return spec.finish(df.agg(*spec.aggs))


def run_together(df: DataFrame, specs: dict[str, OneRow]) -> tuple[DataFrame, dict[str, Callable[[DataFrame], DataFrame]]]:
    """All ``specs`` as ONE aggregation over ``df``: returns the one-row
    result and, per name, the projection that reads its finding from it
    (apply it to the result, or to the result written and read back)."""
    wide = df.agg(*[a for s in specs.values() for a in s.aggs])
    return wide, {name: s.finish for name, s in specs.items()}
