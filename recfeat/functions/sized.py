"""Broadcasts behind a count of their rows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint up to ``most`` counted rows; beyond that as it is, for a join that shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def listed(df: DataFrame, what: str, most: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint, for conditions that no equi-join expresses; more than ``most`` rows raise."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: at most {most} rows")
    return F.broadcast(df)


def tasks(rows: float, each: int) -> int:
    """As many tasks as give one about ``each`` of ``rows`` rows."""
    return max(1, ceil(rows / each))
