"""Epoch arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
#: Epoch values below this are seconds.
SECONDS_BELOW = 10_000_000_000


def timestamp_ms(value: Column) -> Column:
    """Epoch milliseconds of a number in milliseconds or (below 1e10) seconds; NULL if unknown or not positive."""
    return F.when(value > 0, F.when(value < SECONDS_BELOW, value * 1000).otherwise(value)).cast("long")


def epoch_ms(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a timestamp column; one without zone is read as UTC whatever the session's zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_millis(F.col(name))
