"""Table helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate, a fitted
    statistic, a threshold) to every row.  The one-row side is broadcast, so
    this is a map-side nested-loop join against a single row: no shuffle and
    no multiplication of rows."""
    return df.crossJoin(F.broadcast(row))
