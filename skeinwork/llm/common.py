"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.sources.scratch import written
from skeinwork.sources.tables import read, read_spread

__all__ = ["bounded_batches", "broadcast_if_small", "read", "read_spread", "text_or_empty", "written"]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bytes of the rows of a table that is broadcast, at most.
MOST_BROADCAST = 16 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, whose rows have a fixed width, to be broadcast if all of them stay below ``MOST_BROADCAST``; else a shuffle joins it."""
    return F.broadcast(df) if df.count() * row_bytes <= MOST_BROADCAST else df


#: Rows that a Python worker is sent at a time, at most: documents are long, and a worker holds several copies of a batch.
ARROW_ROWS = 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches cut to ``ARROW_ROWS`` rows if they would be larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name))
    if now <= 0 or now > ARROW_ROWS:
        df.sparkSession.conf.set(name, ARROW_ROWS)
    return df
