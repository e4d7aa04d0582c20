"""Order inside keys of any size: rows are dealt by range of (key, order), so a key with a third of all rows lies in
many segments, each sorted by itself, and what earlier segments hold is carried over from one row per key and segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_once

SEGMENT = "__segment"


def segmented(df: DataFrame, *order: str | Column, name: str = "segmented") -> DataFrame:
    """``df`` with its segment; rows of a lower segment come before those of a higher one in ``order``. Written once, so the
    segments of all later reads agree."""
    return write_once(df.repartitionByRange(*order).withColumn(SEGMENT, F.spark_partition_id()), name)
