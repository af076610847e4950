"""Robust statistics of ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import center_of

MAD_TO_SIGMA = 0.6745


def rolling_median(value: str, order: str, keys: Sequence[str] = (), window: int = 7) -> Column:
    """Centred median of an odd number of rows, fewer at the ends; a short series takes a narrower window."""
    by = Window.partitionBy(*keys)
    reach = max(1, window) // 2
    n = F.count(F.lit(1)).over(by)
    width = F.greatest(F.lit(1), F.least(F.lit(window), n))
    half = F.floor((width - (width + 1) % 2) / 2)
    place = F.row_number().over(by.orderBy(order))
    near = F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))).over(by.orderBy(order).rowsBetween(-reach, reach))
    # The frame holds up to reach rows before; of these, half are wanted.
    before = F.least(place - 1, F.lit(reach))
    first = F.greatest(before - half, F.lit(0)) + 1
    last = F.least(before + half + 1, F.size(near))
    picked = F.slice(near, first.cast("int"), (last - first + 1).cast("int"))
    return center_of(F.transform(picked, lambda x: x["v"]))


def mad(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Median absolute deviation about the median, by keys; 0 for no rows."""
    centred = df.withColumn("_d", F.abs(F.col(value) - F.median(value).over(Window.partitionBy(*keys))))
    return centred.groupBy(*keys).agg(F.coalesce(F.median("_d"), F.lit(0.0)).alias("mad"))


def modified_z(residual: str, keys: Sequence[str] = ()) -> Column:
    """Residual over its median magnitude (times 0.6745); over its population deviation if that is 0; else 0."""
    by = Window.partitionBy(*keys)
    scale = F.median(F.abs(F.col(residual))).over(by)
    spread = F.stddev_pop(residual).over(by)
    return F.when(scale > 0, MAD_TO_SIGMA * F.col(residual) / scale).when(spread > 0, F.col(residual) / spread).otherwise(0.0)
