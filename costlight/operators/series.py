"""Line items to gap-free daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rounded

TOP_SERVICES = 25


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds one row of facts by keys; without keys facts is a single row, which is broadcast."""
    return df.join(facts, list(keys)) if keys else df.crossJoin(F.broadcast(facts))


def _cents(c: Column) -> Column:
    return rounded(c, 6)


def daily_totals(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cost by day (six decimals), for days that have items."""
    return items.groupBy(*keys, "day").agg(_cents(F.sum("cost")).alias("cost"))


def calendar(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each day from the first to the last."""
    ends = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    return ends.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))


def daily_series(items: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """day, cost without gaps: days without items cost 0."""
    totals = daily_totals(items, keys)
    return calendar(totals, keys).join(totals, [*keys, "day"], "left").select(*keys, "day", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def service_rank(items: DataFrame, top: int | None = TOP_SERVICES, keys: Sequence[str] = ()) -> DataFrame:
    """service, total, service_rank by total (ties: the service that comes first in the items)."""
    totals = items.groupBy(*keys, "service").agg(F.sum("cost").alias("total"), F.min("seq").alias("first_seq"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("total"), "first_seq", "service"))
    ranked = totals.withColumn("service_rank", rank)
    return (ranked if top is None else ranked.where(F.col("service_rank") <= top)).select(*keys, "service", "total", "service_rank")


def service_daily(items: DataFrame, top: int | None = TOP_SERVICES, keys: Sequence[str] = ()) -> DataFrame:
    """service, service_rank, day, cost: a dense grid of the top services and all days."""
    by_day = items.groupBy(*keys, "service", "day").agg(_cents(F.sum("cost")).alias("cost"))
    ranked = service_rank(items, top, keys).select(*keys, "service", "service_rank")
    days = calendar(items.select(*keys, "day"), keys)
    # Without keys the ranked services are at most top rows.
    grid = ranked.join(days, list(keys)) if keys else days.crossJoin(F.broadcast(ranked) if top is not None else ranked)
    return grid.join(by_day, [*keys, "service", "day"], "left").select(*keys, "service", "service_rank", "day", F.coalesce("cost", F.lit(0.0)).alias("cost"))
