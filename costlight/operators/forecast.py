"""Trend-aware forecast of the next days and the day on which a budget breaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .baseline import weekday_factors
from .series import attach

HORIZON = 30
TREND_DAYS = 28


def level_trend(leveled: DataFrame, keys: Sequence[str] = (), days: int = TREND_DAYS) -> DataFrame:
    """last_day, last_level and slope (level by day, least squares over the last days; 0 for one day)."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("day")))
    recent = leveled.withColumn("k", back).where(F.col("k") <= days)
    return recent.groupBy(*keys).agg(F.max("day").alias("last_day"), F.max_by("level", "day").alias("last_level"), F.coalesce(F.regr_slope("level", -F.col("k")), F.lit(0.0)).alias("slope"))


def forecast_daily(leveled: DataFrame, keys: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """k, day, projected, cumulative of the days ahead."""
    trend = level_trend(leveled, keys)
    ahead = trend.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("day", F.expr("date_add(last_day, k)")).withColumn("weekday", F.weekday("day"))
    factors = weekday_factors(leveled, keys)
    joined = ahead.join(factors if keys else F.broadcast(factors), [*keys, "weekday"])
    joined = joined.withColumn("projected", F.greatest(F.col("last_level") + F.col("slope") * F.col("k"), F.lit(0.0)) * F.col("factor"))
    total = F.sum("projected").over(Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.select(*keys, "k", "day", "projected", total.alias("cumulative"))


def forecast_summary(leveled: DataFrame, budget: float | None = None, keys: Sequence[str] = (), horizon: int = HORIZON) -> DataFrame:
    """One row by keys: horizon_days, projected_spend, run_rate_spend, daily_trend, budget_breach_day (null without a breach)."""
    daily = forecast_daily(leveled, keys, horizon)
    breach = F.min(F.when(F.col("cumulative") > F.lit(float(budget)), F.col("k"))) if budget is not None and budget > 0 else F.lit(None).cast("int")
    ahead = daily.groupBy(*keys).agg(F.sum("projected").alias("projected_spend"), breach.alias("budget_breach_day"))
    rate = leveled.groupBy(*keys).agg((F.avg("cost") * horizon).alias("run_rate_spend"))
    out = attach(attach(ahead, rate, keys), level_trend(leveled, keys).select(*keys, F.col("slope").alias("daily_trend")), keys)
    return out.select(*keys, F.lit(horizon).alias("horizon_days"), "projected_spend", "run_rate_spend", "daily_trend", "budget_breach_day")
