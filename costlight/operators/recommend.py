"""Savings rules. Each gives 0 or more rows: rule, emit_order, service_rank, service, savings (30 days), effort and what its text needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rounded
from .baseline import SEASON_DAYS
from .series import attach

MONTH = 30
COMMITMENT_DISCOUNT = 0.25
WEEKEND_RATIO = 0.80
CONCENTRATION = 0.40
CONCENTRATION_SAVING = 0.10
LEAST_MONTHLY = 1.0
UNSTABLE = 2.0
ANALYSIS_TYPES = ("waste-audit", "cost-forecast", "efficiency")


def _row(keys, rule: str, order: int, effort: str, savings, service=None, rank=None, detail=None):
    return [
        *(F.col(k) for k in keys),
        F.lit(rule).alias("rule"),
        F.lit(order).alias("emit_order"),
        (rank if rank is not None else F.lit(0)).cast("int").alias("service_rank"),
        (service if service is not None else F.lit(None).cast("string")).alias("service"),
        savings.cast("double").alias("savings"),
        F.lit(effort).alias("effort"),
        (detail if detail is not None else F.lit(None)).cast("double").alias("detail"),
    ]


def excess(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend above the expected, a month's worth."""
    monthly = F.col("excess") / F.col("days") * MONTH
    return facts.where((F.col("excess") > 0) & (F.col("n_above") > 0)).where(monthly >= LEAST_MONTHLY).select(*_row(keys, "excess", 1, "MEDIUM", monthly, detail=F.col("n_above")))


def weekend(services: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Services that cost about as much at weekends as on weekdays."""
    off = F.weekday("day") >= 5
    by = services.groupBy(*keys, "service", "service_rank").agg(
        F.count("*").alias("days"), F.count_if(off).alias("n_off"), F.count_if(~off).alias("n_on"),
        F.median(F.when(off, F.col("cost"))).alias("m_off"), F.median(F.when(~off, F.col("cost"))).alias("m_on"),
        F.sum("cost").alias("total"), F.coalesce(F.sum(F.when(off, F.col("cost"))), F.lit(0.0)).alias("sum_off"),
    )
    by = by.where((F.col("days") >= SEASON_DAYS) & (F.col("n_off") >= 4) & (F.col("n_on") >= 8) & (F.col("m_on") > 0) & (F.col("total") > 0))
    by = by.withColumn("ratio", F.when(F.col("m_on") > 0, F.col("m_off") / F.col("m_on"))).withColumn("monthly", F.col("sum_off") / F.col("days") * MONTH)
    by = by.where((F.col("ratio") >= WEEKEND_RATIO) & (F.col("monthly") >= LEAST_MONTHLY))
    return by.select(*_row(keys, "weekend", 2, "LOW", F.col("monthly"), F.col("service"), F.col("service_rank"), F.col("ratio")))


def commitment(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A discount for committing to the level that nine days of ten exceed."""
    monthly = F.col("p10") * MONTH * COMMITMENT_DISCOUNT
    return facts.where((F.col("days") >= SEASON_DAYS) & (F.col("p10") > 0)).where(monthly >= LEAST_MONTHLY).select(*_row(keys, "commitment", 3, "MEDIUM", monthly, detail=F.col("p10")))


def concentration(services: DataFrame, facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The largest service, if it makes up much of the spend."""
    totals = services.groupBy(*keys, "service", "service_rank").agg(F.sum("cost").alias("service_total"))
    # Of equal totals the first in rank counts.
    top = totals.groupBy(*keys).agg(F.max_by("service", F.struct("service_total", -F.col("service_rank"))).alias("service"), F.max("service_total").alias("service_total"))
    joined = attach(top, facts.select(*keys, "days", "total"), keys).where("total > 0")
    joined = joined.withColumn("share", F.col("service_total") / F.col("total")).where(F.col("share") >= CONCENTRATION)
    return joined.select(*_row(keys, "concentration", 4, "MEDIUM", F.col("service_total") / F.col("days") * MONTH * CONCENTRATION_SAVING, F.col("service"), None, F.col("share")))


def volatility(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spend that swings: the mean is under twice the deviation (or the deviation is 0)."""
    return facts.where((F.col("stability") < UNSTABLE) & (F.col("mean") > 0)).select(*_row(keys, "volatility", 5, "LOW", F.lit(0.0), detail=F.col("stability")))


def recommendations(facts: DataFrame, services: DataFrame, analysis_type: str = "waste-audit", keys: Sequence[str] = ()) -> DataFrame:
    """The rules of an analysis type, most savings first (two decimals), then by rule and service."""
    if analysis_type not in ANALYSIS_TYPES:
        raise ValueError(f"unknown analysis type {analysis_type!r}")
    out = volatility(facts, keys)
    if analysis_type != "efficiency":
        for part in (concentration(services, facts, keys), commitment(facts, keys), weekend(services, keys), excess(facts, keys)):
            out = part.unionByName(out)
    return out.orderBy(*keys, F.desc(rounded(F.col("savings"), 2)), "emit_order", "service_rank")
