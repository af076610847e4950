"""Expected spend (level times weekday factor), scores and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rounded, severity
from . import robust

WINDOW = 7
SEASON_DAYS = 14
Z = 3.5
MAX_ANOMALIES = 25


def with_level(daily: DataFrame, keys: Sequence[str] = (), window: int = WINDOW) -> DataFrame:
    return daily.withColumn("level", robust.rolling_median("cost", "day", keys, window))


def weekday_factors(leveled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """weekday (0: Monday), factor: seven rows by keys. All 1 for under 14 days."""
    ratio = F.when(F.col("level") > 0, F.col("cost") / F.col("level"))
    found = leveled.groupBy(*keys, F.weekday("day").alias("weekday")).agg(F.median(ratio).alias("m"), F.count(ratio).alias("k"), F.count("*").alias("n"))
    seven = found.groupBy(*keys).agg(F.sum("n").alias("days")).withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
    raw = F.when((F.col("days") >= SEASON_DAYS) & (F.col("k") >= 2), F.col("m")).otherwise(1.0)
    full = seven.join(found.drop("n"), [*keys, "weekday"], "left").withColumn("raw", raw)
    mean = F.avg("raw").over(Window.partitionBy(*keys))
    return full.select(*keys, "weekday", F.when(mean > 0, F.col("raw") / mean).otherwise(F.col("raw")).alias("factor"))


def with_expected(leveled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds expected. Without keys the factors are seven rows, which are broadcast."""
    factors = weekday_factors(leveled, keys)
    joined = leveled.withColumn("weekday", F.weekday("day")).join(factors if keys else F.broadcast(factors), [*keys, "weekday"])
    return joined.withColumn("expected", F.greatest(F.col("level") * F.col("factor"), F.lit(0.0))).drop("weekday", "factor")


def scored(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """day, cost, level, expected, residual, zscore, deviation, severity, is_anomaly."""
    out = with_expected(with_level(daily, keys), keys)
    out = out.withColumn("residual", F.col("cost") - F.col("expected")).withColumn("zscore", robust.modified_z("residual", keys))
    out = out.withColumn("deviation", F.when(F.col("expected") > 0, F.col("residual") / F.col("expected") * 100).otherwise(0.0))
    return out.select(*keys, "day", "cost", "level", "expected", "residual", "zscore", "deviation", severity(F.col("zscore"), F.col("deviation")).alias("severity"), (F.abs("zscore") >= Z).alias("is_anomaly"))


def anomalies(score: DataFrame) -> DataFrame:
    return score.where("is_anomaly")


def top_anomalies(score: DataFrame, most: int = MAX_ANOMALIES, keys: Sequence[str] = ()) -> DataFrame:
    """The strongest by score (two decimals), earlier days first among equals."""
    order = [F.desc(F.abs(rounded(F.col("zscore"), 2))), F.asc("day")]
    found = anomalies(score)
    if not keys:
        return found.orderBy(*order).limit(most)
    return found.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def metrics(score: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row by keys: the scalars that metrics, rules and the forecast need."""
    above = F.col("is_anomaly") & (F.col("cost") > F.col("expected"))
    return score.groupBy(*keys).agg(
        F.count("*").alias("days"),
        F.sum("cost").alias("total"),
        F.avg("cost").alias("mean"),
        F.coalesce(F.stddev_samp("cost"), F.lit(0.0)).alias("std"),
        F.count_if("is_anomaly").alias("n_anomalies"),
        F.coalesce(F.sum(F.when(above, F.col("residual"))), F.lit(0.0)).alias("excess"),
        F.count_if(F.col("is_anomaly") & (rounded(F.col("cost"), 2) > rounded(F.col("expected"), 2))).alias("n_above"),
        F.percentile("cost", 0.1).alias("p10"),
    ).select(
        "*",
        F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0).alias("stability"),
        F.when(F.col("total") > 0, F.col("excess") / F.col("total") * 100).otherwise(0.0).alias("waste_percentage"),
    )


def flat_detector(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Textbook: distance from the mean in population deviations."""
    by = Window.partitionBy(*keys)
    sd = F.stddev_pop("cost").over(by)
    return daily.withColumn("zscore", F.when(sd > 0, (F.col("cost") - F.avg("cost").over(by)) / sd).otherwise(0.0)).withColumn("is_anomaly", F.abs("zscore") >= Z)


def median_std_detector(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling median, residuals in their population deviations."""
    out = with_level(daily, keys).withColumn("residual", F.col("cost") - F.col("level"))
    sd = F.stddev_pop("residual").over(Window.partitionBy(*keys))
    return out.withColumn("zscore", F.when(sd > 0, F.col("residual") / sd).otherwise(0.0)).withColumn("is_anomaly", F.abs("zscore") >= Z)


def median_mad_detector(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling median and modified score, without weekdays."""
    out = with_level(daily, keys).withColumn("residual", F.col("cost") - F.col("level"))
    return out.withColumn("zscore", robust.modified_z("residual", keys)).withColumn("is_anomaly", F.abs("zscore") >= Z)


DETECTORS = {"flat_std": flat_detector, "median_std": median_std_detector, "median_mad": median_mad_detector, "full": scored}


def evaluate(flagged: DataFrame, truth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (three decimals) of the flagged days against the true days.

    Nothing flagged: precision 1 if nothing was true, else 0; the like for recall.
    """
    f = flagged.where("is_anomaly").select(*keys, "day").distinct().withColumn("f", F.lit(1))
    t = truth.select(*keys, "day").distinct().withColumn("t", F.lit(1))
    both = f.join(t, [*keys, "day"], "full")
    n = both.groupBy(*keys).agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(F.when(F.col("tp") + F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0))
    n = n.withColumn("p", share("fp")).withColumn("r", share("fn"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    return n.select(*keys, "tp", "fp", "fn", rounded(F.col("p"), 3).alias("precision"), rounded(F.col("r"), 3).alias("recall"), rounded(f1, 3).alias("f1"))


