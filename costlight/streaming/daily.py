"""Daily costs of a stream of line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import baseline, series


def daily_stream(items: DataFrame, time: str = "ts", cost: str = "cost", late: str = "2 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """day, cost by tumbling day; items later than the watermark are left out, as a day's total is then final."""
    stamped = items.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    days = stamped.groupBy(F.window(time, "1 day").alias("w"), *keys).agg(F.round(F.sum(cost), 6).alias("cost"))
    return days.select(*keys, F.col("w.start").cast("date").alias("day"), "cost")


def start_analysis(days: DataFrame, history: str, report: Callable[[DataFrame, int], None], checkpoint: str, keys: tuple[str, ...] = ()) -> StreamingQuery:
    """Keeps daily totals at the path history and hands scored days to report after each batch.

    Batches write into folders of their own number, so one that runs twice counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/batch={number}")
        known = batch.sparkSession.read.parquet(history).groupBy(*keys, "day").agg(F.max_by("cost", "batch").alias("cost"))
        filled = series.calendar(known, keys).join(known, [*keys, "day"], "left").select(*keys, "day", F.coalesce("cost", F.lit(0.0)).alias("cost"))
        report(baseline.scored(filled, keys), number)

    return days.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).start()
