"""Detection quality on synthetic series with known anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline
from ..sources.synthetic import make_series

LEAST_ADVANTAGE = 0.25

#: The scenarios' parameters and the two detectors that each compares.
SCENARIOS = {
    "masking": (dict(seed=1, n_days=90, base=1000.0, noise=0.02, spikes={12: 8.0, 37: 7.5, 66: 8.5, 23: 2.2, 51: 2.3, 80: 2.1}), "median_std", "median_mad"),
    "seasonality": (dict(seed=2, n_days=84, base=1000.0, weekend_drop=0.45, noise=0.03, spikes={30: 4.0, 61: 3.5}), "flat_std", "full"),
    "end_to_end": (dict(seed=3, n_days=90, base=800.0, weekend_drop=0.35, trend=6.0, noise=0.04, spikes={15: 6.0, 28: 3.2, 44: 5.0, 59: 2.8, 73: 4.5, 85: 3.0}), "flat_std", "full"),
}


def table(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """scenario, day, cost of all scenarios; and scenario, day of their true anomalies."""
    rows, truth = [], []
    for name, (how, _, _) in SCENARIOS.items():
        days, costs = make_series(**how)
        rows += [(name, d, c) for d, c in zip(days, costs, strict=True)]
        truth += [(name, days[k]) for k in how["spikes"]]
    return spark.createDataFrame(rows, "scenario string, day date, cost double"), spark.createDataFrame(truth, "scenario string, day date")


def scores(spark: SparkSession) -> DataFrame:
    """scenario, detector, tp, fp, fn, precision, recall, f1: all detectors on all scenarios in one plan each."""
    daily, truth = table(spark)
    out = None
    for name, detector in baseline.DETECTORS.items():
        one = baseline.evaluate(detector(daily, ["scenario"]), truth, ["scenario"]).withColumn("detector", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("scenario", "detector", "tp", "fp", "fn", "precision", "recall", "f1")


def run(spark: SparkSession) -> dict:
    return {f"{r.scenario}/{r.detector}": {k: r[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1")} for r in scores(spark).orderBy("scenario", "detector").collect()}


def advantage(found: dict) -> float:
    _, plain, robust = SCENARIOS["end_to_end"]
    return found[f"end_to_end/{robust}"]["f1"] - found[f"end_to_end/{plain}"]["f1"]


def passes(found: dict) -> bool:
    return advantage(found) >= LEAST_ADVANTAGE


def as_text(found: dict) -> str:
    lines = [f"{k:<28} precision {v['precision']:.3f}  recall {v['recall']:.3f}  F1 {v['f1']:.3f}" for k, v in found.items()]
    return "\n".join([*lines, f"F1 advantage end to end: {advantage(found):.3f} (at least {LEAST_ADVANTAGE})"])
