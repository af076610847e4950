"""One series analysed: a shared scored plan, a row of scalars, and a few small collects."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import functions as F

from ..functions import rounded_number
from ..operators import baseline, forecast, recommend, series
from ..sources.billing import DEFAULT_CURRENCY, Billing

LEAST_DAYS = 3


@dataclass
class Anomaly:
    date: str
    expectedCost: float
    actualCost: float
    deviation: float
    zScore: float
    severity: str
    description: str


@dataclass
class Metrics:
    averageDailyCost: float = 0.0
    stdDeviation: float = 0.0
    sharpeRatio: float = 0.0
    wastePercentage: float = 0.0


@dataclass
class Recommendation:
    title: str
    description: str
    potentialSavings: float
    effort: str


@dataclass
class Forecast:
    horizonDays: int
    projectedSpend: float
    runRateSpend: float
    dailyTrend: float
    budget: float | None
    budgetBreachDay: int | None
    method: str = "rolling median level, weekday factors, linear trend"


@dataclass
class Analysis:
    anomalies: list[Anomaly] = field(default_factory=list)
    metrics: Metrics = field(default_factory=Metrics)
    recommendations: list[Recommendation] = field(default_factory=list)
    summary: str = ""
    forecast: Forecast | None = None

    def to_dict(self) -> dict:
        return asdict(self)


def _anomaly(r) -> Anomaly:
    side = "above" if r.cost > r.expected else "below"
    text = f"{r.cost:,.2f} spent, {abs(r.deviation):.1f}% {side} the {r.expected:,.2f} expected for this weekday"
    return Anomaly(r.day.isoformat(), rounded_number(r.expected, 2), rounded_number(r.cost, 2), rounded_number(r.deviation, 2), rounded_number(r.zscore, 2), r.severity, text)


def _recommendation(r, currency: str) -> Recommendation:
    saving = rounded_number(r.savings, 2)
    title, text = {
        "excess": lambda: ("Investigate spend above the modelled baseline", f"{int(r.detail)} day(s) cost more than expected; at this rate that is {saving:,.2f} {currency} in 30 days."),
        "weekend": lambda: (f"Idle weekend spend in {r.service}", f"{r.service} costs {r.detail:.0%} of its weekday spend at weekends; stopping it then saves up to {saving:,.2f} {currency} in 30 days."),
        "commitment": lambda: ("Cover the steady part with a commitment", f"Nine days of ten cost {r.detail:,.2f} {currency} or more; a commitment at a typical discount of {recommend.COMMITMENT_DISCOUNT:.0%} on that part saves {saving:,.2f} in 30 days."),
        "concentration": lambda: (f"{r.service} carries most of the bill", f"{r.service} makes up {r.detail:.0%} of the spend; a tenth less of it saves {saving:,.2f} {currency} in 30 days."),
        "volatility": lambda: ("Daily costs swing widely", f"The daily mean is {r.detail:.2f} times the standard deviation; look for batch jobs and scaling without limits."),
    }[r.rule]()
    return Recommendation(title, text, saving, r.effort)


def analyze(billing: Billing, analysis_type: str = "waste-audit", *, max_anomalies: int = baseline.MAX_ANOMALIES, max_services: int = series.TOP_SERVICES, budget: float | None = None) -> Analysis:
    """Report on one series (no keys). Figures are rounded to cents on the driver, and only here."""
    if analysis_type not in recommend.ANALYSIS_TYPES:
        raise ValueError(f"unknown analysis type {analysis_type!r}")
    days = billing.by_day().cache()  # a row for each service and day, whatever the number of line items
    try:
        items = days.where("good")
        stats = days.agg(F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("rows_parsed"), F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("rows_skipped"), F.min(F.when(F.col("good"), F.col("named")))["currency"].alias("currency")).first()
        currency = stats.currency or DEFAULT_CURRENCY
        daily = series.daily_series(items)
        score = baseline.scored(daily).cache()
        facts = baseline.metrics(score)
        m = facts.first()
        if m is None or m.days < LEAST_DAYS:
            return Analysis(summary=f"At least {LEAST_DAYS} days of data are needed; got {m.days if m else 0}.")
        found = baseline.top_anomalies(score, max_anomalies).collect()
        services = series.service_daily(items, max_services)
        advice = [_recommendation(r, currency) for r in recommend.recommendations(facts, services, analysis_type).collect()]
        advice.sort(key=lambda r: -r.potentialSavings)
        parts = [
            f"{m.days} days, {stats.rows_parsed} line items, {currency} {m.total:,.2f} in total: {m.mean:,.2f} a day, stability {m.stability:.2f}.",
            f"{m.n_anomalies} anomalous day(s); {m.waste_percentage:.1f}% of spend above the expected; savings identified: {sum(r.potentialSavings for r in advice):,.2f} in 30 days.",
        ]
        if stats.rows_skipped:
            parts.append(f"{stats.rows_skipped} row(s) could not be read and were skipped.")
        ahead = None
        if analysis_type == "cost-forecast" or budget is not None:
            f = forecast.forecast_summary(score, budget).first()
            ahead = Forecast(f.horizon_days, rounded_number(f.projected_spend, 2), rounded_number(f.run_rate_spend, 2), rounded_number(f.daily_trend, 2), None if budget is None else rounded_number(budget, 2), f.budget_breach_day)
            trend = "rising" if ahead.dailyTrend > 0 else "falling" if ahead.dailyTrend < 0 else "flat"
            parts.append(f"Projected 30-day spend {ahead.projectedSpend:,.2f} ({trend}, {ahead.dailyTrend:+,.2f} a day).")
            if budget is not None:
                parts.append(f"The budget is crossed on day {ahead.budgetBreachDay}." if ahead.budgetBreachDay else "The budget is not projected to be crossed.")
        metrics = Metrics(rounded_number(m.mean, 2), rounded_number(m.std, 2), rounded_number(m.stability, 2), rounded_number(m.waste_percentage, 2))
        return Analysis([_anomaly(r) for r in found], metrics, advice, " ".join(parts), ahead)
    finally:
        days.unpersist()
        if "score" in locals():
            score.unpersist()


def batch_anomalies(billing: Billing, most: int = baseline.MAX_ANOMALIES):
    """Many accounts at once: each key's strongest anomalies, as a DataFrame."""
    keys = billing.keys
    return baseline.top_anomalies(baseline.scored(series.daily_series(billing.items, keys), keys), most, keys)


def anomaly_structs(score):
    """Anomalies under the names of the result contract, unrounded."""
    return baseline.anomalies(score).select(F.col("day").cast("string").alias("date"), F.col("expected").alias("expectedCost"), F.col("cost").alias("actualCost"), "deviation", F.col("zscore").alias("zScore"), "severity")
