"""One query for each operator over the driver's tables, and the SQL that gives the same rows.

Figures are rounded to four decimals at the very end, so that the order of additions doesn't show.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import parse_cost, parse_date, rounded, severity_rank
from .operators import baseline, forecast, recommend, robust, series
from .plans import analyze, benchmark, notify, render
from .server import answer
from .session import shared_folder
from .sources import Billing, from_dataframe, read_billing_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUDGET = 4_000_000.0


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(rounded(F.col(f.name), 4).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema))


def _add(name: str, sql: str | None):
    def wrap(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def orders(spark: SparkSession, sf_dir: str, service: str = "o_orderpriority", keys: tuple[str, ...] = ()) -> Billing:
    return from_dataframe(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_totalprice", service, keys=keys)


def lineitem(spark: SparkSession, sf_dir: str, service: str = "l_returnflag") -> Billing:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return from_dataframe(df, "l_shipdate", F.col("l_extendedprice") * (1 - F.col("l_discount")), service)


def events(spark: SparkSession, sf_dir: str) -> Billing:
    return from_dataframe(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "value", "event_type")


ITEMS = {
    "orders": "SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS cost, o_orderpriority AS service, o_orderstatus AS status FROM orders",
    "lineitem": "SELECT CAST(l_shipdate AS DATE) AS day, l_extendedprice * (1 - l_discount) AS cost, l_returnflag AS service FROM lineitem",
    "linestatus": "SELECT CAST(l_shipdate AS DATE) AS day, l_extendedprice * (1 - l_discount) AS cost, l_linestatus AS service FROM lineitem",
    "events": "SELECT CAST(ts AS DATE) AS day, value AS cost, event_type AS service FROM events",
    "spiked": "SELECT CAST(ts AS DATE) AS day, value * CASE WHEN day(ts) = 15 AND event_type IN ('click', 'purchase') THEN 60 ELSE 1 END AS cost, event_type AS service FROM events",
    "urgent": "SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS cost, o_orderstatus AS service FROM orders WHERE o_orderkey % 40 = 0",
    "exports": "SELECT CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 2) AS cost, CASE WHEN o_orderkey % 5 = 0 THEN 'unattributed' ELSE o_orderpriority END AS service FROM orders WHERE o_orderkey % 11 <> 0",
}


def spiked(spark: SparkSession, sf_dir: str) -> Billing:
    """events with one day of much dearer clicks and purchases."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    dear = (F.dayofmonth("ts") == 15) & F.col("event_type").isin("click", "purchase")
    return from_dataframe(df, "ts", F.col("value") * F.when(dear, 60).otherwise(1), "event_type")


def urgent(spark: SparkSession, sf_dir: str) -> Billing:
    """Few orders, so that the daily costs swing."""
    return from_dataframe(spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 40 = 0"), "o_orderdate", "o_totalprice", "o_orderstatus")


def exports(spark: SparkSession, sf_dir: str) -> Billing:
    """orders written as CSV in the layouts of four providers into one folder, and read from there."""
    path = f"{shared_folder(spark)}/exports-{uuid.uuid4().hex}"
    df, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    day, cost = F.col("o_orderdate"), F.when(k % 11 == 0, "n/a").otherwise(F.format_string("%.2f", F.col("o_totalprice")))
    service, money = F.when(k % 5 == 0, "  ").otherwise(F.col("o_orderpriority")), F.when(k % 3 == 0, " ").otherwise("EUR")
    layouts = [
        [k.alias("identity/LineItemId"), F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'").alias("lineItem/UsageStartDate"), F.lit("code").alias("lineItem/ProductCode"), service.alias("product/ProductName"), cost.alias("lineItem/UnblendedCost"), money.alias("lineItem/CurrencyCode")],
        [F.lit("acct").alias("billing_account_id"), service.alias("service.description"), F.date_format(day, "yyyy-MM-dd HH:mm:ss 'UTC'").alias("usage_start_time"), cost.alias("cost"), money.alias("currency")],
        [F.date_format(day, "yyyy/MM/dd").alias("Date"), service.alias("MeterCategory"), F.lit("7").alias("costCenter"), cost.alias("CostInBillingCurrency"), money.alias("BillingCurrency")],
        [cost.alias("BilledCost"), F.lit("0").alias("EffectiveCost"), money.alias("BillingCurrency"), F.date_format(day, "yyyy-MM-dd").alias("ChargePeriodStart"), F.date_format(day, "yyyy-MM-dd").alias("ChargePeriodEnd"), service.alias("ServiceName"), F.lit("all").alias("ServiceCategory")],
    ]
    for n, columns in enumerate(layouts):
        df.where(k % 4 == n).select(*columns).write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(f"{path}/{n}")
    return read_billing_csv(spark, path)


def with_daily(source: str) -> str:
    return f"""WITH items AS ({ITEMS[source]}),
totals AS (SELECT day, round(sum(cost), 6) AS cost FROM items GROUP BY day),
cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM totals),
daily AS (SELECT cal.day, coalesce(cost, 0) AS cost FROM cal LEFT JOIN totals ON totals.day = cal.day)"""


def with_factors(source: str) -> str:
    return (
        with_daily(source)
        + """,
leveled AS (SELECT day, cost, median(cost) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS level, isodow(day) - 1 AS weekday FROM daily),
found AS (SELECT weekday, median(CASE WHEN level > 0 THEN cost / level END) AS m, count(CASE WHEN level > 0 THEN 1 END) AS k FROM leveled GROUP BY weekday),
raw AS (SELECT w.weekday, CASE WHEN (SELECT count(*) FROM daily) >= 14 AND k >= 2 THEN m ELSE 1.0 END AS f FROM (SELECT unnest(range(0, 7)) AS weekday) w LEFT JOIN found USING (weekday)),
factors AS (SELECT weekday, CASE WHEN avg(f) OVER () > 0 THEN f / avg(f) OVER () ELSE f END AS factor FROM raw)"""
    )


_GRADE = "CASE WHEN abs(zscore) >= 10 OR abs(deviation) >= 200 THEN 'CRITICAL' WHEN abs(zscore) >= 7 OR abs(deviation) >= 100 THEN 'HIGH' WHEN abs(zscore) >= 5 OR abs(deviation) >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


def with_scored(source: str) -> str:
    return (
        with_factors(source)
        + f""",
expected AS (SELECT day, cost, level, greatest(level * factor, 0) AS expected FROM leveled JOIN factors USING (weekday)),
residuals AS (SELECT *, cost - expected AS residual FROM expected),
scale AS (SELECT median(abs(residual)) AS s, stddev_pop(residual) AS sd FROM residuals),
zs AS (SELECT residuals.*, CASE WHEN s > 0 THEN 0.6745 * residual / s WHEN sd > 0 THEN residual / sd ELSE 0 END AS zscore,
       CASE WHEN expected > 0 THEN residual / expected * 100 ELSE 0 END AS deviation FROM residuals, scale),
scored AS (SELECT *, {_GRADE} AS severity, abs(zscore) >= 3.5 AS is_anomaly FROM zs)"""
    )


def with_facts(source: str) -> str:
    return (
        with_scored(source)
        + """,
sums AS (SELECT count(*) AS days, sum(cost) AS total, avg(cost) AS mean, coalesce(stddev_samp(cost), 0) AS std, count(CASE WHEN is_anomaly THEN 1 END) AS n_anomalies,
  coalesce(sum(CASE WHEN is_anomaly AND cost > expected THEN residual END), 0) AS excess,
  count(CASE WHEN is_anomaly AND round(cost, 2) > round(expected, 2) THEN 1 END) AS n_above, quantile_cont(cost, 0.1) AS p10 FROM scored),
facts AS (SELECT *, CASE WHEN std > 0 THEN mean / std ELSE 0 END AS stability, CASE WHEN total > 0 THEN excess / total * 100 ELSE 0 END AS waste_percentage FROM sums)"""
    )


def with_grid(source: str) -> str:
    return f""",
ranked AS (SELECT service, sum(cost) AS total, CAST(row_number() OVER (ORDER BY sum(cost) DESC, service) AS INTEGER) AS service_rank FROM items GROUP BY service QUALIFY service_rank <= 25),
grid AS (SELECT ranked.service, service_rank, cal.day, coalesce(s.cost, 0) AS cost FROM ranked CROSS JOIN cal
  LEFT JOIN (SELECT service, day, round(sum(cost), 6) AS cost FROM items GROUP BY service, day) s ON s.service = ranked.service AND s.day = cal.day)"""


_R4 = lambda *cols: ", ".join(f"round({c}, 4) AS {c}" for c in cols)

for _name, _source in (("orders", orders), ("lineitem", lineitem), ("events", events)):
    _add(f"daily_total_{_name}", with_daily(_name) + " SELECT day, round(cost, 4) AS cost FROM daily")(lambda s, d, f=_source: series.daily_series(f(s, d).items))


@_add("service_daily_grid", with_daily("orders") + with_grid("orders") + f" SELECT service, service_rank, day, {_R4('cost')} FROM grid")
def service_daily_grid(spark, sf_dir):
    return series.service_daily(orders(spark, sf_dir).items)


@_add("service_rank_top_k", with_daily("events") + with_grid("events") + f" SELECT service, {_R4('total')}, service_rank FROM ranked WHERE service_rank <= 3")
def service_rank_top_k(spark, sf_dir):
    return series.service_rank(events(spark, sf_dir).items, top=3)


@_add(
    "parse_dates_mixed",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 5 THEN NULL ELSE o_orderdate END AS DATE) AS day FROM orders""",
)
def parse_dates_mixed(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/M/d")).when(k == 2, F.date_format(d, "yyyy-MM-dd'T'23:30:00-05:00"))
        .when(k == 3, F.date_format(d, "yyyyMMdd")).when(k == 4, F.date_format(d, "yyyy-MM-dd 00:00:00 'UTC'")).when(k == 5, F.date_format(d, "yyyy-MM"))
        .when(k == 6, F.date_format(d, "M/d/yyyy 10:20:30")).otherwise(F.date_format(d, "d-M-yyyy"))
    )
    # Slashes with a time are month first; without a time the day comes first.
    return df.select("o_orderkey", text.alias("t")).select("o_orderkey", parse_date(F.col("t")).alias("day"))


@_add("parse_costs_locale", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL ELSE round(o_totalprice, 2) END AS cost FROM orders")
def parse_costs_locale(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 6
    plain, english = F.format_string("%.2f", F.col("o_totalprice")), F.format_string("%,.2f", F.col("o_totalprice"))
    german = F.translate(english, ",.", ".,")
    text = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("$ "), english)).when(k == 2, german).when(k == 3, F.translate(plain, ".", ",")).when(k == 4, F.concat(F.lit("  +"), plain, F.lit("e0 "))).otherwise(F.concat(F.lit("US$"), plain))
    return df.select("o_orderkey", parse_cost(text).alias("cost"))


@_add(
    "parse_stats",
    "SELECT count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) AS rows_parsed, count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) AS rows_skipped, 'EUR' AS currency FROM orders",
)
def parse_stats(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cost = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return from_dataframe(df.withColumn("c", cost).withColumn("u", F.when(F.col("o_orderkey") % 7 == 0, "USD").when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(" EUR")), "o_orderdate", "c", None, "u").stats()


@_add("rolling_median_7", with_factors("orders") + f" SELECT day, {_R4('level')} FROM leveled")
def rolling_median_7(spark, sf_dir):
    return baseline.with_level(series.daily_series(orders(spark, sf_dir).items)).select("day", "level")


@_add(
    "rolling_median_5_by_service",
    with_daily("lineitem") + with_grid("lineitem") + " SELECT service, day, round(median(cost) OVER (PARTITION BY service ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS level FROM grid",
)
def rolling_median_5_by_service(spark, sf_dir):
    grid = series.service_daily(lineitem(spark, sf_dir).items)
    return grid.select("service", "day", robust.rolling_median("cost", "day", ["service"], 5).alias("level"))


@_add("weekday_factors", with_factors("lineitem") + f" SELECT CAST(weekday AS INTEGER) AS weekday, {_R4('factor')} FROM factors")
def weekday_factors(spark, sf_dir):
    return baseline.weekday_factors(baseline.with_level(series.daily_series(lineitem(spark, sf_dir).items)))


@_add("baseline_expected", with_scored("lineitem") + f" SELECT day, {_R4('level', 'expected')} FROM scored")
def baseline_expected(spark, sf_dir):
    return baseline.with_expected(baseline.with_level(series.daily_series(lineitem(spark, sf_dir).items))).select("day", "level", "expected")


@_add("mad_global", with_daily("orders") + " SELECT round(mad(cost), 4) AS mad FROM daily")
def mad_global(spark, sf_dir):
    return robust.mad(series.daily_series(orders(spark, sf_dir).items), "cost")


@_add("mad_by_service", with_daily("orders") + with_grid("orders") + " SELECT service, round(mad(cost), 4) AS mad FROM grid GROUP BY service")
def mad_by_service(spark, sf_dir):
    return robust.mad(series.service_daily(orders(spark, sf_dir).items), "cost", ["service"])


@_add("modified_zscore", with_scored("orders") + f" SELECT day, {_R4('residual', 'zscore')} FROM scored")
def modified_zscore(spark, sf_dir):
    return baseline.scored(series.daily_series(orders(spark, sf_dir).items)).select("day", "residual", "zscore")


@_add("zscore_textbook", with_daily("orders") + " SELECT day, round((cost - avg(cost) OVER ()) / stddev_pop(cost) OVER (), 4) AS zscore, abs((cost - avg(cost) OVER ()) / stddev_pop(cost) OVER ()) >= 3.5 AS is_anomaly FROM daily")
def zscore_textbook(spark, sf_dir):
    return baseline.flat_detector(series.daily_series(orders(spark, sf_dir).items)).select("day", "zscore", "is_anomaly")


@_add("zscore_median_std", with_factors("orders") + ", r AS (SELECT day, cost - level AS residual FROM leveled) SELECT day, round(residual / stddev_pop(residual) OVER (), 4) AS zscore, abs(residual / stddev_pop(residual) OVER ()) >= 3.5 AS is_anomaly FROM r")
def zscore_median_std(spark, sf_dir):
    return baseline.median_std_detector(series.daily_series(orders(spark, sf_dir).items)).select("day", "zscore", "is_anomaly")


@_add("zscore_median_mad", with_factors("orders") + ", r AS (SELECT day, cost - level AS residual FROM leveled), s AS (SELECT median(abs(residual)) AS s FROM r) SELECT day, round(0.6745 * residual / s, 4) AS zscore, abs(0.6745 * residual / s) >= 3.5 AS is_anomaly FROM r, s")
def zscore_median_mad(spark, sf_dir):
    return baseline.median_mad_detector(series.daily_series(orders(spark, sf_dir).items)).select("day", "zscore", "is_anomaly")


for _name, _source in (("orders", orders), ("lineitem", lineitem), ("events", events), ("spiked", spiked)):
    _add(f"anomalies_{_name}", with_scored(_name) + f" SELECT day, {_R4('cost', 'expected', 'zscore', 'deviation')}, severity FROM scored WHERE is_anomaly")(
        lambda s, d, f=_source: baseline.anomalies(baseline.scored(series.daily_series(f(s, d).items))).select("day", "cost", "expected", "zscore", "deviation", "severity")
    )


@_add("anomalies_topk", with_scored("lineitem") + f" SELECT day, {_R4('cost', 'expected', 'zscore')}, severity FROM scored WHERE is_anomaly ORDER BY abs(round(scored.zscore, 2)) DESC, day LIMIT 10")
def anomalies_topk(spark, sf_dir):
    return baseline.top_anomalies(baseline.scored(series.daily_series(lineitem(spark, sf_dir).items)), 10).select("day", "cost", "expected", "zscore", "severity")


@_add("severity_counts", with_scored("orders") + " SELECT severity, CAST(CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS INTEGER) AS rank, count(*) AS n FROM scored WHERE is_anomaly GROUP BY severity")
def severity_counts(spark, sf_dir):
    found = baseline.anomalies(baseline.scored(series.daily_series(orders(spark, sf_dir).items)))
    return found.groupBy("severity").agg(F.count("*").alias("n")).select("severity", severity_rank(F.col("severity")).alias("rank"), "n")


@_add("severity_gate", with_scored("orders") + " SELECT coalesce(bool_or(severity IN ('HIGH', 'CRITICAL')), false) AS reached FROM scored WHERE is_anomaly")
def severity_gate(spark, sf_dir):
    found = baseline.anomalies(baseline.scored(series.daily_series(orders(spark, sf_dir).items)))
    return found.agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= 2), F.lit(False)).alias("reached"))


@_add("metrics", with_facts("orders") + f" SELECT days, {_R4('total', 'mean', 'std', 'stability')} FROM facts")
def metrics(spark, sf_dir):
    return baseline.metrics(baseline.scored(series.daily_series(orders(spark, sf_dir).items))).select("days", "total", "mean", "std", "stability")


@_add("waste_percentage", with_facts("orders") + f" SELECT n_anomalies, n_above, {_R4('excess', 'waste_percentage')} FROM facts")
def waste_percentage(spark, sf_dir):
    return baseline.metrics(baseline.scored(series.daily_series(orders(spark, sf_dir).items))).select("n_anomalies", "n_above", "excess", "waste_percentage")


def _facts(billing: Billing) -> DataFrame:
    return baseline.metrics(baseline.scored(series.daily_series(billing.items)))


EXCESS = "SELECT 'excess' AS rule, 1 AS emit_order, 0 AS service_rank, CAST(NULL AS VARCHAR) AS service, excess / days * 30 AS savings, 'MEDIUM' AS effort FROM facts WHERE excess > 0 AND n_above > 0 AND excess / days * 30 >= 1"
WEEKEND = """SELECT 'weekend' AS rule, 2 AS emit_order, service_rank, service, sum_off / days * 30 AS savings, 'LOW' AS effort FROM (
  SELECT service, service_rank, count(*) AS days, count(CASE WHEN isodow(day) > 5 THEN 1 END) AS n_off, count(CASE WHEN isodow(day) <= 5 THEN 1 END) AS n_on,
    median(CASE WHEN isodow(day) > 5 THEN cost END) AS m_off, median(CASE WHEN isodow(day) <= 5 THEN cost END) AS m_on, sum(CASE WHEN isodow(day) > 5 THEN cost END) AS sum_off
  FROM grid GROUP BY service, service_rank) WHERE days >= 14 AND n_off >= 4 AND n_on >= 8 AND m_on > 0 AND m_off >= 0.8 * m_on AND sum_off / days * 30 >= 1"""
COMMITMENT = "SELECT 'commitment' AS rule, 3 AS emit_order, 0 AS service_rank, CAST(NULL AS VARCHAR) AS service, p10 * 30 * 0.25 AS savings, 'MEDIUM' AS effort FROM facts WHERE days >= 14 AND p10 > 0 AND p10 * 30 * 0.25 >= 1"
CONCENTRATION = """SELECT 'concentration' AS rule, 4 AS emit_order, 0 AS service_rank, service, st / days * 30 * 0.1 AS savings, 'MEDIUM' AS effort
  FROM (SELECT service, sum(cost) AS st FROM grid GROUP BY service ORDER BY st DESC LIMIT 1), facts WHERE total > 0 AND st / total >= 0.4"""
VOLATILITY = "SELECT 'volatility' AS rule, 5 AS emit_order, 0 AS service_rank, CAST(NULL AS VARCHAR) AS service, CAST(0 AS DOUBLE) AS savings, 'LOW' AS effort FROM facts WHERE stability < 2 AND mean > 0"
_RULE = "SELECT rule, CAST(emit_order AS INTEGER) AS emit_order, CAST(service_rank AS INTEGER) AS service_rank, service, round(savings, 4) AS savings, effort FROM"
_COLUMNS = ["rule", "emit_order", "service_rank", "service", "savings", "effort"]


@_add("rec_excess", with_facts("lineitem") + f" {_RULE} ({EXCESS})")
def rec_excess(spark, sf_dir):
    return recommend.excess(_facts(lineitem(spark, sf_dir))).select(_COLUMNS)


@_add("rec_weekend", with_facts("lineitem") + with_grid("lineitem") + f" {_RULE} ({WEEKEND})")
def rec_weekend(spark, sf_dir):
    return recommend.weekend(series.service_daily(lineitem(spark, sf_dir).items)).select(_COLUMNS)


@_add("rec_commitment", with_facts("lineitem") + f" {_RULE} ({COMMITMENT})")
def rec_commitment(spark, sf_dir):
    return recommend.commitment(_facts(lineitem(spark, sf_dir))).select(_COLUMNS)


@_add("rec_concentration", with_facts("linestatus") + with_grid("linestatus") + f" {_RULE} ({CONCENTRATION})")
def rec_concentration(spark, sf_dir):
    billing = lineitem(spark, sf_dir, "l_linestatus")
    return recommend.concentration(series.service_daily(billing.items), _facts(billing)).select(_COLUMNS)


@_add("rec_volatility", with_facts("orders") + f" {_RULE} ({VOLATILITY})")
def rec_volatility(spark, sf_dir):
    return recommend.volatility(_facts(orders(spark, sf_dir))).select(_COLUMNS)


@_add("rec_volatility_urgent", with_facts("urgent") + f" {_RULE} ({VOLATILITY})")
def rec_volatility_urgent(spark, sf_dir):
    return recommend.volatility(_facts(urgent(spark, sf_dir))).select(_COLUMNS)


@_add("efficiency_rules", with_facts("urgent") + f" {_RULE} ({VOLATILITY})")
def efficiency_rules(spark, sf_dir):
    billing = urgent(spark, sf_dir)
    return recommend.recommendations(_facts(billing), series.service_daily(billing.items), "efficiency").select(_COLUMNS)


@_add("recommendations_all", with_facts("linestatus") + with_grid("linestatus") + f" {_RULE} ({' UNION ALL '.join(f'({x})' for x in (EXCESS, WEEKEND, COMMITMENT, CONCENTRATION, VOLATILITY))})")
def recommendations_all(spark, sf_dir):
    billing = lineitem(spark, sf_dir, "l_linestatus")
    return recommend.recommendations(_facts(billing), series.service_daily(billing.items)).select(_COLUMNS)


def with_forecast(source: str) -> str:
    return (
        with_factors(source)
        + """,
recent AS (SELECT day, level, row_number() OVER (ORDER BY day DESC) AS k FROM leveled QUALIFY k <= 28),
trend AS (SELECT max(day) AS last_day, max_by(level, day) AS last_level, coalesce(regr_slope(level, -k), 0) AS slope FROM recent),
ahead AS (SELECT k, last_day + CAST(k AS INTEGER) AS day, greatest(last_level + slope * k, 0) AS p FROM trend, (SELECT unnest(range(1, 31)) AS k)),
fc AS (SELECT k, CAST(ahead.day AS DATE) AS day, p * factor AS projected, sum(p * factor) OVER (ORDER BY k) AS cumulative FROM ahead JOIN factors ON factors.weekday = isodow(ahead.day) - 1)"""
    )


def _leveled(billing: Billing) -> DataFrame:
    return baseline.with_level(series.daily_series(billing.items))


@_add("level_trend", with_forecast("orders") + f" SELECT last_day, {_R4('last_level', 'slope')} FROM trend")
def level_trend(spark, sf_dir):
    return forecast.level_trend(_leveled(orders(spark, sf_dir)))


@_add("forecast_daily", with_forecast("orders") + f" SELECT CAST(k AS INTEGER) AS k, day, {_R4('projected', 'cumulative')} FROM fc")
def forecast_daily(spark, sf_dir):
    return forecast.forecast_daily(_leveled(orders(spark, sf_dir)))


@_add("forecast_summary", with_forecast("lineitem") + " SELECT CAST(30 AS INTEGER) AS horizon_days, round(sum(projected), 4) AS projected_spend, round((SELECT avg(cost) * 30 FROM daily), 4) AS run_rate_spend, round((SELECT slope FROM trend), 4) AS daily_trend FROM fc")
def forecast_summary(spark, sf_dir):
    return forecast.forecast_summary(_leveled(lineitem(spark, sf_dir))).drop("budget_breach_day")


@_add("budget_breach", with_forecast("orders") + f" SELECT CAST(min(CASE WHEN cumulative > {BUDGET} THEN k END) AS INTEGER) AS budget_breach_day FROM fc")
def budget_breach(spark, sf_dir):
    return forecast.forecast_summary(_leveled(orders(spark, sf_dir)), BUDGET).select("budget_breach_day")


@_add(
    "detector_eval",
    with_factors("events")
    + """, spiked AS (SELECT day, CASE WHEN (day - (SELECT min(day) FROM daily)) % 11 = 5 THEN cost * 6 ELSE cost END AS cost, (day - (SELECT min(day) FROM daily)) % 11 = 5 AS truth FROM daily),
z AS (SELECT truth, abs((cost - avg(cost) OVER ()) / stddev_pop(cost) OVER ()) >= 3.5 AS flag FROM spiked),
n AS (SELECT count(CASE WHEN truth AND flag THEN 1 END) AS tp, count(CASE WHEN flag AND NOT truth THEN 1 END) AS fp, count(CASE WHEN truth AND NOT flag THEN 1 END) AS fn FROM z),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN tp + fp + fn = 0 THEN 1.0 ELSE 0.0 END AS r FROM n)
SELECT tp, fp, fn, round(p, 3) AS precision, round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM pr""",
)
def detector_eval(spark, sf_dir):
    daily = series.daily_series(events(spark, sf_dir).items)
    first = daily.agg(F.min("day").alias("first"))
    marked = series.attach(daily, first, ()).withColumn("truth", F.date_diff("day", "first") % 11 == 5)
    spiked = marked.select("day", F.when(F.col("truth"), F.col("cost") * 6).otherwise(F.col("cost")).alias("cost"))
    return baseline.evaluate(baseline.flat_detector(spiked), marked.where("truth"))


@_add("detector_overlap", with_factors("orders") + ", r AS (SELECT day, cost, cost - level AS residual FROM leveled), s AS (SELECT median(abs(residual)) AS s FROM r), a AS (SELECT day FROM r, s WHERE abs(0.6745 * residual / s) >= 3.5), b AS (SELECT day FROM (SELECT day, abs((cost - avg(cost) OVER ()) / stddev_pop(cost) OVER ()) >= 3.5 AS f FROM daily) WHERE f) SELECT day, 'both' AS found_by FROM (SELECT day FROM a INTERSECT SELECT day FROM b) UNION ALL SELECT day, 'robust' FROM (SELECT day FROM a EXCEPT SELECT day FROM b) UNION ALL SELECT day, 'flat' FROM (SELECT day FROM b EXCEPT SELECT day FROM a)")
def detector_overlap(spark, sf_dir):
    daily = series.daily_series(orders(spark, sf_dir).items)
    a = baseline.median_mad_detector(daily).where("is_anomaly").select("day")
    b = baseline.flat_detector(daily).where("is_anomaly").select("day")
    named = lambda df, name: df.withColumn("found_by", F.lit(name))
    return named(a.intersect(b), "both").unionByName(named(a.subtract(b), "robust")).unionByName(named(b.subtract(a), "flat"))


@_add(
    "multi_account_anomalies",
    f"""WITH items AS ({ITEMS["orders"]}),
totals AS (SELECT status, day, round(sum(cost), 6) AS cost FROM items GROUP BY status, day),
cal AS (SELECT status, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM totals GROUP BY status),
daily AS (SELECT cal.status, cal.day, coalesce(cost, 0) AS cost FROM cal LEFT JOIN totals ON totals.day = cal.day AND totals.status = cal.status),
leveled AS (SELECT status, day, cost, median(cost) OVER (PARTITION BY status ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS level, isodow(day) - 1 AS weekday FROM daily),
found AS (SELECT status, weekday, median(CASE WHEN level > 0 THEN cost / level END) AS m, count(CASE WHEN level > 0 THEN 1 END) AS k FROM leveled GROUP BY status, weekday),
raw AS (SELECT a.status, w.weekday, CASE WHEN days >= 14 AND k >= 2 THEN m ELSE 1.0 END AS f FROM (SELECT status, count(*) AS days FROM daily GROUP BY status) a CROSS JOIN (SELECT unnest(range(0, 7)) AS weekday) w LEFT JOIN found ON found.status = a.status AND found.weekday = w.weekday),
factors AS (SELECT status, weekday, CASE WHEN avg(f) OVER (PARTITION BY status) > 0 THEN f / avg(f) OVER (PARTITION BY status) ELSE f END AS factor FROM raw),
residuals AS (SELECT leveled.status, day, cost, greatest(level * factor, 0) AS expected, cost - greatest(level * factor, 0) AS residual FROM leveled JOIN factors ON factors.status = leveled.status AND factors.weekday = leveled.weekday),
scale AS (SELECT status, median(abs(residual)) AS s, stddev_pop(residual) AS sd FROM residuals GROUP BY status),
zs AS (SELECT residuals.*, CASE WHEN s > 0 THEN 0.6745 * residual / s WHEN sd > 0 THEN residual / sd ELSE 0 END AS zscore, CASE WHEN expected > 0 THEN residual / expected * 100 ELSE 0 END AS deviation FROM residuals JOIN scale USING (status))
SELECT status AS o_orderstatus, day, {_R4("cost", "expected", "zscore", "deviation")}, {_GRADE} AS severity FROM zs WHERE abs(zscore) >= 3.5""",
)
def multi_account_anomalies(spark, sf_dir):
    keys = ("o_orderstatus",)
    billing = orders(spark, sf_dir, keys=keys)
    return baseline.anomalies(baseline.scored(series.daily_series(billing.items, keys), keys)).select(*keys, "day", "cost", "expected", "zscore", "deviation", "severity")


_SCORES = [
    ("masking", "flat_std", 3, 0, 3, 1.0, 0.5, 0.667), ("masking", "median_std", 3, 0, 3, 1.0, 0.5, 0.667), ("masking", "median_mad", 6, 1, 0, 0.857, 1.0, 0.923), ("masking", "full", 6, 1, 0, 0.857, 1.0, 0.923),
    ("seasonality", "flat_std", 1, 0, 1, 1.0, 0.5, 0.667), ("seasonality", "median_std", 1, 0, 1, 1.0, 0.5, 0.667), ("seasonality", "median_mad", 2, 23, 0, 0.08, 1.0, 0.148), ("seasonality", "full", 2, 0, 0, 1.0, 1.0, 1.0),
    ("end_to_end", "flat_std", 3, 0, 3, 1.0, 0.5, 0.667), ("end_to_end", "median_std", 3, 0, 3, 1.0, 0.5, 0.667), ("end_to_end", "median_mad", 6, 17, 0, 0.261, 1.0, 0.414), ("end_to_end", "full", 6, 0, 0, 1.0, 1.0, 1.0),
]


@_add(
    "benchmark_scores",
    "SELECT scenario, detector, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1 FROM (VALUES "
    + ", ".join(map(str, _SCORES))
    + ") t(scenario, detector, tp, fp, fn, precision, recall, f1)",
)
def benchmark_scores(spark, sf_dir):
    return benchmark.scores(spark)


@_add("csv_exports", f"SELECT day, service, round(sum(cost), 4) AS cost, count(*) AS n FROM ({ITEMS['exports']}) GROUP BY day, service")
def csv_exports(spark, sf_dir):
    return exports(spark, sf_dir).items.groupBy("day", "service").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))


@_add("csv_exports_stats", "SELECT count(CASE WHEN o_orderkey % 11 <> 0 THEN 1 END) AS rows_parsed, count(CASE WHEN o_orderkey % 11 = 0 THEN 1 END) AS rows_skipped, max(CASE WHEN o_orderkey % 3 <> 0 THEN 'EUR' END) AS currency FROM orders")
def csv_exports_stats(spark, sf_dir):
    return exports(spark, sf_dir).stats()


# Reports: what analyze() returns and what is made of it. The SQL formats the same figures.

_TOP = "ranked_a AS (SELECT *, row_number() OVER (ORDER BY abs(round(zscore, 2)) DESC, day) AS place FROM scored WHERE is_anomaly QUALIFY place <= 25)"
_WHAT = "printf('%,.2f', cost) || ' spent, ' || printf('%.1f', abs(deviation)) || '% ' || CASE WHEN cost > expected THEN 'above' ELSE 'below' END || ' the ' || printf('%,.2f', expected) || ' expected for this weekday'"
_ADVICE = (
    "advice AS (SELECT rule, service, round(savings, 2) AS savings, effort, row_number() OVER (ORDER BY round(savings, 2) DESC, emit_order, service_rank) AS place FROM ("
    + " UNION ALL ".join(f"({x})" for x in (EXCESS, WEEKEND, COMMITMENT, CONCENTRATION, VOLATILITY))
    + ")), titled AS (SELECT *, CASE rule WHEN 'excess' THEN 'Investigate spend above the modelled baseline' WHEN 'weekend' THEN 'Idle weekend spend in ' || service WHEN 'commitment' THEN 'Cover the steady part with a commitment'"
    + " WHEN 'concentration' THEN service || ' carries most of the bill' ELSE 'Daily costs swing widely' END AS title FROM advice)"
)
_SUMMARY = """said AS (SELECT days || ' days, ' || (SELECT count(*) FROM items) || ' line items, USD ' || printf('%,.2f', total) || ' in total: ' || printf('%,.2f', mean) || ' a day, stability ' || printf('%.2f', stability) || '. '
  || n_anomalies || ' anomalous day(s); ' || printf('%.1f', waste_percentage) || '% of spend above the expected; savings identified: ' || printf('%,.2f', (SELECT coalesce(sum(savings), 0) FROM advice)) || ' in 30 days.' AS summary FROM facts)"""


def with_report(source: str) -> str:
    return f"{with_facts(source)}{with_grid(source)}, {_TOP}, {_ADVICE}, {_SUMMARY}"


def _report(spark: SparkSession, sf_dir: str, source=spiked, **options) -> analyze.Analysis:
    return analyze(source(spark, sf_dir), **options)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"), 1)), "line long, text string")


@_add("report_summary", with_report("spiked") + " SELECT summary FROM said")
def report_summary(spark, sf_dir):
    return spark.createDataFrame([(_report(spark, sf_dir).summary,)], "summary string")


@_add("report_anomalies", with_report("spiked") + f" SELECT place, CAST(day AS VARCHAR) AS date, round(expected, 2) AS expectedCost, round(cost, 2) AS actualCost, round(deviation, 2) AS deviation, round(zscore, 2) AS zScore, severity, {_WHAT} AS description FROM ranked_a")
def report_anomalies(spark, sf_dir):
    found = _report(spark, sf_dir).to_dict()["anomalies"]
    names = ("date", "expectedCost", "actualCost", "deviation", "zScore", "severity", "description")
    return spark.createDataFrame([(n, *(a[k] for k in names)) for n, a in enumerate(found, 1)], "place long, date string, expectedCost double, actualCost double, deviation double, zScore double, severity string, description string")


@_add("report_recommendations", with_report("spiked") + " SELECT place, title, savings AS potentialSavings, effort FROM titled")
def report_recommendations(spark, sf_dir):
    found = _report(spark, sf_dir).recommendations
    return spark.createDataFrame([(n, r.title, r.potentialSavings, r.effort) for n, r in enumerate(found, 1)], "place long, title string, potentialSavings double, effort string")


@_add("report_forecast", with_forecast("spiked") + " SELECT CAST(30 AS INTEGER) AS horizonDays, round(sum(projected), 2) AS projectedSpend, round((SELECT avg(cost) * 30 FROM daily), 2) AS runRateSpend, round((SELECT slope FROM trend), 2) AS dailyTrend, CAST(1000.57 AS DOUBLE) AS budget, CAST(min(CASE WHEN cumulative > 1000.567 THEN k END) AS INTEGER) AS budgetBreachDay FROM fc")
def report_forecast(spark, sf_dir):
    f = _report(spark, sf_dir, analysis_type="cost-forecast", budget=1000.567).forecast
    return spark.createDataFrame([(f.horizonDays, f.projectedSpend, f.runRateSpend, f.dailyTrend, f.budget, f.budgetBreachDay)], "horizonDays int, projectedSpend double, runRateSpend double, dailyTrend double, budget double, budgetBreachDay int")


_CHAT = f"""lines AS (SELECT 1 AS a, 0 AS b, '*Cost report: A & B*' AS text UNION ALL SELECT 2, 0, summary FROM said
  UNION ALL SELECT 3, 0, 'Waste ' || printf('%.1f', waste_percentage) || '%, daily mean ' || printf('%,.2f', mean) || ', stability ' || printf('%.2f', stability) FROM facts
  UNION ALL SELECT 4, place, '- ' || CAST(day AS VARCHAR) || ' ' || severity || ': ' || {_WHAT} FROM ranked_a WHERE place <= 10
  UNION ALL SELECT 5, place, '- ' || title || ': ' || printf('%,.2f', savings) || ' in 30 days, effort ' || effort FROM titled WHERE place <= 5)"""


@_add("chat_lines", f"{with_report('lineitem')}, {_CHAT} SELECT row_number() OVER (ORDER BY a, b) AS line, text FROM lines")
def chat_lines(spark, sf_dir):
    return _lines(spark, render.as_chat(_report(spark, sf_dir, lineitem), "A & B")["text"])


_COMMENT = """lines AS (SELECT 1 AS a, 0 AS b, '<!-- costlight-report -->' AS text UNION ALL SELECT 2, 0, '## Cost report' UNION ALL SELECT 3, 0, '' UNION ALL SELECT 4, 0, summary FROM said
  UNION ALL SELECT 5, 0, '' WHERE EXISTS (FROM ranked_a) UNION ALL SELECT 6, 0, '| Date | Severity | Actual | Expected | Score |' WHERE EXISTS (FROM ranked_a) UNION ALL SELECT 7, 0, '|-|-|-|-|-|' WHERE EXISTS (FROM ranked_a)
  UNION ALL SELECT 8, place, '| ' || CAST(day AS VARCHAR) || ' | ' || severity || ' | ' || printf('%,.2f', round(cost, 2)) || ' | ' || printf('%,.2f', round(expected, 2)) || ' | ' || printf('%+.2f', round(zscore, 2)) || ' |' FROM ranked_a WHERE place <= 10
  UNION ALL SELECT 9, 0, '' WHERE EXISTS (FROM titled) UNION ALL SELECT 10, place, '- **' || title || '**: ' || printf('%,.2f', savings) || ' in 30 days' FROM titled WHERE place <= 5)"""


@_add("comment_lines", f"{with_report('lineitem')}, {_COMMENT} SELECT row_number() OVER (ORDER BY a, b) AS line, text FROM lines")
def comment_lines(spark, sf_dir):
    return _lines(spark, render.as_comment(_report(spark, sf_dir, lineitem).to_dict()))


@_add(
    "gate_and_outputs",
    with_report("lineitem")
    + """, over_ AS (SELECT count(*) AS n, arg_min(CAST(day AS VARCHAR), place) AS first FROM ranked_a WHERE severity IN ('HIGH', 'CRITICAL'))
SELECT CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS INTEGER) AS code, CASE WHEN n > 0 THEN n || ' anomalies at HIGH or over, first ' || first ELSE 'no anomaly at HIGH or over' END AS message, n > 0 AS reaches_high, (SELECT count(*) > 0 FROM ranked_a) AS reaches_low,
  (SELECT CAST(count(*) AS VARCHAR) FROM ranked_a) AS anomaly_count, (SELECT CAST(round(waste_percentage, 2) AS VARCHAR) FROM facts) AS waste FROM over_""",
)
def gate_and_outputs(spark, sf_dir):
    found = _report(spark, sf_dir, lineitem)
    code, message = notify.gate(found.to_dict(), " high")
    out = notify.outputs(found.to_dict(), "report.json")
    row = (code, message, notify.reaches(found, "high"), notify.reaches(found, "LOW"), out["anomaly-count"], out["waste-percentage"])
    return spark.createDataFrame([row], "code int, message string, reaches_high boolean, reaches_low boolean, anomaly_count string, waste string")


@_add("html_cells", f"{with_report('spiked')}, cells AS (SELECT place * 10 + c AS n, [CAST(day AS VARCHAR), severity, printf('%,.2f', round(cost, 2)), printf('%,.2f', round(expected, 2)), printf('%+.1f', round(deviation, 2)), printf('%+.2f', round(zscore, 2)), {_WHAT}][c] AS cell FROM ranked_a, (SELECT unnest(range(1, 8)) AS c)) SELECT n, '<td>' || cell || '</td>' AS cell FROM cells")
def html_cells(spark, sf_dir):
    page = render.as_html(_report(spark, sf_dir), "A & B")
    body = page.partition("<h2>Anomalies</h2>")[2].partition("<h2>Recommendations</h2>")[0].partition("<tbody>")[2]
    rows = [x.split("<td>")[1:] for x in body.split("<tr>")[1:]]
    return spark.createDataFrame([(r * 10 + c, f"<td>{x.partition('</td>')[0]}</td>") for r, row in enumerate(rows, 1) for c, x in enumerate(row, 1)], "n long, cell string")


@_add("http_response", with_facts("spiked") + " SELECT round(mean, 2) AS averageDailyCost, round(std, 2) AS stdDeviation, round(stability, 2) AS sharpeRatio, round(waste_percentage, 2) AS wastePercentage, least(n_anomalies, 25) AS anomalies, 'anomalies,metrics,recommendations,summary' AS fields FROM facts")
def http_response(spark, sf_dir):
    """A request with the daily totals of each event type (30 days of 5) as CSV text."""
    days = spiked(spark, sf_dir).items.groupBy("day", "service").agg(rounded(F.sum("cost"), 6).alias("cost")).orderBy("day", "service").collect()
    text = io.StringIO()
    csv.writer(text).writerows([("Date", "Service Name", "Cost"), *((r.day, r.service, repr(r.cost)) for r in days)])
    body = answer(spark, {"companyName": "x", "csvContent": text.getvalue()})
    m = body["metrics"]
    row = (m["averageDailyCost"], m["stdDeviation"], m["sharpeRatio"], m["wastePercentage"], len(body["anomalies"]), ",".join(sorted(body)))
    return spark.createDataFrame([row], "averageDailyCost double, stdDeviation double, sharpeRatio double, wastePercentage double, anomalies long, fields string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["anomalies_orders"](spark, sf_dir)
