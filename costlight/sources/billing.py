"""Billing exports to line items.

The header alone decides which columns hold day, cost, service and currency, so binding happens on
the driver and costs no pass over the data; all values are read as strings and parsed by Column functions.
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError
from ..functions import parse_cost, parse_date, tidy

UNKNOWN_SERVICE = "unattributed"
DEFAULT_CURRENCY = "USD"

# Column names of the providers' exports, in order of preference, and parts of names that hint at a role.
DATE_NAMES = (
    "lineitem/usagestartdate", "lineitem/usagestarttime", "bill/billingperiodstartdate", "chargeperiodstart", "billingperiodstart",
    "usage_start_time", "usage_date", "usagedatetime", "date", "billingdate", "usagestart",
)
DATE_HINTS = ("date", "day", "time", "period")
COST_NAMES = (
    "lineitem/unblendedcost", "lineitem/blendedcost", "lineitem/netunblendedcost", "billedcost", "cost",
    "costinbillingcurrency", "pretaxcost", "amortizedcost", "effectivecost", "amount",
)
COST_HINTS = ("cost", "amount", "charge", "spend")
COST_NOT = ("center", "code", "currency", "type", "category")
SERVICE_NAMES = (
    "product/productname", "lineitem/productcode", "service.description", "service_description", "service",
    "servicename", "servicecategory", "metercategory", "product", "resourcegroup",
)
SERVICE_HINTS = ("service", "product", "category", "resource")
CURRENCY_NAMES = ("currency", "billingcurrency", "lineitem/currencycode")
CURRENCY_HINTS = ("currency",)


def _plain(name: str) -> str:
    return name.strip().lower().replace(" ", "").replace("_", "")


@dataclass(frozen=True)
class Roles:
    """Positions of the columns in the header."""

    day: int
    cost: int
    service: int | None
    currency: int | None


def _find(header: list[str], names: tuple[str, ...], hints: tuple[str, ...], but: tuple[str, ...] = (), taken: int | None = None) -> int | None:
    at = {name: i for i, name in enumerate(header)}  # of equal names the last counts
    for name in map(_plain, names):
        if name in at and at[name] != taken:
            return at[name]
    for name in header:
        if at[name] != taken and any(h in name for h in hints) and not any(x in name for x in but):
            return at[name]
    return None


def resolve_roles(header: list[str]) -> Roles:
    """Known names first, then hints in header order. The cost column is never taken as currency."""
    if not any(h and h.strip() for h in header):
        raise ParseError("the input has no header row")
    plain = [_plain(h or "") for h in header]
    day = _find(plain, DATE_NAMES, DATE_HINTS)
    cost = _find(plain, COST_NAMES, COST_HINTS, COST_NOT)
    if day is None or cost is None:
        missing = " and ".join(x for x, i in (("date", day), ("cost", cost)) if i is None)
        raise ParseError(f"no {missing} column among: {', '.join(header[:20])}")
    return Roles(day, cost, _find(plain, SERVICE_NAMES, SERVICE_HINTS), _find(plain, CURRENCY_NAMES, CURRENCY_HINTS, taken=cost))


@dataclass
class Billing:
    """items: day, cost, service, currency, seq (and keys) of accepted rows. raw: all rows, with day and cost null where they don't parse."""

    raw: DataFrame
    keys: tuple[str, ...] = ()

    @property
    def items(self) -> DataFrame:
        return self.raw.where(F.col("day").isNotNull() & F.col("cost").isNotNull())

    def stats(self) -> DataFrame:
        """rows_parsed, rows_skipped, currency (the first that isn't blank, in order of rows) by keys."""
        good = F.col("day").isNotNull() & F.col("cost").isNotNull()
        named = good & F.col("currency").isNotNull()
        return self.raw.groupBy(*self.keys).agg(
            F.count_if(good).alias("rows_parsed"),
            F.count_if(~good).alias("rows_skipped"),
            F.min_by("currency", F.when(named, F.col("seq"))).alias("currency"),
        )

    def by_day(self) -> DataFrame:
        """One pass over the rows: good (parsed or not), service, day, cost, seq (the first), n (rows) and named (the first currency with its seq)."""
        good = F.col("day").isNotNull() & F.col("cost").isNotNull()
        named = F.when(F.col("currency").isNotNull(), F.struct("seq", "currency"))
        rows = self.raw.select(*self.keys, good.alias("good"), F.when(good, F.col("service")).alias("service"), F.when(good, F.col("day")).alias("day"), "cost", "seq", named.alias("named"))
        return rows.groupBy(*self.keys, "good", "service", "day").agg(F.sum("cost").alias("cost"), F.min("seq").alias("seq"), F.count("*").alias("n"), F.min("named").alias("named"))

    def check(self) -> Billing:
        """Raises ParseError if no row was accepted."""
        if self.items.limit(1).count() == 0:
            raise ParseError("no row has both a date and a cost that can be read")
        return self


def _bind(df: DataFrame, day: Column, cost: Column, service: Column | None, currency: Column | None, keys: tuple[str, ...]) -> DataFrame:
    return df.select(
        *(F.col(k) for k in keys),
        day.alias("day"),
        cost.alias("cost"),
        F.coalesce(tidy(service), F.lit(UNKNOWN_SERVICE)).alias("service") if service is not None else F.lit(UNKNOWN_SERVICE).alias("service"),
        (tidy(currency) if currency is not None else F.lit(None).cast("string")).alias("currency"),
        F.monotonically_increasing_id().alias("seq"),
    )


def from_dataframe(df: DataFrame, day: str | Column, cost: str | Column, service: str | Column | None = None, currency: str | Column | None = None, keys: tuple[str, ...] = ()) -> Billing:
    """Any table as line items. String columns are parsed like CSV values, others cast."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kind = lambda c: df.select(c).schema[0].dataType
    d, c = col(day), col(cost)
    d = parse_date(d) if isinstance(kind(d), T.StringType) else d.cast("date")
    c = parse_cost(c) if isinstance(kind(c), T.StringType) else F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
    return Billing(_bind(df, d, c, None if service is None else col(service), None if currency is None else col(currency), keys), keys)


def _files(spark: SparkSession, path: str) -> list:
    """The files of a path, pattern or folder, without hidden ones, in the order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, out = list(fs.globStatus(top) or []), []
    while todo:
        found = todo.pop()
        if found.isDirectory():
            todo += [x for x in fs.listStatus(found.getPath()) if x.getPath().getName()[0] not in "._"]
        else:
            out.append(found.getPath())
    return sorted(out, key=lambda x: x.toString())


def _first_line(spark: SparkSession, file) -> str | None:
    """Read through the file system and codec that Spark itself uses."""
    conf = spark._jsc.hadoopConfiguration()
    raw = file.getFileSystem(conf).open(file)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        stream = raw if codec is None else codec.createInputStream(raw)
        return spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        raw.close()


def _quotes_hold_line_ends(spark: SparkSession, files: list[str]) -> bool:
    """Whether any line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.text(files).where(quotes % 2 == 1).limit(1).count() > 0


def read_billing_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> Billing:
    """CSV exports at a path, pattern or folder that Spark reads; each file's columns are bound by its own header.

    Files are read in splits, unless quotes hold line ends (multiline): a pass over the lines tells, if it isn't said.
    """
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _files(spark, path):
        line = (_first_line(spark, file) or "").lstrip("\ufeff")
        if line.strip():
            by_header.setdefault(tuple(next(csv.reader([line]))), []).append(file.toString())
    if not by_header:
        raise ParseError("the input is empty")
    if multiline is None:
        multiline = _quotes_hold_line_ends(spark, [x for files in by_header.values() for x in files])
    reader = spark.read.option("multiLine", multiline).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    rows = None
    for header, files in by_header.items():
        roles = resolve_roles(list(header))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        at = lambda i: F.lit(None).cast("string") if i is None else F.col(f"c{i}")
        part = reader.schema(schema).csv(files, header=True, enforceSchema=True)
        part = part.select(at(roles.day).alias("d"), at(roles.cost).alias("c"), at(roles.service).alias("s"), at(roles.currency).alias("u"))
        rows = part if rows is None else rows.union(part)
    return Billing(_bind(rows, parse_date(F.col("d")), parse_cost(F.col("c")), F.col("s"), F.col("u"), ())).check()


def parse_billing_csv(spark: SparkSession, text: str) -> Billing:
    """A CSV export given as text (of a request or standard input), decoded on the driver and bounded by its sender."""
    text = text.lstrip("﻿")
    if not text.strip():
        raise ParseError("the input is empty")
    rows = csv.reader(io.StringIO(text, newline=""))
    header = next((r for r in rows if r), None)
    if header is None:
        raise ParseError("the input has no header row")
    roles = resolve_roles(header)
    pick = [roles.day, roles.cost, roles.service, roles.currency]
    data = [tuple(r[i] if i is not None and i < len(r) else None for i in pick) for r in rows if r]
    df = spark.createDataFrame(data, "d string, c string, s string, u string")
    return Billing(_bind(df, parse_date(F.col("d")), parse_cost(F.col("c")), F.col("s"), F.col("u"), ())).check()
