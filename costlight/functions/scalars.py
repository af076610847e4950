"""Scalar functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

_ZONE = r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)"
_CLOCK = rf"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?{_ZONE}?"
_HMS = r"(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])"


def tidy(c: Column) -> Column:
    """Without white space at its ends; blank is null."""
    return F.nullif(F.regexp_replace(c.cast("string"), r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", ""), F.lit(""))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it (expressions are inlined otherwise)."""
    return F.transform(F.array(value), body)[0]


def _date_of(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is no such day."""
    return F.when(year != "0000", F.concat_ws("-", year, month, day).try_cast("date"))


_MARK = "\x01"
_THREE = r"^(\d{4}|\d\d?)([-/])(\d\d?)\2(\d{4}|\d\d?)((?!\d)[\s\S]*)$"
_BASIC = rf"^(\d{{4}})(\d\d)(\d\d)(?:.{_CLOCK})?$"
_WEEK = rf"^(\d{{4}})-?W(\d\d)(?:-?([1-7]))?(?:.{_CLOCK})?$"


def _iso_week(c: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(c, _WEEK, k), F.lit("")).cast("int")
    year, week, day = part(1), part(2), F.coalesce(part(3), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    found = F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1)
    monday = F.date_sub(found, F.weekday(found))
    return F.when((week >= 1) & (F.weekofyear(monday) == week), found)


def _three_numbers(p: Column) -> Column:
    """p: the numbers of a date with the sign between them, and what follows: a, sign, b, c, rest."""
    a, dash, b, c, rest = p[0], p[1] == "-", p[2], p[3], p[4]
    two = (F.length(b) == 2) & (F.length(c) == 2)
    first, last = (F.length(a) == 4) & (F.length(c) < 3), (F.length(a) < 3) & (F.length(c) == 4)
    time = rest.rlike(rf"^(?:T{_HMS}{_ZONE}?|\s+{_HMS}(?:\s+(?i:utc|gmt))?)$") | (two & rest.rlike(rf"^.{_CLOCK}$"))
    return (
        F.when(first & ((rest == "") | (dash & time)), _date_of(a, b, c))
        .when(last & dash & (rest == ""), _date_of(c, b, a))
        .when(last & (rest == ""), F.coalesce(_date_of(c, b, a), _date_of(c, a, b)))
        .when(last & ~dash & rest.rlike(rf"^\s+{_HMS}$"), _date_of(c, a, b))
    )


def _attempt(c: Column) -> Column:
    """ISO 8601 with the day as written, or three numbers in an accepted layout, day before month."""
    parts = F.split(F.regexp_replace(c, _THREE, _MARK.join(f"${k}" for k in range(1, 6))), _MARK)
    basic = F.when(c.rlike(_BASIC), _date_of(F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).when(c.rlike(_WEEK), _iso_week(c))
    return _let(parts, lambda p: F.when(F.size(p) == 5, _three_numbers(p)).otherwise(basic))


def parse_date(c: Column) -> Column:
    """Calendar day of a text in any accepted layout, as written (no zone is converted); null if there is none.

    A text that fails as a whole is tried again up to its first space.
    """
    text = lambda t: F.coalesce(_attempt(t), F.when(F.instr(t, " ") > 0, _let(F.substring_index(t, " ", 1), _attempt)))
    return _let(tidy(c), text)


_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"^[\s\x1c-\x1f\x85\xa0]*([+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?)[\s\x1c-\x1f\x85\xa0]*$"


def _plain_number(t: Column) -> Column:
    """Text without signs between thousands and with a point as decimal mark."""
    return F.when(t.rlike(r"\.[\s\S]*,[^.]*\z"), F.translate(t, ",.", ".")).when(t.rlike(r"\A[^.]*,[^,.]{1,2}\z"), F.translate(t, ",", ".")).otherwise(F.translate(t, ",", ""))


def parse_cost(c: Column) -> Column:
    """Amount of a text with decimal point or comma; null if it isn't a finite number.

    Dollar signs go. Of comma and point the later one is the decimal mark; a lone comma is one if one or
    two characters follow the last comma. Infinite amounts are rejected, so that no statistic turns NaN.
    """
    text = F.replace(tidy(c), F.lit("$"), F.lit(""))
    number = F.replace(F.regexp_extract(_let(text, _plain_number), _NUMBER, 1), F.lit("_"), F.lit("")).try_cast("double")
    return _let(number, lambda x: F.when(F.abs(x) < float("inf"), x))


def severity(z: Column, deviation: Column) -> Column:
    """Grade of an anomaly from its score and its deviation in per cent; either is enough."""
    z, d = F.abs(z), F.abs(deviation)
    return F.when((z >= 10) | (d >= 200), "CRITICAL").when((z >= 7) | (d >= 100), "HIGH").when((z >= 5) | (d >= 25), "MEDIUM").otherwise("LOW")


def severity_rank(c: Column) -> Column:
    """0 (LOW, or anything unknown) to 3 (CRITICAL)."""
    c = F.upper(F.trim(c))
    return F.when(c == "CRITICAL", 3).when(c == "HIGH", 2).when(c == "MEDIUM", 1).otherwise(0)


def rounded(c: Column, digits: int) -> Column:
    """The number with so many decimals, by the rule of SQL engines: scaled as a double, halves away from zero.

    F.round() and Python's round() look at the decimal and at the binary value of the unscaled number,
    so they differ from it, and from each other, on half cents.
    """
    scale = 10.0**digits
    return F.when(F.abs(c * scale) < float("inf"), F.round(c * scale) / scale).otherwise(c)


def rounded_number(x: float, digits: int) -> float:
    """rounded() of a plain number."""
    scale = 10.0**digits
    y = abs(x * scale)
    if not y < math.inf:
        return x
    return math.copysign((math.floor(y) + (y % 1 >= 0.5)) / scale, x)


def center_of(values: Column) -> Column:
    """Median of an array of numbers; two middle values are averaged."""
    ordered = F.array_sort(values)
    n = F.size(values)
    at = lambda k: F.element_at(ordered, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def _as_sql(c: Column) -> str:
    """The expression as SQL text, so that SQL and columns have one grammar; operators are called by their names."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", c._jc.toString())
    call = lambda x: re.sub(r"(?<![\w`])(and|or|[=<>!+*/-]{1,2})\(", r"`\1`(", x).replace("Infinity", "double('Infinity')")
    return "".join(x if k % 2 else call(x) for k, x in enumerate(parts))


def register_sql_functions(spark: SparkSession) -> None:
    """SQL functions: parse_date(text), parse_cost(text), cost_severity(z, deviation), severity_rank(name) and the table function horizon_days(day, n)."""
    for name, kind, body in (("parse_date", "DATE", parse_date), ("parse_cost", "DOUBLE", parse_cost)):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {_as_sql(body(F.col('t')))}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cost_severity(z DOUBLE, deviation DOUBLE) RETURNS STRING RETURN "
        "CASE WHEN abs(z) >= 10 OR abs(deviation) >= 200 THEN 'CRITICAL' WHEN abs(z) >= 7 OR abs(deviation) >= 100 THEN 'HIGH' "
        "WHEN abs(z) >= 5 OR abs(deviation) >= 25 THEN 'MEDIUM' ELSE 'LOW' END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION severity_rank(name STRING) RETURNS INT RETURN "
        "CASE upper(trim(name)) WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION horizon_days(day DATE, n INT) RETURNS TABLE (k INT, day DATE) RETURN "
        "SELECT k, date_add(horizon_days.day, k) FROM (SELECT explode(sequence(1, horizon_days.n)) AS k)"
    )
