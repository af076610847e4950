"""Goldens of the cost operators: generated series with answers known by construction."""

import json
import threading
import urllib.error
import urllib.request
from datetime import date, datetime, timedelta
from http.server import ThreadingHTTPServer

import duckdb
import pytest
from pyspark.sql import functions as F

from costlight import queries
from costlight.errors import ParseError
from costlight.functions import parse_cost, parse_date, rounded, rounded_number
from costlight.plans import analyze, benchmark, notify, render
from costlight.sources import from_dataframe, parse_billing_csv, read_billing_csv


def csv_of(rows):
    return "date,service,cost,currency\n" + "".join(f"{d},{s},{c:.4f},USD\n" for d, s, c in rows)


def stable(n=60, spike=None):
    first = date(2026, 1, 1)
    return [(first + timedelta(days=i), "compute", 500 if i == spike else 101 if i % 3 == 0 else 99) for i in range(n)]


def test_spiked_series_has_one_anomaly(spark):
    r = analyze(parse_billing_csv(spark, csv_of(stable(spike=30))), budget=100)
    (a,) = r.anomalies
    assert (a.date, a.expectedCost, a.actualCost, a.deviation, a.zScore, a.severity) == ("2026-01-31", 99.0, 500.0, 405.05, 7.82, "CRITICAL")
    assert (r.metrics.averageDailyCost, r.metrics.stdDeviation, r.metrics.sharpeRatio, r.metrics.wastePercentage) == (106.32, 51.69, 2.06, 6.29)
    assert 200.5 in [x.potentialSavings for x in r.recommendations]
    assert (r.forecast.projectedSpend, r.forecast.runRateSpend, r.forecast.budgetBreachDay) == (2970.0, 3189.5, 2)
    assert "Projected 30-day spend" in r.summary and "budget is crossed on day" in r.summary


def test_trend_zero_and_short_series(spark):
    first = date(2026, 1, 1)
    r = analyze(parse_billing_csv(spark, csv_of([(first + timedelta(days=i), "x", 100 + 5 * i) for i in range(40)])), "cost-forecast", budget=6000)
    assert [round(a.zScore, 2) for a in r.anomalies] == [-3.59, 3.59]
    assert (r.forecast.projectedSpend, r.forecast.dailyTrend, r.forecast.budgetBreachDay) == (10901.01, 4.89, 18)
    r = analyze(parse_billing_csv(spark, csv_of([(first + timedelta(days=i), "x", 0) for i in range(20)])), budget=0)
    assert r.anomalies == [] and r.metrics.averageDailyCost == 0 and "not projected to be crossed" in r.summary
    r = analyze(parse_billing_csv(spark, csv_of([(first + timedelta(days=i), "x", 10) for i in range(2)])), budget=5)
    assert "At least 3 days" in r.summary and r.forecast is None


def test_idle_weekends(spark):
    first = date(2026, 1, 5)
    rows = [(first + timedelta(days=i), s, c) for i in range(56) for s, c in (("staging", 50), ("prod", 20 if i % 7 >= 5 else 100))]
    r = analyze(parse_billing_csv(spark, csv_of(rows)))
    idle = [x for x in r.recommendations if "weekend" in x.title]
    assert [x.title for x in idle] == ["Idle weekend spend in staging"] and idle[0].potentialSavings == 428.57
    assert 525.0 in [x.potentialSavings for x in r.recommendations]


def test_provider_layouts_and_errors(spark, tmp_path):
    text = 'identity/LineItemId,lineItem/UsageStartDate,product/ProductName,lineItem/UnblendedCost,lineItem/CurrencyCode\n1,2026-01-01T00:00:00Z,"A, ""B""\nC",10,USD\n2,2026-01-01,S3,"5",USD\n\n3,2026-01-03,S3\n'
    path = tmp_path / "x.csv"
    path.write_text(text)
    for b in (parse_billing_csv(spark, text), read_billing_csv(spark, str(path))):
        s = b.stats().first()
        assert (s.rows_parsed, s.rows_skipped, s.currency) == (2, 1, "USD")
        assert {r.service for r in b.items.collect()} == {'A, "B"\nC', "S3"}
    b = parse_billing_csv(spark, "date,costCenter,cost,cost\n2026-01-01,7,1,2\n")
    assert [r.cost for r in b.items.collect()] == [2.0]
    for bad in ("", "a,b\n1,2\n", "date,cost\nx,y\n"):
        with pytest.raises(ParseError):
            parse_billing_csv(spark, bad)


PROVIDERS = {
    "gcp": ("billing_account_id,service.description,usage_start_time,cost,currency\na,Compute,2026-02-01 00:00:00 UTC,3.5,BRL\na,Compute,2026-02-02 00:00:00 UTC,4,BRL\na,,2026-02-04 00:00:00 UTC,5,BRL\n", {"Compute": 7.5, "unattributed": 5.0}, "BRL"),
    "azure": ("UsageDateTime,MeterCategory,costCenter,CostInBillingCurrency,BillingCurrency\n2026-02-01,VM,9,\"1,5\",EUR\n2026-02-02,VM,9,2,EUR\n", {"VM": 3.5}, "EUR"),
    "focus": ("ChargePeriodStart,ChargePeriodEnd,ServiceName,ServiceCategory,BilledCost,EffectiveCost,BillingCurrency\n2026-02-01T00:00:00Z,2026-02-02T00:00:00Z,Virtual Machines,Compute,40,1,USD\n", {"Virtual Machines": 40.0}, "USD"),
}


@pytest.mark.parametrize("name", PROVIDERS)
def test_more_providers(spark, name):
    text, want, currency = PROVIDERS[name]
    b = parse_billing_csv(spark, text)
    assert {r.service: r.c for r in b.items.groupBy("service").agg(F.sum("cost").alias("c")).collect()} == want
    assert b.stats().first().currency == currency


def test_files_are_bound_by_their_own_headers(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("\ufeffdate,service,cost\n2026-01-01,a,1\n2026-01-02,a,2\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv.gz").write_bytes(gzip.compress(b"cost,currency,date,service\n4,EUR,2026-01-02,b\n"))
    (tmp_path / "_hidden.csv").write_text("x\n")
    for multiline in (None, True, False):
        b = read_billing_csv(spark, str(tmp_path), multiline)
        assert sorted((str(r.day), r.service, r.cost) for r in b.items.collect()) == [("2026-01-01", "a", 1.0), ("2026-01-02", "a", 2.0), ("2026-01-02", "b", 4.0)]
        assert b.stats().first().currency == "EUR"
    (tmp_path / "c.csv").write_text("date,cost\n")
    with pytest.raises(ParseError):
        read_billing_csv(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ParseError, match="empty"):
        read_billing_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ParseError) as error:
        parse_billing_csv(spark, ",".join(f"h{i}" for i in range(30)) + "\n1\n")
    assert "h19" in str(error.value) and "h20" not in str(error.value)


def test_command_line(spark, tmp_path, capsys):
    from costlight.cli import main

    path, page, said = tmp_path / "x.csv", tmp_path / "x.html", tmp_path / "out"
    path.write_text(csv_of(stable(spike=30)))
    assert main(["analyze", str(path), "--json", "--budget", "100", "--html", str(page), "--outputs", str(said)]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["anomalies"][0]["severity"] == "CRITICAL" and report["forecast"]["budget"] == 100
    assert "<h1>Cost report" in page.read_text() and said.read_text().splitlines()[0] == "anomaly-count=1"
    (tmp_path / "r.json").write_text(json.dumps(report))
    assert [main(["gate", str(tmp_path / "r.json"), t]) for t in ("high", "nope")] == [1, 2]
    capsys.readouterr()
    assert main(["analyze", str(path), "--type", "efficiency"]) == 0
    text = capsys.readouterr().out
    assert "Anomalies" in text and "CRITICAL" in text and "Recommendations" not in text
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    assert main(["analyze", str(tmp_path / "bad.csv")]) == 2 and "error:" in capsys.readouterr().err
    for bad in (["analyze", "x", "--type", "other"], ["analyze", "x", "--webhook-min-severity", "WORST"]):
        with pytest.raises(SystemExit):
            main(bad)


def test_sql_functions(spark):
    from costlight.functions import register_sql_functions

    register_sql_functions(spark)
    r = spark.sql("SELECT cost_severity(11, 0) a, severity_rank(' high ') b, (SELECT max(day) FROM horizon_days(DATE'2026-01-01', 3)) c, parse_cost('1.234,56') d, parse_date('03/04/2026') e, parse_cost('x') f").first()
    assert (r.a, r.b, str(r.c), r.d, str(r.e), r.f) == ("CRITICAL", 2, "2026-01-04", 1234.56, "2026-04-03", None)


def test_grammar(spark):
    dates = {
        "03/04/2026": "2026-04-03", "01/13/2026": "2026-01-13", "03/04/2026 00:00:00": "2026-03-04", "13/04/2026 00:00:00": "2026-04-13", "03/04/2026 00:00:00 UTC": "2026-04-03",
        "2026-02-01 junk": "2026-02-01", "2026-01-01 99:99": "2026-01-01", "2026-01-01T99:99": None, "2026-01-01T23:30:00-05:00": "2026-01-01", "2026-1-5": "2026-01-05",
        "05-01-2026": "2026-01-05", "20260105": "2026-01-05", "2026-W02-1": "2026-01-05", "2026-W02": "2026-01-05", "2026": None, "2026-01": None, "1/2/26": None, "Jan 5 2026": None, "": None, None: None, "2026-02-30": None,
    }
    rows = spark.createDataFrame([(k,) for k in dates], "t string").select("t", parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == dates
    costs = {
        "1.234,56": 1234.56, "1,234.56": 1234.56, "1,234": 1234.0, "12,5": 12.5, "1,234,56": None, "1,234,567": 1234567.0, "1.234": 1.234, "1,": 1.0, ",5": 0.5, "-5": -5.0, "-$5.00": -5.0,
        "(5.00)": None, "€5": None, "1 000": None, "nan": None, "$ 1,000.50": 1000.5, "1e3": 1000.0, "R$ 10,00": None, "12d": None, "1_000": 1000.0, "inf": None, "1e400": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in costs], "t string").select("t", parse_cost(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == costs


def test_detection_quality(spark):
    found = benchmark.run(spark)
    assert benchmark.passes(found)
    assert {k: v["f1"] for k, v in found.items() if k.endswith("full")} == {"end_to_end/full": 1.0, "masking/full": 0.923, "seasonality/full": 1.0}


def report(severity="CRITICAL"):
    from costlight.plans.analyze import Analysis, Anomaly, Metrics, Recommendation

    return Analysis([Anomaly("2026-01-31", 99.0, 500.0, 405.05, 7.82, severity, "<b>high</b>")], Metrics(110, 50, 2.2, 6.3), [Recommendation("Investigate", "why", 200.5, "MEDIUM")], "all")


def test_renderings_gate_and_webhooks(monkeypatch):
    page = render.as_html(report(), "A & B")
    assert "&lt;b&gt;high" in page and "A &amp; B" in page and "<b>" not in page
    assert render.as_chat(report())["text"].count("\n") == 4
    assert notify.webhook_format("https://hooks.slack.com/x") == "slack" and notify.webhook_format("https://x") == "generic"
    assert [notify.gate(report().to_dict(), t)[0] for t in ("high", "nope")] == [1, 2] and notify.gate(report("LOW").to_dict(), "MEDIUM")[0] == 0
    assert notify.post_webhook("http://x", report("LOW")) is False

    def refuse(*a, **k):
        raise urllib.error.URLError("down")

    monkeypatch.setattr(urllib.request, "urlopen", refuse)
    assert notify.post_webhook("http://x", report()) is False
    calls = []
    assert notify.upsert_comment(report().to_dict(), "u", lambda m, u, b: calls.append((m, u)) or [{"body": render.MARKER, "url": "c/1"}]) == "updated"
    assert calls[-1] == ("PATCH", "c/1")


def test_server(spark):
    from costlight.server import handler

    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(spark, "k", 10_000))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def post(body, key="k"):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/v1/analyze-billing", json.dumps(body).encode(), {"X-API-Key": key})) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    status, body = post({"companyName": "x", "csvContent": csv_of(stable(20))})
    assert status == 200 and "forecast" not in body and set(body) == {"anomalies", "metrics", "recommendations", "summary"}
    assert [post({"companyName": "x", "csvContent": "a,b\n"})[0], post({"companyName": "x", "csvContent": "a"}, "no")[0], post({"companyName": "", "csvContent": "a"})[0], post({"companyName": "x", "csvContent": "a" * 20_000})[0]] == [422, 401, 422, 413]
    with urllib.request.urlopen(f"{url}/health") as r:
        assert json.loads(r.read())["status"] == "ok"
    server.shutdown()


def test_many_accounts_equal_one_by_one(spark):
    from costlight.operators import baseline, series

    rows = [(k, d, c * m) for k, m, spike in (("a", 1.0, 30), ("b", 3.0, 12)) for d, _, c in stable(40, spike)]
    df = spark.createDataFrame(rows, "account string, day date, cost double")
    both = from_dataframe(df, "day", "cost", keys=("account",))
    got = {(r.account, r.day, round(r.zscore, 6)) for r in baseline.anomalies(baseline.scored(series.daily_series(both.items, ["account"]), ["account"])).collect()}
    want = set()
    for k in "ab":
        one = from_dataframe(df.where(f"account = '{k}'"), "day", "cost")
        want |= {(k, r.day, round(r.zscore, 6)) for r in baseline.anomalies(baseline.scored(series.daily_series(one.items))).collect()}
    assert got == want and len(got) == 2


def test_half_cents_are_rounded_as_in_sql(spark, tmp_path):
    values = [1.005, 1.115, 2.675, 0.285, -1.115, 3642178.545, 1214059.515, 0.0, 1e300, 1e307, *(k * 0.0075 for k in range(1, 400)), *(485623.806 * k * 7.5 for k in range(1, 400))]
    want = [x for (x,) in duckdb.execute("SELECT round(x, 2) FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(len(?))) AS k) ORDER BY k", [values, values]).fetchall()]
    assert [rounded_number(x, 2) for x in values] == want
    got = spark.createDataFrame(list(enumerate(values)), "k int, x double").select("k", rounded(F.col("x"), 2).alias("x")).collect()
    assert [r.x for r in sorted(got)] == want


@pytest.mark.parametrize("name", ["report_summary", "report_recommendations"])
def test_reports_of_half_cents_are_those_of_the_sql(spark, tmp_path, name):
    first = datetime(2024, 1, 1)
    rows = [(i, first + timedelta(days=i), "view" if i % 3 else "error", 485623.806) for i in range(31) if i != 14]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(queries.ORACLES[name]).fetchall())


def test_stream_of_items(spark, tmp_path):


    from costlight.streaming import daily_stream, start_analysis

    rows = [(f"{d}T10:00:00", float(c)) for d, _, c in stable(40, 30)]
    spark.createDataFrame(rows, "ts string, cost double").select(F.col("ts").cast("timestamp"), "cost").write.parquet(str(tmp_path / "in"))
    seen = []
    items = spark.readStream.schema("ts timestamp, cost double").parquet(str(tmp_path / "in"))
    q = start_analysis(daily_stream(items), str(tmp_path / "h"), lambda df, n: seen.append([str(r.day) for r in df.where("is_anomaly").collect()]), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == ["2026-01-31"]
