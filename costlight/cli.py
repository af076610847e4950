"""python -m costlight: analyse an export, gate a report, comment on a pull request, or run the detector benchmark."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .errors import ParseError
from .operators.recommend import ANALYSIS_TYPES
from .plans import analyze, benchmark, notify, render
from .session import get_session
from .sources import parse_billing_csv, read_billing_csv


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="costlight", description="Cost anomalies, waste and forecasts from billing exports.")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("csv", help="path of a CSV export, or - for standard input")
    a.add_argument("--type", choices=ANALYSIS_TYPES, default="waste-audit")
    a.add_argument("--json", action="store_true")
    a.add_argument("--budget", type=float)
    a.add_argument("--html", metavar="FILE")
    a.add_argument("--webhook-url")
    a.add_argument("--webhook-min-severity", type=str.upper, choices=list(notify.RANK), default="HIGH")
    a.add_argument("--company", default="")
    a.add_argument("--outputs", metavar="FILE", help="append the outputs of a CI step")
    g = sub.add_parser("gate")
    g.add_argument("report")
    g.add_argument("threshold")
    c = sub.add_parser("comment")
    c.add_argument("report")
    c.add_argument("url", help="the comments of the pull request")
    b = sub.add_parser("benchmark")
    b.add_argument("--json", action="store_true")
    b.add_argument("--check", action="store_true")
    s = sub.add_parser("serve")
    s.add_argument("--port", type=int, default=8091)
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command in ("gate", "comment"):
        with open(args.report, encoding="utf-8") as f:
            report = json.load(f)
        if args.command == "comment":
            print(notify.upsert_comment(report, args.url, notify.github_call(os.environ["GITHUB_TOKEN"])))
            return 0
        code, said = notify.gate(report, args.threshold)
        print(said)
        return code
    spark = get_session()
    if args.command == "serve":
        from .server import serve

        serve(spark, args.port)
        return 0
    if args.command == "benchmark":
        found = benchmark.run(spark)
        print(json.dumps(found, indent=2) if args.json else benchmark.as_text(found))
        return int(args.check and not benchmark.passes(found))
    try:
        billing = parse_billing_csv(spark, sys.stdin.read()) if args.csv == "-" else read_billing_csv(spark, args.csv)
        result = analyze(billing, args.type, budget=args.budget)
    except ParseError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    if args.webhook_url:
        notify.post_webhook(args.webhook_url, result, company=args.company, min_severity=args.webhook_min_severity)
    if args.html:
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(render.as_html(result, args.company))
    if args.outputs:
        with open(args.outputs, "a", encoding="utf-8") as f:
            f.writelines(f"{k}={v}\n" for k, v in notify.outputs(result.to_dict(), args.html or "").items())
    print(json.dumps(result.to_dict(), indent=2) if args.json else render.as_text(result))
    return 0
