"""HTTP: GET /health and POST /v1/analyze-billing."""

from __future__ import annotations

import hmac
import json
import logging
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyspark
from pyspark.sql import SparkSession

from . import __version__
from .errors import ParseError
from .operators.recommend import ANALYSIS_TYPES
from .plans import analyze, notify, render
from .sources import parse_billing_csv

MOST_BYTES = 64 << 20
log = logging.getLogger(__name__)


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def _checked(body: object, most: int) -> dict:
    if not isinstance(body, dict):
        raise Refused(422, "a JSON object is expected")
    text, company, kind, budget = body.get("csvContent"), body.get("companyName"), body.get("analysisType"), body.get("budget")
    if not isinstance(company, str) or not 1 <= len(company) <= 200:
        raise Refused(422, "companyName must have 1 to 200 characters")
    if not isinstance(text, str) or not text:
        raise Refused(422, "csvContent is missing")
    if len(text.encode()) > most:
        raise Refused(413, f"csvContent has over {most} bytes")
    if kind is not None and kind not in ANALYSIS_TYPES:
        raise Refused(422, f"analysisType must be one of {', '.join(ANALYSIS_TYPES)}")
    if budget is not None and (isinstance(budget, bool) or not isinstance(budget, (int, float))):
        raise Refused(422, "budget must be a number")
    return {"text": text, "company": company, "kind": kind or "waste-audit", "budget": budget, "webhook": body.get("webhookUrl"), "least": body.get("webhookMinSeverity") or "HIGH"}


def answer(spark: SparkSession, body: object, most: int = MOST_BYTES) -> dict:
    """The response to a request's decoded body, without null fields."""
    ask = _checked(body, most)
    try:
        result = analyze(parse_billing_csv(spark, ask["text"]), ask["kind"], budget=ask["budget"])
    except ParseError as error:
        raise Refused(422, str(error)) from error
    log.info("analysed %s: %d anomalies", ask["company"], len(result.anomalies))
    if ask["webhook"]:
        try:
            notify.post_webhook(ask["webhook"], result, company=ask["company"], min_severity=ask["least"])
        except ValueError as error:
            log.warning("webhook not sent: %s", error)
    return render.without_nulls(result.to_dict())


def health() -> dict:
    return {"status": "ok", "version": __version__, "engine": f"spark {pyspark.__version__}"}


def handler(spark: SparkSession, api_key: str | None = None, most: int = MOST_BYTES) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, format, *args):
            log.debug(format, *args)

        def do_GET(self):
            self._send(200, health()) if self.path == "/health" else self._send(404, {"detail": "not found"})

        def do_POST(self):
            try:
                if self.path != "/v1/analyze-billing":
                    raise Refused(404, "not found")
                if api_key and not hmac.compare_digest(self.headers.get("X-API-Key", "").encode(), api_key.encode()):
                    raise Refused(401, "missing or wrong API key")
                size = int(self.headers.get("Content-Length", 0))
                if size > 2 * most + 65536:
                    raise Refused(413, "the request is too large")
                try:
                    body = json.loads(self.rfile.read(size))
                except ValueError as error:
                    raise Refused(422, "the body isn't JSON") from error
                self._send(200, answer(spark, body, most))
            except Refused as no:
                self._send(no.status, {"detail": str(no)})
            except Exception:
                log.exception("analysis failed")
                self._send(500, {"detail": "the analysis failed"})

    return Handler


def serve(spark: SparkSession, port: int = 8091, host: str = "0.0.0.0") -> None:
    key, most = os.environ.get("COSTLIGHT_API_KEY"), int(os.environ.get("COSTLIGHT_MAX_BYTES", MOST_BYTES))
    ThreadingHTTPServer((host, port), handler(spark, key, most)).serve_forever()
