"""Webhooks, the severity gate and the pull-request comment."""

from __future__ import annotations

import json
import logging
import urllib.error
import urllib.request
from collections.abc import Callable

from . import render
from .analyze import Analysis

RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
log = logging.getLogger(__name__)


def webhook_format(url: str) -> str:
    return "slack" if "hooks.slack.com" in url else "generic"


def reaches(result: Analysis, least: str) -> bool:
    """Whether any returned anomaly has this severity or a higher one."""
    wanted = RANK.get(least.strip().upper(), RANK["HIGH"])
    return any(RANK.get(a.severity, 0) >= wanted for a in result.anomalies)


def post_webhook(url: str, result: Analysis, *, format: str | None = None, company: str = "", min_severity: str = "HIGH", timeout: float = 10) -> bool:
    """Sends the report if it reaches min_severity; says whether it was sent. Network errors are logged, not raised."""
    if not reaches(result, min_severity):
        return False
    body = render.as_chat(result, company) if (format or webhook_format(url)) == "slack" else result.to_dict()
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            answer.read()
    except (urllib.error.URLError, OSError) as error:
        log.warning("webhook not delivered to %s: %s", url, error)
        return False
    return True


def gate(report: dict, threshold: str) -> tuple[int, str]:
    """Exit code and message: 0 passes, 1 has anomalies at the threshold or over, 2 is a bad threshold."""
    name = threshold.strip().upper()
    if name not in RANK:
        return 2, f"unknown severity {threshold!r}; one of {', '.join(RANK)}"
    over = [a for a in report.get("anomalies", []) if RANK.get(a.get("severity"), 0) >= RANK[name]]
    return (1, f"{len(over)} anomalies at {name} or over, first {over[0]['date']}") if over else (0, f"no anomaly at {name} or over")


def outputs(report: dict, path: str) -> dict[str, str]:
    """What a CI step hands on."""
    return {"anomaly-count": str(len(report.get("anomalies", []))), "waste-percentage": str(report.get("metrics", {}).get("wastePercentage", 0.0)), "report-json": path}


Call = Callable[[str, str, dict | None], object]


def github_call(token: str) -> Call:
    """HTTP calls with a token: (method, url, body) to the decoded answer."""

    def call(method: str, url: str, body: dict | None):
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(url, data, {"Authorization": f"Bearer {token}", "Accept": "application/vnd.github+json", "Content-Type": "application/json"}, method=method)
        with urllib.request.urlopen(request, timeout=10) as answer:
            return json.loads(answer.read() or b"null")

    return call


def upsert_comment(report: dict, comments_url: str, call: Call) -> str:
    """Replaces the comment that has the marker among the first hundred, or else adds one."""
    body = {"body": render.as_comment(report)}
    for comment in call("GET", f"{comments_url}?per_page=100", None) or []:
        if render.MARKER in (comment.get("body") or ""):
            call("PATCH", comment["url"], body)
            return "updated"
    call("POST", comments_url, body)
    return "created"
