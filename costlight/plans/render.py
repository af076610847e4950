"""Text, HTML, chat and pull-request renderings of an analysis."""

from __future__ import annotations

import html

from .analyze import Analysis

MARKER = "<!-- costlight-report -->"
FEW_ANOMALIES, FEW_ADVICE = 10, 5


def without_nulls(value):
    """The value without null fields, at all depths."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    return [without_nulls(v) for v in value] if isinstance(value, list) else value


def as_text(result: Analysis) -> str:
    lines = [result.summary]
    if result.anomalies:
        lines += ["", "Anomalies"] + [f"  {a.date}  {a.severity:<8}  z {a.zScore:+.2f}  {a.description}" for a in result.anomalies]
    if result.recommendations:
        lines += ["", "Recommendations"] + [f"  {r.title} ({r.potentialSavings:,.2f} in 30 days, effort {r.effort})\n    {r.description}" for r in result.recommendations]
    return "\n".join(lines)


def _table(head: list[str], rows: list[list[str]]) -> str:
    e = html.escape
    body = "".join("<tr>" + "".join(f"<td>{e(str(c))}</td>" for c in row) + "</tr>" for row in rows)
    return f"<table><thead><tr>{''.join(f'<th>{e(h)}</th>' for h in head)}</tr></thead><tbody>{body}</tbody></table>"


def as_html(result: Analysis, company: str = "") -> str:
    """A page of its own: no scripts, nothing loaded."""
    m, e = result.metrics, html.escape
    title = f"Cost report{f' for {company}' if company else ''}"
    found = _table(["Date", "Severity", "Actual", "Expected", "Deviation %", "Score", "What"], [[a.date, a.severity, f"{a.actualCost:,.2f}", f"{a.expectedCost:,.2f}", f"{a.deviation:+.1f}", f"{a.zScore:+.2f}", a.description] for a in result.anomalies]) if result.anomalies else "<p>No anomalies.</p>"
    advice = _table(["Recommendation", "Why", "Savings in 30 days", "Effort"], [[r.title, r.description, f"{r.potentialSavings:,.2f}", r.effort] for r in result.recommendations]) if result.recommendations else "<p>No recommendations.</p>"
    facts = _table(["Daily mean", "Deviation", "Stability", "Waste %"], [[f"{m.averageDailyCost:,.2f}", f"{m.stdDeviation:,.2f}", f"{m.sharpeRatio:.2f}", f"{m.wastePercentage:.2f}"]])
    style = "body{font:15px sans-serif;margin:2em auto;max-width:60em}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ccc;padding:.3em .6em;text-align:left}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title><style>{style}</style></head><body><h1>{e(title)}</h1><p>{e(result.summary)}</p>{facts}<h2>Anomalies</h2>{found}<h2>Recommendations</h2>{advice}</body></html>'


def as_chat(result: Analysis, company: str = "") -> dict:
    m = result.metrics
    lines = [f"*Cost report{f': {company}' if company else ''}*", result.summary, f"Waste {m.wastePercentage:.1f}%, daily mean {m.averageDailyCost:,.2f}, stability {m.sharpeRatio:.2f}"]
    lines += [f"- {a.date} {a.severity}: {a.description}" for a in result.anomalies[:FEW_ANOMALIES]]
    lines += [f"- {r.title}: {r.potentialSavings:,.2f} in 30 days, effort {r.effort}" for r in result.recommendations[:FEW_ADVICE]]
    return {"text": "\n".join(lines)}


def as_comment(report: dict) -> str:
    """Markdown for a pull request, from a report's dict; the marker lets a later run find and replace it."""
    lines = [MARKER, "## Cost report", "", report.get("summary", "")]
    if found := report.get("anomalies"):
        lines += ["", "| Date | Severity | Actual | Expected | Score |", "|-|-|-|-|-|"] + [f"| {a['date']} | {a['severity']} | {a['actualCost']:,.2f} | {a['expectedCost']:,.2f} | {a['zScore']:+.2f} |" for a in found[:FEW_ANOMALIES]]
    if advice := report.get("recommendations"):
        lines += [""] + [f"- **{r['title']}**: {r['potentialSavings']:,.2f} in 30 days" for r in advice[:FEW_ADVICE]]
    return "\n".join(lines)
