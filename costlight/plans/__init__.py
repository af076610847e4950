"""From line items to a report: analysis, renderings, and what is sent where."""

from .analyze import Analysis, analyze

__all__ = ["Analysis", "analyze"]
