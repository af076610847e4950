"""Line items as a stream: an extension, beyond what the batch operators need."""

from .daily import daily_stream, start_analysis

__all__ = ["daily_stream", "start_analysis"]
