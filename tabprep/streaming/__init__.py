"""Fitted plans on streams."""

from tabprep.streaming.apply import apply_stream, stream_table

__all__ = ["apply_stream", "stream_table"]
