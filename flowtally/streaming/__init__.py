"""Structured Streaming operators."""

from flowtally.streaming.daily_counts import current_table, daily_counts_stream, run_daily_counts

__all__ = ["current_table", "daily_counts_stream", "run_daily_counts"]
