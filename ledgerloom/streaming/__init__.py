"""Structured Streaming: growing log files in, incremental usage events out."""
