"""Structured Streaming: ingest, windowed rates and alerts. The same functions take batch DataFrames."""
