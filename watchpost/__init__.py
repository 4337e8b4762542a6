"""Observability questions over telemetry tables and streams, asked through Spark."""
