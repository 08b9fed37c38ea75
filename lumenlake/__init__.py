"""Telemetry analytics on Spark: logs, spans and metric points as DataFrames."""
