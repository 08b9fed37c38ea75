"""Rows of the fixtures as small DataFrames."""

from __future__ import annotations

from datetime import datetime, timedelta

from lumenlake import schema

H0 = datetime(2026, 10, 1)
H1, H2 = H0 + timedelta(hours=1), H0 + timedelta(hours=2)


def minute(i: float) -> datetime:
    return H1 + timedelta(minutes=i)


def frame(spark, kind, rows: list[dict], **defaults):
    """Rows with only the fields given; the stamp rises with the row."""
    full = []
    for i, row in enumerate(rows):
        own = {"ingest_ts": H0 + timedelta(days=1, microseconds=i), "project": "p1", "service": "api"} | defaults | row
        full.append(tuple(own.get(f.name) for f in kind))
    return spark.createDataFrame(full, kind)


def logs(spark, rows, **defaults):
    return frame(spark, schema.LOGS, rows, **defaults)


def spans(spark, rows, **defaults):
    rows = [{"end_ts": r["ts"] + timedelta(microseconds=r.get("duration_ns", 0) // 1000), "duration_ns": 0, "name": "n"} | r for r in rows]
    return frame(spark, schema.SPANS, rows, **defaults)


def points(spark, rows, **defaults):
    return frame(spark, schema.POINTS, rows, **({"name": "m", "type": 2, "temporality": 2, "monotonic": True, "series_hash": 1} | defaults))
