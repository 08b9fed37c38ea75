"""The whole metric query: kind, aggregate, groups, values, steps and rank."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel
from lumenlake.operators import catalog, metrics


@dataclass(frozen=True)
class MetricQuery:
    name: str
    project: str
    start: datetime
    end: datetime
    aggregate: str = ""
    group_by: str | None = None
    step_s: int | None = None
    service: str = ""
    environment: str = ""
    attrs: tuple[str, ...] = ()
    limit: int = metrics.MAX_SERIES


@dataclass(frozen=True)
class MetricResult:
    """series: grp, rank, step_ts, value, incompatible_series in rank and time order. truncated: one row that says whether groups were left out."""

    series: DataFrame
    truncated: DataFrame
    kind: tuple[int, bool, str | None]
    aggregate: str
    step_s: int
    start: datetime


def filtered(points: DataFrame, q: MetricQuery) -> DataFrame:
    if not q.name:
        raise ValueError("a metric name is required")
    rows = points.where((F.col("name") == q.name) & (F.col("project") == q.project))
    for c, v in (("service", q.service), ("environment", q.environment)):
        rows = rows.where(F.col(c) == v) if v else rows
    for a in q.attrs:
        rows = rows.where(tel.has_attr(F.col("attributes"), *tel.parse_attr(a)))
    return rows


def metric_query(points: DataFrame, q: MetricQuery, kind: tuple[int, bool, str | None] | None = None) -> MetricResult:
    """kind: as found by an earlier lookup; else one bounded lookup runs here."""
    step = tel.resolve_step(q.start, q.end, q.step_s)
    start = metrics.aligned_start(q.start, step)
    rows = filtered(points, q)
    kind = kind or catalog.metric_kind(rows.where(tel.in_range(F.col("ts"), start, q.end)), q.name)
    kind_type, monotonic, unit = kind
    aggregate, quantile = tel.parse_aggregate(kind_type, monotonic, q.aggregate)
    rows = rows.where((F.col("type") == kind_type) & (F.coalesce("monotonic", F.lit(False)) == monotonic) & F.col("unit").eqNullSafe(F.lit(unit)))
    inside = metrics.grouped(rows.where(tel.in_range(F.col("ts"), start, q.end)), q.group_by, step)
    if kind_type == tel.GAUGE or kind_type == tel.SUM and not monotonic:
        values = metrics.gauge(inside, aggregate)
    else:
        deltas = metrics.grouped(metrics.series_deltas(rows, start, q.end), q.group_by, step)
        if quantile is not None:
            values = metrics.histogram_quantiles(deltas, quantile)
        elif kind_type == tel.HISTOGRAM:
            values = metrics.histogram_rate(deltas, step) if aggregate == "rate" else metrics.histogram_avg(deltas)
        else:
            values = metrics.counter_rate(deltas, step) if aggregate == "rate" else metrics.counter_increase(deltas)
    ranked = metrics.ranked_steps(metrics.seed_groups(inside), values, q.limit)
    series = metrics.unfolded(ranked.where(F.col("rank") <= q.limit), start, q.end, step).select("grp", "rank", "step_ts", "value", "incompatible_series").orderBy("rank", "step_ts")
    return MetricResult(series, ranked.agg((F.count("*") > q.limit).alias("truncated")), kind, aggregate, step, start)
