"""Panels: saved metric queries evaluated under one range, and their reduction to one number."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel
from lumenlake.plans.metric_query import MetricQuery, metric_query


@dataclass(frozen=True)
class Panel:
    """A metric query that leaves project and range open. reduce: '' for a chart, 'last' or 'sum' for one number."""

    panel_id: str
    name: str
    aggregate: str = ""
    group_by: str | None = None
    service: str = ""
    environment: str = ""
    attrs: tuple[str, ...] = ()
    reduce: str = ""

    def __post_init__(self):
        if self.reduce and self.group_by:
            raise ValueError("a single number is not grouped")
        if self.reduce == "sum" and self.aggregate != "increase":
            raise ValueError("sum needs the aggregate increase")


def effective(panel: Panel, service: str = "", environment: str = "") -> Panel:
    """A shared filter fills what the panel leaves empty."""
    return replace(panel, service=panel.service or service, environment=panel.environment or environment)


def panel_query(points: DataFrame, panels: list[Panel], project: str, start: datetime, end: datetime, service: str = "", environment: str = "", step_s: int | None = None) -> DataFrame:
    """panel_id with the series of each panel's metric query."""
    parts = []
    for p in (effective(p, service, environment) for p in panels):
        q = MetricQuery(p.name, project, start, end, p.aggregate, p.group_by, step_s, p.service, p.environment, p.attrs)
        parts.append(metric_query(points, q).series.select(F.lit(p.panel_id).alias("panel_id"), "grp", "rank", "step_ts", "value"))
    return reduce(DataFrame.unionByName, parts)


def reduce_last(series: DataFrame, end: datetime, step_s: int, keys: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """The latest value of a step that has ended, else the latest value, else null."""
    ended = F.unix_micros("step_ts") + step_s * 1_000_000 <= tel.micros(end)
    has = F.col("value").isNotNull()
    last = lambda ok: F.max_by("value", F.when(ok, F.col("step_ts")))
    return series.groupBy(*keys).agg(F.coalesce(last(has & ended), last(has)).alias("value"))


def reduce_sum(series: DataFrame, keys: tuple[str, ...] = ("panel_id",)) -> DataFrame:
    """The sum of the values; null when there is none."""
    return series.groupBy(*keys).agg(F.sum("value").alias("value"))
