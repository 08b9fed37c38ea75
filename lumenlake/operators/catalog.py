"""What metrics and attributes there are."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel

MAX_METRICS, MAX_KEYS, MAX_VALUES = 1000, 100, 20


def metric_catalog(points: DataFrame, project: str, start: datetime, end: datetime, contains: str = "", limit: int = MAX_METRICS) -> DataFrame:
    """Each (name, type, monotonic, unit): services, series, points, last time; limit + 1 rows, the last one telling that there are more."""
    rows = points.where(tel.in_range(F.col("ts"), start, end) & (F.col("project") == project))
    if contains:
        rows = rows.where(tel.body_contains(F.col("name"), contains))
    # one row per series and service first, so that the distinct counts combine on the map side
    series = rows.groupBy("name", "type", "monotonic", "unit", "service", "series_hash").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    kinds = series.groupBy("name", "type", "monotonic", "unit").agg(
        F.array_sort(F.collect_set("service")).alias("services"), F.countDistinct("series_hash").alias("series"), F.sum("n").alias("points"), F.max("last").alias("last_ts")
    )
    return kinds.orderBy("name", "type", "monotonic", "unit").limit(limit + 1)


def metric_attributes(points: DataFrame, project: str, name: str, start: datetime, end: datetime, keys: int = MAX_KEYS, values: int = MAX_VALUES) -> DataFrame:
    """Each attribute key of a metric: its number of different values and the first of them in order; keys in order, keys + 1 rows at most."""
    rows = points.where(tel.in_range(F.col("ts"), start, end) & (F.col("project") == project) & (F.col("name") == name))
    pairs = rows.select(F.explode(tel.attributes_map(F.col("attributes"))).alias("key", "value")).distinct()
    counts = pairs.groupBy("key").agg(F.count("value").alias("distinct_values"))
    # the rank's limit is applied before the shuffle too, so a key of very many values stays small
    first = pairs.where(F.col("value").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("value"))).where(F.col("_n") <= values)
    listed = first.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("first_values"))
    return counts.join(listed, "key", "left").withColumn("first_values", F.coalesce("first_values", F.array().cast("array<string>"))).orderBy("key").limit(keys + 1)


def metric_kinds(points: DataFrame) -> DataFrame:
    """The (type, monotonic, unit) of the points."""
    return points.select("type", "monotonic", "unit").distinct().orderBy("type", "monotonic", "unit")


def metric_kind(points: DataFrame, name: str) -> tuple[int, bool, str | None]:
    """The one kind of the points of a name; an error when there is none or more than one."""
    kinds = metric_kinds(points).limit(20).collect()
    if not kinds:
        raise LookupError(f"metric {name!r} not found in this range")
    if len(kinds) > 1:
        raise ValueError(f"metric {name!r} has several kinds: " + "; ".join(f"type {k['type']}, monotonic {k['monotonic']}, unit {k['unit'] or '-'}" for k in kinds))
    return kinds[0]["type"], bool(kinds[0]["monotonic"]), kinds[0]["unit"]


def attr_entries(rows: DataFrame, keys: list[str], column: str = "attributes") -> DataFrame:
    """The key columns with one row per attribute: its key and value as text, in key order."""
    return rows.select(*keys, F.explode(F.array_sort(F.map_entries(tel.attributes_map(F.col(column))))).alias("e")).select(*keys, "e.key", "e.value")
