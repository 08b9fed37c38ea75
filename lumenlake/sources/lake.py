"""The hour-partitioned Parquet lake: scans, writes, file statistics and retention.

Layout: root/<signal>/date=YYYY-MM-DD/hour=HH/batch=<attempt>/*.parquet, sorted by ts within files. All writers append
batches of files and then commit them to the table of manifest.py; scans read what that table shows, whoever wrote it, and
list no folders but those of their range. A lake that has no such table is read as it lies there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import telemetry as tel
from lumenlake.schema import SIGNALS
from lumenlake.sources import manifest

HOT_WINDOW = timedelta(hours=2)
#: Columns that are looked up by equality over many hours: their files carry Bloom filters, sized by what a file holds.
BLOOM = {"logs": ("trace_id",), "spans": ("trace_id",), "metric_points": ("series_hash",)}


def _path(root: str, signal: str) -> str:
    return f"{root}/{signal}"


def _partitioned(schema: T.StructType) -> T.StructType:
    nullable = [T.StructField(f.name, f.dataType, True) for f in schema]
    return T.StructType([*nullable, T.StructField("date", T.DateType()), T.StructField("hour", T.IntegerType()), T.StructField("batch", T.StringType())])


def _read(spark: SparkSession, root: str, signal: str, folders: list[str]) -> DataFrame:
    """Rows of the folders with the signal's columns, date and hour. Folders with and without a batch are read apart."""
    schema, parts = _partitioned(SIGNALS[signal]), []
    for inside in (True, False):
        own = [f for f in folders if ("/batch=" in f) == inside]
        if own:
            kind = schema if inside else T.StructType(schema.fields[:-1])
            parts.append(spark.read.schema(kind).option("basePath", _path(root, signal)).parquet(*own).drop("batch"))
    if not parts:
        return spark.createDataFrame([], schema).drop("batch")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _plain(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """All rows of a lake without a table of files, in date=/hour= folders."""
    return spark.read.schema(T.StructType(_partitioned(SIGNALS[signal]).fields[:-1])).parquet(_path(root, signal))


def committed(spark: SparkSession, root: str, signal: str, start: datetime, end: datetime | None = None, without: tuple[str, int] | None = None) -> DataFrame:
    """Rows, with date and hour, of the committed files that may hold start <= ts < end; without: a (writer, batch) left out.
    The folders of the range come to the driver, as they do to plan any scan."""
    seen = manifest.files(spark, root, signal).where(F.col("max_ts").isNull() | (F.col("max_ts") >= tel.at(tel.micros(start))))
    if end is not None:
        seen = seen.where(F.col("min_ts").isNull() | (F.col("min_ts") < tel.at(tel.micros(end))))
    if without is not None:
        seen = seen.where((F.col("writer") != without[0]) | (F.col("batch") != without[1]))
    return read_paths(spark, root, signal, seen)


def read_paths(spark: SparkSession, root: str, signal: str, files: DataFrame) -> DataFrame:
    """Rows of the committed files(path), with date and hour. A batch's folder holds just its own files, all of them committed."""
    folder = F.when(F.col("path").contains("/batch="), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).otherwise(F.col("path"))
    return _read(spark, root, signal, [r[0] for r in files.select(folder).distinct().collect()])


def is_committed(spark: SparkSession, root: str, signal: str) -> bool:
    return manifest.exists(spark, manifest.folder(root, signal))


def scan_signal(spark: SparkSession, root: str, signal: str, start: datetime, end: datetime) -> DataFrame:
    """Every committed row of the signal with start <= ts < end, with just the signal's columns. Files are chosen by their own
    times, ts prunes row groups, and equality on the columns of BLOOM prunes them by Bloom filter."""
    rows = committed(spark, root, signal, start, end) if is_committed(spark, root, signal) else _plain(spark, root, signal)
    first, last = start.replace(tzinfo=None), (end - timedelta(microseconds=1)).replace(tzinfo=None)
    hours = F.col("date").between(F.lit(first.date()), F.lit(last.date()))
    if first.date() == last.date():
        hours = hours & F.col("hour").between(first.hour, last.hour)
    else:
        hours = hours & ((F.col("date") > F.lit(first.date())) | (F.col("hour") >= first.hour)) & ((F.col("date") < F.lit(last.date())) | (F.col("hour") <= last.hour))
    return rows.where(hours).where(tel.in_range(F.col("ts"), start, end)).select(*SIGNALS[signal].names)


def scan_mixed_schema(spark: SparkSession, *paths: str) -> DataFrame:
    """Old and new files together, by column name; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def with_hour(df: DataFrame) -> DataFrame:
    """Add the partition columns of the event time, in UTC whatever the session's zone."""
    us = F.unix_micros("ts")
    return df.withColumns({"date": F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")), "hour": F.floor(F.pmod(us, F.lit(86_400_000_000)) / 3_600_000_000).cast("int")})


def by_hour(rows: DataFrame) -> DataFrame:
    """rows(date, hour, ts, ...) dealt out by hour and sorted by ts. Adaptive execution splits an hour that is larger than
    its advisory partition size over several tasks (and so files), and puts small hours together."""
    folders = [c for c in ("date", "hour", "batch") if c in rows.columns]  # the order of a partitioned write, so that it sorts no more
    return rows.hint("rebalance", F.col("date"), F.col("hour")).sortWithinPartitions(*folders, "ts")


#: Settings of a write by hour. Timestamps are 64-bit microseconds: the default 96-bit form has no statistics, so neither row
#: groups nor files could be pruned. An hour is a file however few its rows, so the time of a write is that of its files: small
#: hours are put together only as far as every core has a task.
_WRITE = {
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
}


@contextmanager
def _settings_of_writes(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _WRITE}
    for k, v in _WRITE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def observed(what: Observation) -> dict:
    """An observation's metrics; none where the plan was known to be empty, and so without the node that observes."""
    try:
        return what.get
    except Py4JJavaError as e:
        if "assertion failed" not in str(e.java_exception):
            raise
        return {}


def write_batch(rows: DataFrame, root: str, signal: str, attempt: str) -> tuple[list[int], int]:
    """Write the rows to their hours' folders of the attempt; their hours (microseconds) and number. Nothing is visible yet."""
    out = with_hour(rows.select(*SIGNALS[signal].names)).withColumn("batch", F.lit(attempt))
    written = Observation(f"written-{uuid.uuid4().hex}")
    hour = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(3_600_000_000))
    out = out.observe(written, F.count(F.lit(1)).alias("rows"), F.collect_set(hour).alias("hours"))
    to = by_hour(out).write.partitionBy("date", "hour", "batch").option("compression", "zstd").mode("append")
    for column in BLOOM[signal]:
        to = to.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{column}", "true")
    with _settings_of_writes(rows.sparkSession):
        to.parquet(_path(root, signal))
    got = observed(written)
    return list(got.get("hours") or ()), got.get("rows") or 0


def write_hours(df: DataFrame, root: str, signal: str, writer: str | None = None, batch: int = 0) -> None:
    """Append rows to their hours, sorted by ts; late rows become further files of their hour. A call that names its writer and
    batch replaces what an earlier call of those names has written. Columns that df lacks are null."""
    spark = df.sparkSession
    writer = writer or f"hours-{uuid.uuid4().hex}"
    attempt = manifest.new_attempt(writer, batch)
    whole = df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SIGNALS[signal]))
    hours, rows = write_batch(whole, root, signal, attempt)
    manifest.commit(spark, root, signal, writer, batch, attempt, hours, {"accepted": rows})


def closed_hours(df: DataFrame, now: datetime) -> DataFrame:
    """Event hours whose end lies an hour or more back: hour + 2 h <= now."""
    hour = F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(3_600_000_000)))
    return df.select(hour.alias("hour")).distinct().where(F.col("hour") <= tel.at(tel.micros(now - HOT_WINDOW)))


def file_stats(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """Per file: rows, least and greatest ts, greatest ingest stamp, bytes, and the hour it belongs to. Committed files were
    described when they were committed; of a lake without a table the footers are read. No data column is read in either case."""
    seen = manifest.files(spark, root, signal) if is_committed(spark, root, signal) else manifest.describe(spark, manifest.listing(spark, _path(root, signal)))
    return seen.select(F.lit(signal).alias("signal"), "hour", "path", "bytes", "rows", "min_ts", "max_ts", "max_ingest_ts")


def files_for_range(stats: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Files whose own times overlap [start, end), by min_ts and path."""
    return stats.where((F.col("min_ts") < tel.at(tel.micros(end))) & (F.col("max_ts") >= tel.at(tel.micros(start)))).orderBy("min_ts", "path")


def storage_report(stats: DataFrame) -> DataFrame:
    """Per signal and hour: files, bytes, rows and the greatest ingest stamp."""
    return stats.groupBy("signal", "hour").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.max("max_ingest_ts").alias("max_ingest_ts"))


def storage_totals(report: DataFrame) -> DataFrame:
    """Per signal: hours, files, bytes, the oldest hour and its bytes, and the greatest ingest stamp."""
    return report.groupBy("signal").agg(
        F.countDistinct("hour").alias("hours"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.min("hour").alias("oldest_hour"),
        F.min_by("bytes", "hour").alias("oldest_bytes"), F.max("max_ingest_ts").alias("max_ingest_ts"),
    )


def retention_by_age(report: DataFrame, days: dict[str, int], now: datetime) -> DataFrame:
    """Rows of the report whose hour ended `days` ago or earlier; signals without an entry stay."""
    due = F.lit(False)
    for signal, n in days.items():
        due = due | ((F.col("signal") == signal) & (F.col("hour") <= tel.at(tel.micros(now - timedelta(days=n, hours=1)))))
    return report.where(due)


def retention_by_size(report: DataFrame, max_bytes: int) -> DataFrame:
    """Rows of the report to drop so that the rest fits: oldest hours first, across signals.

    An hour goes when it and all newer ones together exceed the cap. The window runs over one row per hour.
    """
    hours = report.groupBy("hour").agg(F.sum("bytes").alias("_b"))
    newer = F.sum("_b").over(Window.orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dropped = hours.withColumn("_sum", newer).where(F.col("_sum") > max_bytes).select("hour")
    return report.join(dropped, "hour", "left_semi").select(report.columns)


def retention_report(by_age: DataFrame, by_size: DataFrame) -> DataFrame:
    """Hours, files and bytes that go: by age an hour counts once for each signal, by size once."""
    def phase(df: DataFrame, name: str, hours) -> DataFrame:
        return df.agg(hours.alias("hours"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).withColumn("phase", F.lit(name))

    return phase(by_age, "age", F.count("*")).unionByName(phase(by_size, "size", F.countDistinct("hour")))


def drop_hours(spark: SparkSession, root: str, doomed: DataFrame) -> int:
    """Delete the hours of the report's rows, hidden first and then removed; returns how many were there. One row per signal
    and hour comes to the driver."""
    rows = doomed.select("signal", "hour", F.unix_micros("hour").alias("us")).distinct().persist()
    try:
        paths = []
        for row in rows.toLocalIterator():
            h = datetime(1970, 1, 1) + timedelta(microseconds=row["us"])
            paths.append(f"{_path(root, row['signal'])}/date={h:%Y-%m-%d}/hour={h.hour}")
        for signal in SIGNALS:
            if is_committed(spark, root, signal):
                manifest.drop(spark, root, signal, rows.where(F.col("signal") == signal))
        return manifest.delete(spark, paths)
    finally:
        rows.unpersist()


def all_stats(spark: SparkSession, root: str) -> DataFrame:
    """file_stats of all signals that the lake holds."""
    there = [s for s in SIGNALS if manifest.exists(spark, _path(root, s))]
    out = spark.createDataFrame([], "signal string, hour timestamp, path string, bytes long, rows long, min_ts timestamp, max_ts timestamp, max_ingest_ts timestamp")
    for s in there:
        out = out.unionByName(file_stats(spark, root, s))
    return out


def apply_retention(spark: SparkSession, root: str, days: dict[str, int], max_bytes: int | None, now: datetime) -> DataFrame:
    """Drop what is too old, then the oldest hours until the rest fits by its files' sizes; the report of both phases."""
    report = storage_report(all_stats(spark, root)).persist()
    try:
        by_age = retention_by_age(report, days, now)
        left = report.join(by_age.select("signal", "hour"), ["signal", "hour"], "left_anti").select(report.columns)
        by_size = retention_by_size(left, max_bytes) if max_bytes is not None else left.limit(0)
        told = spark.createDataFrame(retention_report(by_age, by_size).collect(), "hours long, files long, bytes long, phase string")  # two rows
        drop_hours(spark, root, by_age.unionByName(by_size))
        return told
    finally:
        report.unpersist()
