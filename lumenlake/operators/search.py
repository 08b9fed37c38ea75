"""Search of logs and spans: predicates, pages, the live tail, and services."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel


MAX_ARRIVALS = 500


@dataclass(frozen=True)
class Search:
    """Filters of a search over [start, end); empty values do not filter."""

    project: str
    start: datetime
    end: datetime
    service: str = ""
    environment: str = ""
    level: str = ""
    body: str = ""
    trace_id: str = ""
    attrs: tuple[str, ...] = ()
    status: str = ""
    name: str = ""
    min_duration_ns: int = 0
    root: bool = False
    limit: int = tel.DEFAULT_LIMIT


def common_predicates(p: Search) -> list[Column]:
    if not p.project:
        raise ValueError("a project is required")
    out = [tel.in_range(F.col("ts"), p.start, p.end), F.col("project") == p.project]
    out += [F.col(c) == v for c, v in (("service", p.service), ("environment", p.environment)) if v]
    if p.trace_id:
        out.append(F.col("trace_id") == p.trace_id.lower())
    return out + [tel.has_attr(F.col("attributes"), *tel.parse_attr(a)) for a in p.attrs]


def log_predicates(p: Search) -> list[Column]:
    out = common_predicates(p)
    if floor := tel.level_floor(p.level):
        out.append(F.col("severity_number") >= floor)
    if p.body:
        out.append(tel.body_contains(F.col("body"), p.body))
    return out


def span_predicates(p: Search) -> list[Column]:
    out = common_predicates(p)
    if p.name:
        out.append(F.col("name") == p.name)
    if (code := tel.status_code(p.status)) is not None:
        out.append(F.col("status_code") == code)
    if p.min_duration_ns > 0:
        out.append(F.col("duration_ns") >= p.min_duration_ns)
    if p.root:
        out.append(F.col("parent_span_id").isNull())
    return out


def _where(df: DataFrame, predicates: list[Column]) -> DataFrame:
    for p in predicates:
        df = df.where(p)
    return df


def topk_page(rows: DataFrame, limit: int = tel.DEFAULT_LIMIT, key: tuple[str, ...] = ("ts", "ingest_ts")) -> DataFrame:
    """The newest `limit` + 1 rows: the last one only tells that there are more."""
    return rows.orderBy(*(F.desc(c) for c in key)).limit(tel.check_limit(limit) + 1)


def encode_cursor(p: Search, ts_us: int, ingest_us: int) -> str:
    """A position and the first page's range."""
    return base64.urlsafe_b64encode(json.dumps([ts_us, ingest_us, tel.micros(p.start), tel.micros(p.end)]).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, int, int, int]:
    try:
        ts, ingest, start, end = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return int(ts), int(ingest), int(start), int(end)
    except Exception as e:
        raise ValueError("bad cursor") from e


def keyset_page(rows: DataFrame, ts_us: int, ingest_us: int, limit: int = tel.DEFAULT_LIMIT) -> DataFrame:
    """The page after a position, without reading what came before it again."""
    t, i = tel.at(ts_us), tel.at(ingest_us)
    return topk_page(rows.where((F.col("ts") <= t) & ((F.col("ts") < t) | (F.col("ingest_ts") < i))), limit)


def _page(df: DataFrame, p: Search, predicates, cursor: str | None) -> DataFrame:
    if cursor is None:
        return topk_page(_where(df, predicates(p)), p.limit)
    ts, ingest, start, end = decode_cursor(cursor)
    utc = lambda us: datetime(1970, 1, 1) + _delta(us)
    return keyset_page(_where(df, predicates(replace(p, start=utc(start), end=utc(end)))), ts, ingest, p.limit)


def _delta(us: int):
    from datetime import timedelta

    return timedelta(microseconds=us)


def logs_search(logs: DataFrame, p: Search, cursor: str | None = None) -> DataFrame:
    """A page of logs, newest first (limit + 1 rows, see page())."""
    return _page(logs, p, log_predicates, cursor)


def spans_search(spans: DataFrame, p: Search, cursor: str | None = None) -> DataFrame:
    """A page of spans, newest first (limit + 1 rows, see page())."""
    return _page(spans, p, span_predicates, cursor)


def page(rows: DataFrame, p: Search) -> tuple[list, bool, str | None]:
    """(rows, truncated, next cursor) of a search's at most limit + 1 rows."""
    got = rows.withColumns({"_t": F.unix_micros("ts"), "_i": F.unix_micros("ingest_ts")}).collect()  # at most MAX_LIMIT + 1 rows
    more = len(got) > p.limit
    got = got[: p.limit]
    return got, more, encode_cursor(p, got[-1]["_t"], got[-1]["_i"]) if more else None


def logs_tail(logs: DataFrame, p: Search, watermark_us: int, previous_end: datetime) -> DataFrame:
    """What an earlier page could not show: rows stamped after its watermark, or at or after its end."""
    fresh = (F.col("ingest_ts") > tel.at(watermark_us)) | (F.col("ts") >= tel.at(tel.micros(previous_end)))
    return topk_page(_where(logs, log_predicates(p)).where(fresh), p.limit)


def tail_watermark(signal: DataFrame, previous_us: int = 0) -> DataFrame:
    """One row: the stamp up to which every row is visible, never less than the previous one. Read it before the page."""
    return signal.agg(F.greatest(F.lit(previous_us).cast("long"), F.coalesce(F.unix_micros(F.max("ingest_ts")), F.lit(0))).alias("watermark_us"))


def live_reset(arrivals: DataFrame, truncated: bool, most: int = MAX_ARRIVALS) -> bool:
    """Whether a live list starts over from its base page: a poll was truncated, or more than `most` rows have arrived."""
    return truncated or arrivals.limit(most + 1).count() > most


def live_merge(base: DataFrame, arrivals: DataFrame, window_start: datetime) -> DataFrame:
    """Arrivals and a base page, each (ts, ingest_ts) once (an arrival wins), from the window's start on, newest first."""
    both = arrivals.withColumn("_rank", F.lit(0)).unionByName(base.withColumn("_rank", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("ts", "ingest_ts").orderBy("_rank"))
    kept = both.where(F.col("ts") >= tel.at(tel.micros(window_start))).withColumn("_n", first).where("_n = 1").drop("_rank", "_n")
    return kept.orderBy(F.desc("ts"), F.desc("ingest_ts"))


def services(logs: DataFrame, spans: DataFrame, points: DataFrame, project: str, start: datetime, end: datetime) -> DataFrame:
    """Rows of each signal by service, most first, then by name."""
    kinds = (("logs", logs), ("spans", spans), ("metric_points", points))
    parts = []
    for name, df in kinds:
        counts = df.where(tel.in_range(F.col("ts"), start, end) & (F.col("project") == project)).groupBy("service").agg(F.count("*").alias("n"))
        parts.append(counts.select("service", *((F.col("n") if k == name else F.lit(0).cast("long")).alias(k) for k, _ in kinds)))
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("service").agg(*(F.sum(k).alias(k) for k, _ in kinds))
    return total.orderBy(F.desc(F.col("logs") + F.col("spans") + F.col("metric_points")), "service")


def count_by_severity(logs: DataFrame, project: str, start: datetime, end: datetime) -> DataFrame:
    return logs.where(tel.in_range(F.col("ts"), start, end) & (F.col("project") == project)).groupBy("service", "severity_number").agg(F.count("*").alias("n"))


def named_codes(spans: DataFrame) -> DataFrame:
    """spans plus kind_name and status_name."""
    return spans.withColumns({"kind_name": tel.span_kind_name(F.col("kind")), "status_name": tel.status_name(F.col("status_code"))})
