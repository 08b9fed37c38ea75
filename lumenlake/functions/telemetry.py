"""Column functions and parameter rules shared by the telemetry operators."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data format and of the query rules.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")
STATUSES = ("unset", "ok", "error")
GAUGE, SUM, HISTOGRAM = 1, 2, 3
DELTA, CUMULATIVE = 1, 2
MIN_STEP_S, MAX_STEPS = 10, 1500
AUTO_STEPS_S = (10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
COUNTER_AGGREGATES, GAUGE_AGGREGATES, HISTOGRAM_AGGREGATES = ("rate", "increase"), ("avg", "min", "max", "sum"), ("p95", "rate", "avg")
MAX_LIMIT, DEFAULT_LIMIT = 1000, 100


def micros(t: datetime) -> int:
    """Microseconds since the epoch; a time without a zone is UTC."""
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def at(us: int) -> Column:
    """A timestamp literal that does not depend on the session's time zone."""
    return F.timestamp_micros(F.lit(us).cast("long"))


def in_range(ts: Column, start: datetime, end: datetime) -> Column:
    """start <= ts < end."""
    return (ts >= at(micros(start))) & (ts < at(micros(end)))


def _named(code: Column, names: tuple[str, ...], default: str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when((code >= 0) & (code < len(names)), code.cast("int"))), F.lit(default))


def severity_name(number: Column) -> Column:
    """Bands of four from 1 to 24; 'unset' outside."""
    return F.when((number >= 1) & (number <= 24), F.get(F.array(*map(F.lit, LEVELS)), F.floor((number - 1) / 4).cast("int"))).otherwise("unset")


def span_kind_name(kind: Column) -> Column:
    return _named(kind, SPAN_KINDS, "unspecified")


def status_name(code: Column) -> Column:
    return _named(code, STATUSES, "unset")


def level_floor(level: str) -> int:
    """The least severity number of a level; 0 (no filter) for ''."""
    if not level:
        return 0
    if level.lower() not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    return 1 + 4 * LEVELS.index(level.lower())


def status_code(status: str) -> int | None:
    """The code of a status name; None (any) for ''."""
    if not status:
        return None
    if status.lower() not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return STATUSES.index(status.lower())


def parse_attr(text: str) -> tuple[str, str]:
    """key:value, split at the first colon."""
    key, colon, value = text.partition(":")
    if not colon or not key:
        raise ValueError(f"attribute filter {text!r} is not key:value")
    return key, value


def attributes_map(column: Column) -> Column:
    """Top-level keys, taken literally, to their values as text (JSON null: null)."""
    return F.from_json(column, "map<string,string>")


def has_attr(column: Column, key: str, value: str) -> Column:
    return F.coalesce(attributes_map(column)[key] == value, F.lit(False))


def body_contains(body: Column, text: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(body), F.lower(F.lit(text)))


def resolve_range(now: datetime, last: timedelta | None = None, start: datetime | None = None, end: datetime | None = None, default: timedelta = timedelta(hours=1)) -> tuple[datetime, datetime]:
    """last excludes start and end; a lone start ends now; a lone end starts the default earlier; neither: the default."""
    if last is not None:
        if start is not None or end is not None:
            raise ValueError("last excludes from and to")
        start, end = now - last, now
    elif start is None and end is None:
        start, end = now - default, now
    elif end is None:
        end = now
    elif start is None:
        start = end - default
    if not start < end:
        raise ValueError("the range is empty: from must be before to")
    return start, end


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def resolve_step(start: datetime, end: datetime, step_s: int | None = None) -> int:
    """Seconds of a step: explicit and checked, or the first automatic one of at least a two-hundredth of the range and a minute."""
    span = (end - start).total_seconds()
    if step_s is not None and step_s != 0:
        if step_s < MIN_STEP_S or step_s != int(step_s):
            raise ValueError(f"step must be whole seconds, {MIN_STEP_S} at least")
        if -(-span // step_s) > MAX_STEPS:
            raise ValueError(f"step gives more than {MAX_STEPS} steps")
        return int(step_s)
    want = max(span / 200, 60)
    return next((s for s in AUTO_STEPS_S if s >= want), AUTO_STEPS_S[-1])


def valid_aggregates(kind: int, monotonic: bool) -> tuple[str, ...]:
    """Aggregates of a metric kind, its default first."""
    if kind == HISTOGRAM:
        return HISTOGRAM_AGGREGATES
    return COUNTER_AGGREGATES if kind == SUM and monotonic else GAUGE_AGGREGATES


def parse_aggregate(kind: int, monotonic: bool, text: str = "") -> tuple[str, float | None]:
    """(name, quantile or None)."""
    valid = valid_aggregates(kind, monotonic)
    text = text or valid[0]
    if kind == HISTOGRAM and (m := re.fullmatch(r"p([0-9]{1,2}(?:\.[0-9])?)", text)) and float(m[1]) > 0:
        return text, float(m[1]) / 100
    if text in valid and not text.startswith("p"):
        return text, None
    raise ValueError(f"aggregate {text!r} does not apply; use one of {', '.join(valid)}")


def step_bucket(ts: Column, step_s: int) -> Column:
    """Start of the tumbling step that holds ts."""
    us = F.lit(step_s * 1_000_000).cast("long")
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / us).cast("long") * us) if step_s > 86_400 else F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), us))


def group_label(group_by: str | None) -> Column:
    """'' without grouping; a column; else the attribute of that name; null gives ''."""
    if not group_by:
        return F.lit("")
    if group_by in ("service", "environment", "version"):
        return F.coalesce(F.col(group_by), F.lit(""))
    return F.coalesce(attributes_map(F.col("attributes"))[group_by], F.lit(""))


def histogram_quantile(counts: str, bounds: str, q: float) -> Column:
    """Linear interpolation inside the first bucket whose cumulative count reaches q times the total; counts and bounds are
    names of columns. One text, parsed once: built from columns, the same expression takes a second of planning."""
    low = f"IF(s.i = 0, 0D, get({bounds}, s.i - 1))"
    high = f"get({bounds}, s.i)"
    inside = f"IF(s.i = 0 AND {high} <= 0, {high}, {low} + ({high} - {low}) * (s.total * {q!r}D - s.below) / s.n)"
    return F.expr(f"""
        IF(size({bounds}) > 0 AND size({counts}) = size({bounds}) + 1, aggregate(
            transform({counts}, (n, i) -> struct(CAST(n AS DOUBLE) AS n, i AS i)),
            struct(0D AS cum, -1 AS i, 0D AS below, 0D AS n, aggregate({counts}, 0D, (a, n) -> a + n) AS total),
            (s, x) -> CASE
                WHEN x.n > 0 AND s.i < 0 AND s.cum + x.n >= s.total * {q!r}D THEN struct(s.cum + x.n AS cum, x.i AS i, s.cum AS below, x.n AS n, s.total AS total)
                WHEN x.n > 0 THEN struct(s.cum + x.n AS cum, s.i AS i, s.below AS below, s.n AS n, s.total AS total)
                ELSE s END,
            s -> CASE WHEN s.total > 0 THEN IF(s.i < 0 OR s.i >= size({bounds}), element_at({bounds}, -1), {inside}) END
        ), NULL)""")
