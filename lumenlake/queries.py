"""Queries over the driver's tables, one or more for each telemetry operator, with DuckDB SQL for the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import telemetry as tel
from lumenlake.operators import catalog, metrics, search, traces
from lumenlake.plans import panels
from lumenlake.plans.metric_query import MetricQuery, metric_query
from lumenlake.sources import adapters as ad
from lumenlake.sources import lake, manifest, otlp
from lumenlake.streaming import ingest, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
A, B = datetime(2024, 1, 5), datetime(2024, 1, 20)
RANGE = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'"
P1 = f"{RANGE} AND project = 'p1'"
_lakes: dict[tuple[str, str], str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, doubles to six places, arrays as text: what both engines hash alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif isinstance(f.dataType, (T.ShortType, T.IntegerType, T.DecimalType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _plain(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- search -----------------------------------------------------------------------------------

_LOG = "ts, ingest_ts, service, severity_number, body, trace_id"
_LOG_COLUMNS = [c.strip() for c in _LOG.split(",")]
_SPAN = "ts, ingest_ts, service, trace_id, span_id, name, status_code, duration_ns"
_SPAN_COLUMNS = [c.strip() for c in _SPAN.split(",")]
_BASE = search.Search("p1", A, B)


def _logs_query(key: str, where: str, **filters) -> None:
    sql = f"WITH {ad.LOGS_SQL} SELECT {_LOG} FROM logs WHERE {P1} AND {where} ORDER BY ts DESC, ingest_ts DESC LIMIT {filters.get('limit', 100) + 1}"
    query(key, sql)(lambda spark, sf: search.logs_search(ad.logs(spark, sf), replace(_BASE, **filters)).select(*_LOG_COLUMNS))


def _spans_query(key: str, where: str, **filters) -> None:
    sql = f"WITH {ad.SPANS_SQL} SELECT {_SPAN} FROM spans WHERE {P1} AND {where} ORDER BY ts DESC, ingest_ts DESC LIMIT {filters.get('limit', 100) + 1}"
    query(key, sql)(lambda spark, sf: search.spans_search(ad.spans(spark, sf), replace(_BASE, **filters)).select(*_SPAN_COLUMNS))


_logs_query("logs_search", "service = 'svc-1' AND severity_number >= 17", service="svc-1", level="error")
_logs_query("p_project", "true", limit=1000)
_logs_query("p_service", "service = 'svc-2'", service="svc-2", limit=1000)
_logs_query("p_environment", "environment = 'prod'", environment="prod", limit=1000)
_logs_query("p_level", "severity_number >= 13", level="WARN", limit=1000)
_logs_query("p_body", "contains(lower(body), 'click by user 1')", body="Click BY user 1", limit=1000)
_logs_query("p_trace_id", "trace_id = md5('t400')", trace_id="81365B1EC3255324DEB3D4AA9942E9D0", limit=50)
_logs_query("p_attr", "json_extract_string(attributes, '$.k') = '7'", attrs=("k:7",), limit=1000)
_logs_query("topk_page", "true", limit=25)
_logs_query("error_logs_page", "service = 'svc-3' AND severity_number >= 17 AND json_extract_string(attributes, '$.k') = '77'", service="svc-3", level="error", attrs=("k:77",))
_spans_query("spans_search", "status_code = 2 AND service = 'svc-1'", status="error", service="svc-1")
_spans_query("p_status", "status_code = 1", status="ok", limit=1000)
_spans_query("p_min_duration", "duration_ns >= 100000000", min_duration_ns=100_000_000, limit=1000)
_spans_query("p_span_name", "name = 'signup'", name="signup", limit=1000)
_spans_query("p_root", "parent_span_id IS NULL", root=True, limit=1000)


@query("keyset_page", f"WITH {ad.LOGS_SQL}, o AS (SELECT {_LOG}, row_number() OVER (ORDER BY ts DESC, ingest_ts DESC) AS n FROM logs WHERE {P1}) SELECT {_LOG} FROM o WHERE n BETWEEN 41 AND 81")
def _keyset_page(spark, sf):
    logs = ad.logs(spark, sf)
    p, cursor = replace(_BASE, limit=40), None
    _, _, cursor = search.page(search.logs_search(logs, p), p)
    return search.logs_search(logs, p, cursor).select(*_LOG_COLUMNS) if cursor else logs.limit(0).select(*_LOG_COLUMNS)


@query("logs_tail", f"WITH {ad.LOGS_SQL} SELECT {_LOG} FROM logs WHERE {P1} AND (ingest_ts > TIMESTAMP '2024-02-01 00:00:00.004000' OR ts >= TIMESTAMP '2024-01-18') ORDER BY ts DESC, ingest_ts DESC LIMIT 101")
def _logs_tail(spark, sf):
    return search.logs_tail(ad.logs(spark, sf), _BASE, tel.micros(datetime(2024, 2, 1)) + 4000, datetime(2024, 1, 18)).select(*_LOG_COLUMNS)


@query("tail_watermark", f"WITH {ad.LOGS_SQL} SELECT greatest(5, epoch_us(max(ingest_ts))) AS watermark_us FROM logs")
def _tail_watermark(spark, sf):
    return search.tail_watermark(ad.logs(spark, sf), 5)


@query("live_merge", f"WITH {ad.LOGS_SQL} SELECT {_LOG} FROM logs WHERE {P1} AND ts >= TIMESTAMP '2024-01-08'")
def _live_merge(spark, sf):
    rows = ad.logs(spark, sf).where(tel.in_range(F.col("ts"), A, B) & (F.col("project") == "p1"))
    us = F.unix_micros("ingest_ts")
    return search.live_merge(rows.where(us % 3 != 0), rows.where(us % 2 == 0).unionByName(rows.where(us % 3 == 0)), datetime(2024, 1, 8)).select(*_LOG_COLUMNS)


@query("services", f"""WITH {ad.LOGS_SQL}, l AS (SELECT service, count(*) AS n FROM logs WHERE {P1} GROUP BY 1)
SELECT service, n AS logs, n AS spans, 3 * n AS metric_points FROM l""")
def _services(spark, sf):
    return search.services(ad.logs(spark, sf), ad.spans(spark, sf), ad.all_points(spark, sf), "p1", A, B)


@query("code_names", f"""WITH {ad.SPANS_SQL}, l AS (SELECT CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 0 END AS severity_number FROM e)
SELECT CASE kind WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer' ELSE 'unspecified' END AS kind_name,
CASE status_code WHEN 1 THEN 'ok' WHEN 2 THEN 'error' ELSE 'unset' END AS status_name, NULL AS severity, count(*) AS n FROM spans GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, CASE WHEN severity_number BETWEEN 1 AND 4 THEN 'trace' WHEN severity_number BETWEEN 5 AND 8 THEN 'debug' WHEN severity_number BETWEEN 9 AND 12 THEN 'info' WHEN severity_number BETWEEN 13 AND 16 THEN 'warn' WHEN severity_number BETWEEN 17 AND 20 THEN 'error'
WHEN severity_number BETWEEN 21 AND 24 THEN 'fatal' ELSE 'unset' END, count(*) FROM l GROUP BY 3""")
def _code_names(spark, sf):
    codes = search.named_codes(ad.spans(spark, sf)).groupBy("kind_name", "status_name").agg(F.count("*").alias("n"))
    levels = ad.logs(spark, sf).groupBy(tel.severity_name(F.col("severity_number")).alias("severity")).agg(F.count("*").alias("n"))
    return codes.unionByName(levels, allowMissingColumns=True)


@query("count_by_severity", f"WITH {ad.LOGS_SQL} SELECT service, severity_number, count(*) AS n FROM logs WHERE {P1} GROUP BY 1, 2")
def _count_by_severity(spark, sf):
    return search.count_by_severity(ad.logs(spark, sf), "p1", A, B)


# --- traces -----------------------------------------------------------------------------------

_SUMMARY = """SELECT project, trace_id, min(ts) AS start_ts, max(end_ts) AS end_ts, array_to_string(list_sort(list_distinct(list(service))), ',') AS services, count(*) AS spans,
  greatest(epoch_us(max(end_ts)) - epoch_us(min(ts)), 0) * 1000 AS duration_ns FROM spans GROUP BY 1, 2"""


@query("trace_get", f"WITH {ad.SPANS_SQL} SELECT {_SPAN} FROM spans WHERE {P1} AND trace_id = md5('t400') ORDER BY ts, ingest_ts LIMIT 5001")
def _trace_get(spark, sf):
    return traces.trace_get(ad.spans(spark, sf), "p1", "81365B1EC3255324DEB3D4AA9942E9D0", A, B).select(*_SPAN_COLUMNS)


query("trace_by_id", f"WITH {ad.SPANS_SQL} SELECT {_SPAN} FROM spans WHERE project = 'p1' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND trace_id = md5('t400') ORDER BY ts, ingest_ts LIMIT 5001")(
    lambda spark, sf: traces.trace_get(ad.spans(spark, sf), "p1", "81365b1ec3255324deb3d4aa9942e9d0", A, A + timedelta(days=7)).select(*_SPAN_COLUMNS)
)
query("trace_summary", f"WITH {ad.SPANS_SQL} {_SUMMARY}")(lambda spark, sf: traces.trace_summary(ad.spans(spark, sf)))
query("trace_summary_orders", f"WITH {ad.ORDER_SPANS_SQL}, s AS (SELECT *, ts + to_microseconds(duration_ns // 1000) AS end_ts FROM spans) {_SUMMARY.replace('FROM spans', 'FROM s')}")(
    lambda spark, sf: traces.trace_summary(ad.order_spans(spark, sf))
)

_TREE = f"""WITH RECURSIVE {ad.SPANS_SQL},
roots AS (SELECT s.*, s.parent_span_id IS NOT NULL AS is_orphan FROM spans s WHERE parent_span_id IS NULL OR NOT EXISTS (SELECT 1 FROM spans x WHERE x.project = s.project AND x.trace_id = s.trace_id AND x.span_id = s.parent_span_id)),
t AS (SELECT project, trace_id, span_id, status_code, 0 AS depth, is_orphan, [strftime(ts, '%Y%m%d%H%M%S%f') || span_id] AS path FROM roots
  UNION ALL SELECT s.project, s.trace_id, s.span_id, s.status_code, t.depth + 1, false, list_append(t.path, strftime(s.ts, '%Y%m%d%H%M%S%f') || s.span_id) FROM t JOIN spans s ON s.project = t.project AND s.trace_id = t.trace_id AND s.parent_span_id = t.span_id),
tree AS (SELECT project, trace_id, span_id, status_code, row_number() OVER (PARTITION BY project, trace_id ORDER BY path) - 1 AS position, depth, is_orphan,
  EXISTS (SELECT 1 FROM spans c WHERE c.project = t.project AND c.trace_id = t.trace_id AND c.parent_span_id = t.span_id) AS has_children, path FROM t)"""


@query("trace_tree", f"{_TREE} SELECT project, trace_id, span_id, position, depth, is_orphan, has_children FROM tree")
def _trace_tree(spark, sf):
    return traces.trace_tree(ad.spans(spark, sf))


@query("has_children_is_orphan", f"{_TREE} SELECT has_children, is_orphan, depth, count(*) AS n FROM tree GROUP BY 1, 2, 3")
def _has_children(spark, sf):
    return traces.trace_tree(ad.spans(spark, sf)).groupBy("has_children", "is_orphan", "depth").agg(F.count("*").alias("n"))


@query("collapse_subtrees", f"""{_TREE}, hidden AS (SELECT a.project, a.trace_id, a.span_id FROM tree a JOIN tree b ON a.project = b.project AND a.trace_id = b.trace_id AND b.span_id IN (SELECT substr(md5('s' || (5 * i + 1)), 1, 16) FROM range(0, 200) r(i))
  AND len(a.path) > len(b.path) AND a.path[1:len(b.path)] = b.path)
SELECT project, trace_id, span_id, depth FROM tree WHERE (project, trace_id, span_id) NOT IN (SELECT (project, trace_id, span_id) FROM hidden)""")
def _collapse(spark, sf):
    import hashlib

    ids = [hashlib.md5(f"s{5 * i + 1}".encode()).hexdigest()[:16] for i in range(200)]
    return traces.trace_tree(ad.spans(spark, sf), collapsed=ids).select("project", "trace_id", "span_id", "depth")


@query("first_error_span", f"{_TREE} SELECT project, trace_id, min_by(span_id, position) AS span_id FROM tree WHERE status_code = 2 GROUP BY 1, 2")
def _first_error(spark, sf):
    spans = ad.spans(spark, sf)
    return traces.first_error_span(spans, traces.trace_tree(spans))


@query("waterfall_bars", f"""WITH {ad.SPANS_SQL}, s AS ({_SUMMARY}),
w AS (SELECT sp.*, s.duration_ns AS total, s.start_ts FROM spans sp JOIN s USING (project, trace_id)),
x AS (SELECT *, least(greatest(duration_ns / total * 100, 0.5), 100.0) AS width FROM w)
SELECT trace_id, span_id, round(CASE WHEN total > 0 THEN least(greatest((epoch_us(ts) - epoch_us(start_ts)) * 1000 / total * 100, 0.0), 100 - width) ELSE 0.0 END, 6) AS offset_pct, round(CASE WHEN total > 0 THEN width ELSE 0.5 END, 6) AS width_pct FROM x""")
def _waterfall(spark, sf):
    return traces.waterfall_bars(ad.spans(spark, sf)).select("trace_id", "span_id", "offset_pct", "width_pct")


@query("span_links", f"""WITH {ad.SPANS_SQL}, l AS (SELECT * FROM spans WHERE link_trace IS NOT NULL)
SELECT l.project, l.trace_id AS from_trace_id, l.span_id AS from_span_id, l.link_trace AS to_trace_id, l.link_span AS to_span_id, s.service AS to_service, s.name AS to_name
FROM l LEFT JOIN spans s ON s.project = l.project AND s.trace_id = l.link_trace AND s.span_id = l.link_span AND abs(epoch_us(s.ts) - epoch_us(l.ts)) <= 86400000000""")
def _span_links(spark, sf):
    return traces.span_links(ad.spans(spark, sf))


_TRACE_LOGS = "logs AS (SELECT ts, ingest_ts, project, md5('t' || (event_id // 5)) AS trace_id, event_type || ' by user ' || user_id AS body FROM e)"


@query("trace_logs", f"""WITH {ad.SPANS_SQL}, {_TRACE_LOGS}, s AS ({_SUMMARY})
SELECT l.ts, l.ingest_ts, l.trace_id, l.body FROM logs l JOIN s USING (project, trace_id) WHERE l.ts >= s.start_ts AND l.ts < s.end_ts + INTERVAL 1 SECOND""")
def _trace_logs(spark, sf):
    return traces.trace_logs(ad.logs(spark, sf), ad.spans(spark, sf)).select("ts", "ingest_ts", "trace_id", "body")


@query("attr_entries", f"WITH {ad.LOGS_SQL} SELECT ingest_ts, k AS key, json_extract_string(attributes, '$.\"' || k || '\"') AS value FROM (SELECT *, unnest(json_keys(attributes)) AS k FROM logs)")
def _attr_entries(spark, sf):
    return catalog.attr_entries(ad.logs(spark, sf), ["ingest_ts"])


# --- metrics ----------------------------------------------------------------------------------

S6 = 21_600
_STEP = lambda s, c="ts": f"make_timestamp((epoch_us({c}) // {s * 1_000_000}) * {s * 1_000_000})"
_MA, _MB = datetime(2024, 1, 5), datetime(2024, 1, 15)
_MR = "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15'"
#: The range's first 10 minutes before the start are read as well, to find predecessors.
_LOOK = "ts >= TIMESTAMP '2024-01-04 23:50:00' AND ts < TIMESTAMP '2024-01-15'"


def _deltas_sql() -> str:
    return f"""{ad.COUNTER_SQL}, d0 AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY ts, ingest_ts) AS pv FROM points WHERE {_LOOK}),
d AS (SELECT *, CASE WHEN v < pv THEN v ELSE v - pv END AS dv FROM d0 WHERE pv IS NOT NULL AND {_MR})"""


@query("series_deltas", f"WITH {_deltas_sql()} SELECT series AS series_hash, ts, CAST(dv AS DOUBLE) AS dv, v < pv AS is_reset FROM d")
def _series_deltas(spark, sf):
    return metrics.series_deltas(ad.counter_points(spark, sf), _MA, _MB).select("series_hash", "ts", "dv", "is_reset")


def _counter(spark, sf, step: int, group_by: str | None = "service"):
    return metrics.grouped(metrics.series_deltas(ad.counter_points(spark, sf), _MA, _MB), group_by, step)


query("counter_increase", f"WITH {_deltas_sql()} SELECT service AS grp, {_STEP(S6)} AS step_ts, CAST(sum(dv) AS DOUBLE) AS value FROM d GROUP BY 1, 2")(lambda spark, sf: metrics.counter_increase(_counter(spark, sf, S6)))
query("counter_rate", f"WITH {_deltas_sql()} SELECT service AS grp, {_STEP(S6)} AS step_ts, round(sum(dv) / {S6}.0, 6) AS value FROM d GROUP BY 1, 2")(lambda spark, sf: metrics.counter_rate(_counter(spark, sf, S6), S6))
query("group_label", f"WITH {_deltas_sql()} SELECT coalesce(environment, '') AS grp, count(*) AS n FROM d GROUP BY 1")(lambda spark, sf: _counter(spark, sf, S6, "environment").groupBy("grp").agg(F.count("*").alias("n")))
query("step_bucket", f"WITH {ad.GAUGE_SQL} SELECT {_STEP(3600)} AS step_ts, count(*) AS n FROM points GROUP BY 1")(
    lambda spark, sf: metrics.grouped(ad.gauge_points(spark, sf), None, 3600).groupBy("step_ts").agg(F.count("*").alias("n"))
)


def _gauge(name: str, f: str) -> None:
    inner = {"sum": "arg_max(v, ts)"}.get(f, f"{f}(v)")
    sql = f"WITH {ad.GAUGE_SQL}, a AS (SELECT kind AS grp, series, {_STEP(S6)} AS step_ts, {inner} AS v FROM points WHERE {_MR} GROUP BY 1, 2, 3) SELECT grp, step_ts, round({f}(v), 6) AS value FROM a GROUP BY 1, 2"
    query(f"gauge_{f}", sql)(lambda spark, sf: metrics.gauge(metrics.grouped(ad.gauge_points(spark, sf).where(tel.in_range(F.col("ts"), _MA, _MB)), "kind", S6), f))


for _f in ("avg", "min", "max", "sum"):
    _gauge(_f, _f)


@query("updown_as_gauge", f"WITH {ad.COUNTER_SQL}, a AS (SELECT series, {_STEP(S6)} AS step_ts, avg(v) AS v FROM points WHERE {_MR} AND project = 'p1' GROUP BY 1, 2), b AS (SELECT step_ts, avg(v) AS value FROM a GROUP BY 1), st AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 6 HOUR)) AS step_ts) SELECT st.step_ts, round(value, 6) AS value FROM st LEFT JOIN b USING (step_ts)")
def _updown(spark, sf):
    points = ad.counter_points(spark, sf).withColumn("monotonic", F.lit(False))
    return metric_query(points, MetricQuery("events.total", "p1", _MA, _MB, step_s=S6)).series.select("step_ts", "value")


# A histogram point is its series' nth event, so a delta is the event itself when its predecessor was read.
_HIST = f"""{ad.HISTOGRAM_SQL}, d0 AS (SELECT *, lag(nth) OVER (PARTITION BY series ORDER BY ts, ingest_ts) AS pn FROM points WHERE {_LOOK}), d AS (SELECT *, service AS grp FROM d0 WHERE pn IS NOT NULL AND {_MR}),
b AS (SELECT *, CASE WHEN v <= low THEN 0 WHEN v <= 50 THEN 1 WHEN v <= 100 THEN 2 ELSE 3 END AS pos FROM d)"""


def _hist(spark, sf):
    return metrics.grouped(metrics.series_deltas(ad.histogram_points(spark, sf), _MA, _MB), "service", 86_400)


_CHOSEN = """n AS (SELECT grp, low, count(DISTINCT series) AS series, count(*) AS total FROM d GROUP BY 1, 2),
c AS (SELECT grp, low FROM n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY series DESC, total DESC, low) = 1),
i AS (SELECT c.grp, c.low, count(DISTINCT d.series) FILTER (d.low <> c.low) AS bad FROM c JOIN d USING (grp) GROUP BY 1, 2)"""
query("histogram_rate", f"WITH {_HIST} SELECT grp, {_STEP(86400)} AS step_ts, round(count(*) / 86400.0, 6) AS value FROM d GROUP BY 1, 2")(lambda spark, sf: metrics.histogram_rate(_hist(spark, sf), 86_400))
query("histogram_avg", f"WITH {_HIST} SELECT grp, {_STEP(86400)} AS step_ts, round(avg(v), 6) AS value FROM d GROUP BY 1, 2")(lambda spark, sf: metrics.histogram_avg(_hist(spark, sf)))
query("bucket_sums", f"""WITH {_HIST}, k AS (SELECT grp, {_STEP(86400)} AS step_ts, low, count(*) FILTER (pos = 0) || ',' || count(*) FILTER (pos = 1) || ',' || count(*) FILTER (pos = 2) || ',' || count(*) FILTER (pos = 3) AS counts FROM b GROUP BY 1, 2, 3)
SELECT grp, step_ts, printf('%.1f', low) || ',50.0,100.0' AS bounds, counts FROM k""")(lambda spark, sf: metrics.bucket_sums(_hist(spark, sf)))
query("merged_bounds", f"WITH {_HIST}, {_CHOSEN} SELECT grp, printf('%.1f', low) || ',50.0,100.0' AS bounds, bad AS incompatible_series FROM i")(lambda spark, sf: metrics.merged_bounds(_hist(spark, sf)))
query("incompatible_total", f"WITH {_HIST}, {_CHOSEN} SELECT CAST(coalesce(sum(bad), 0) AS BIGINT) AS incompatible_series FROM i")(lambda spark, sf: metrics.incompatible_total(metrics.merged_bounds(_hist(spark, sf))))


def _quantile_sql(q: float, step: int, bounds: str = "i") -> str:
    return f"""{_HIST}, {_CHOSEN},
k AS (SELECT b.grp, {_STEP(step)} AS step_ts, low, count(*) FILTER (pos = 0) AS c0, count(*) FILTER (pos = 1) AS c1, count(*) FILTER (pos = 2) AS c2, count(*) AS n FROM b JOIN c USING (grp, low) GROUP BY 1, 2, 3),
q AS (SELECT grp, step_ts, CASE WHEN c0 > 0 AND c0 >= {q} * n THEN low * {q} * n / c0
  WHEN c1 > 0 AND c0 + c1 >= {q} * n THEN low + (50 - low) * ({q} * n - c0) / c1 WHEN c2 > 0 AND c0 + c1 + c2 >= {q} * n THEN 50 + 50 * ({q} * n - c0 - c1) / c2 ELSE 100.0 END AS value FROM k)"""


query("histogram_quantile", f"WITH {_quantile_sql(0.5, 86400)} SELECT grp, step_ts, round(value, 6) AS value, bad AS incompatible_series FROM q JOIN i USING (grp)")(lambda spark, sf: metrics.histogram_quantiles(_hist(spark, sf), 0.5))


_ALL_POINTS = f"""{ad.GAUGE_SQL}, every AS (SELECT 'event.value' AS name, 1 AS type, false AS monotonic, '1' AS unit, service, series, ts, project FROM points
  UNION ALL SELECT 'events.total', 2, true, '1', service, series, ts, project FROM points UNION ALL SELECT 'event.size', 3, false, '1', service, series, ts, project FROM points)"""


@query("metric_catalog", f"""WITH {_ALL_POINTS} SELECT name, type, monotonic, unit, array_to_string(list_sort(list(DISTINCT service)), ',') AS services, count(DISTINCT series) AS series, count(*) AS points, max(ts) AS last_ts
FROM every WHERE {P1} AND contains(lower(name), 'event') GROUP BY 1, 2, 3, 4 ORDER BY 1, 2, 3, 4 LIMIT 1001""")
def _metric_catalog(spark, sf):
    return catalog.metric_catalog(ad.all_points(spark, sf), "p1", A, B, "EVENT")


@query("metric_attributes", f"""WITH {ad.GAUGE_SQL}, v AS (SELECT DISTINCT kind FROM points WHERE {P1}) SELECT 'kind' AS key, count(*) AS distinct_values, (SELECT array_to_string(list_sort(list(kind)), ',') FROM v) AS first_values FROM v HAVING count(*) > 0""")
def _metric_attributes(spark, sf):
    return catalog.metric_attributes(ad.all_points(spark, sf), "p1", "event.value", A, B)


@query("metric_kind", f"WITH {_ALL_POINTS} SELECT DISTINCT type, monotonic, unit FROM every")
def _metric_kind(spark, sf):
    return catalog.metric_kinds(ad.all_points(spark, sf))


_SERVICES5 = f"""WITH {_deltas_sql()}, v AS (SELECT service AS grp, {_STEP(S6)} AS step_ts, CAST(sum(dv) AS DOUBLE) AS value FROM d WHERE project = 'p1' GROUP BY 1, 2),
g AS (SELECT DISTINCT service AS grp FROM points WHERE {_MR} AND project = 'p1'), r AS (SELECT grp, coalesce(sum(value), 0) AS total, row_number() OVER (ORDER BY coalesce(sum(value), 0) DESC, grp) AS rank FROM g LEFT JOIN v USING (grp) GROUP BY 1),
st AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 6 HOUR)) AS step_ts), f AS (SELECT r.grp, r.rank, st.step_ts, v.value FROM r CROSS JOIN st LEFT JOIN v USING (grp, step_ts))"""


def _counter_query(spark, sf, **more):
    q = MetricQuery("events.total", "p1", _MA, _MB, **({"aggregate": "increase", "group_by": "service", "step_s": S6} | more))
    return metric_query(ad.all_points(spark, sf), q)


query("metric_query", f"{_SERVICES5} SELECT grp, rank, step_ts, value FROM f")(lambda spark, sf: _counter_query(spark, sf).series.select("grp", "rank", "step_ts", "value"))
query("rank_series", f"{_SERVICES5} SELECT grp, total, rank FROM r WHERE rank <= 4")(lambda spark, sf: metrics.rank_series(metrics.seed_groups(_p1_inside(spark, sf)), _p1_values(spark, sf), 3))
query("seed_groups", f"{_SERVICES5} SELECT grp FROM g")(lambda spark, sf: metrics.seed_groups(_p1_inside(spark, sf)))
query("fill_steps", f"{_SERVICES5} SELECT grp, step_ts, value FROM f")(lambda spark, sf: metrics.fill_steps(metrics.seed_groups(_p1_inside(spark, sf)), _p1_values(spark, sf), _MA, _MB, S6))
query("last_value", f"{_SERVICES5} SELECT grp, arg_max(value, step_ts) AS value FROM f GROUP BY 1")(lambda spark, sf: metrics.last_value(_counter_query(spark, sf).series))
query("metric_table", f"""{_SERVICES5} SELECT step_ts, max(value) FILTER (grp = 'svc-0') AS "svc-0", max(value) FILTER (grp = 'svc-1') AS "svc-1", max(value) FILTER (grp = 'svc-2') AS "svc-2", max(value) FILTER (grp = 'svc-3') AS "svc-3", max(value) FILTER (grp = 'svc-4') AS "svc-4" FROM f GROUP BY 1""")(
    lambda spark, sf: metrics.metric_table(_counter_query(spark, sf).series)
)


def _p1_inside(spark, sf):
    points = ad.counter_points(spark, sf).where(tel.in_range(F.col("ts"), _MA, _MB) & (F.col("project") == "p1"))
    return metrics.grouped(points, "service", S6)


def _p1_values(spark, sf):
    points = ad.counter_points(spark, sf).where(F.col("project") == "p1")
    return metrics.counter_increase(metrics.grouped(metrics.series_deltas(points, _MA, _MB), "service", S6))


#: What the catalog says of event.size: a caller that knows the kind saves its lookup.
_EVENT_SIZE = (tel.HISTOGRAM, False, "1")


@query("request_rate", f"""WITH {_HIST}, v AS (SELECT {_STEP(3600)} AS step_ts, count(*) / 3600.0 AS value FROM d WHERE project = 'p1' GROUP BY 1), st AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 1 HOUR)) AS step_ts)
SELECT step_ts, round(value, 6) AS value FROM st LEFT JOIN v USING (step_ts)""")
def _request_rate(spark, sf):
    return metric_query(ad.all_points(spark, sf), MetricQuery("event.size", "p1", _MA, _MB, "rate", step_s=3600), kind=_EVENT_SIZE).series.select("step_ts", "value")


_P95 = _quantile_sql(0.95, 86400).replace(f"WHERE pn IS NOT NULL AND {_MR}", f"WHERE pn IS NOT NULL AND {_MR} AND project = 'p1'")


@query("p95_latency", f"""WITH {_P95}, g AS (SELECT DISTINCT service AS grp FROM points WHERE {_MR} AND project = 'p1'), st AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 1 DAY)) AS step_ts)
SELECT grp, step_ts, round(value, 6) AS value, bad AS incompatible_series FROM g CROSS JOIN st LEFT JOIN q USING (grp, step_ts) LEFT JOIN i USING (grp)""")
def _p95(spark, sf):
    return metric_query(ad.all_points(spark, sf), MetricQuery("event.size", "p1", _MA, _MB, "p95", "service", 86_400), kind=_EVENT_SIZE).series.select("grp", "step_ts", "value", "incompatible_series")


@query("jobs_rate", f"""{_SERVICES5}, x AS (SELECT {_STEP(3600)} AS step_ts, sum(dv) / 3600.0 AS value FROM d WHERE project = 'p1' GROUP BY 1), h AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 1 HOUR)) AS step_ts)
SELECT step_ts, round(value, 6) AS value FROM h LEFT JOIN x USING (step_ts)""")
def _jobs_rate(spark, sf):
    return _counter_query(spark, sf, aggregate="rate", group_by=None, step_s=3600).series.select("step_ts", "value")


# --- panels -----------------------------------------------------------------------------------

_PANELS = [panels.Panel("total", "events.total", "increase", reduce="sum"), panels.Panel("latest", "event.value", "max", environment="staging", reduce="last")]


def _panel_series(spark, sf):
    return panels.panel_query(ad.all_points(spark, sf), _PANELS, "p1", _MA, _MB, environment="prod", step_s=S6)


# a filter on the environment narrows each series to its points there before the deltas
_ENV = f"""WITH {ad.COUNTER_SQL}, d0 AS (SELECT *, lag(v) OVER (PARTITION BY series ORDER BY ts, ingest_ts) AS pv FROM points WHERE {_LOOK} AND project = 'p1' AND environment = 'prod'),
d AS (SELECT *, CASE WHEN v < pv THEN v ELSE v - pv END AS dv FROM d0 WHERE pv IS NOT NULL AND {_MR}), st AS (SELECT unnest(range(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', INTERVAL 6 HOUR)) AS step_ts),
t AS (SELECT {_STEP(S6)} AS step_ts, CAST(sum(dv) AS DOUBLE) AS value FROM d GROUP BY 1), gs AS (SELECT user_id AS series, {_STEP(S6)} AS step_ts, max(value) AS v FROM e WHERE {_MR} AND project = 'p1' AND environment = 'staging' GROUP BY 1, 2), m AS (SELECT step_ts, max(v) AS value FROM gs GROUP BY 1),
p AS (SELECT 'total' AS panel_id, step_ts, value FROM st LEFT JOIN t USING (step_ts) UNION ALL SELECT 'latest', step_ts, value FROM st LEFT JOIN m USING (step_ts))"""
query("panel_query", f"{_ENV} SELECT panel_id, step_ts, round(value, 6) AS value FROM p")(lambda spark, sf: _panel_series(spark, sf).select("panel_id", "step_ts", "value"))
query("reduce_last", f"{_ENV} SELECT panel_id, round(coalesce(arg_max(value, step_ts) FILTER (value IS NOT NULL AND step_ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-14 21:00:00'), arg_max(value, step_ts) FILTER (value IS NOT NULL)), 6) AS value FROM p GROUP BY 1")(
    lambda spark, sf: panels.reduce_last(_panel_series(spark, sf), datetime(2024, 1, 14, 21), S6)
)
query("reduce_sum", f"{_ENV} SELECT panel_id, round(sum(value), 6) AS value FROM p GROUP BY 1")(lambda spark, sf: panels.reduce_sum(_panel_series(spark, sf)))


# --- lake -------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one in local mode where that is unset."""
    shared, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not shared and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/lumenlake-core/{uuid.uuid4().hex}"


def _lake(spark: SparkSession, sf_dir: str) -> str:
    """The logs of events in a lake, written in two parts (the second is late rows, and it comes twice, the first time with
    other rows); once per session and table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _lakes:
        root, logs = _scratch(spark), ad.logs(spark, sf_dir)
        late = F.unix_micros("ingest_ts") % 10 == 9
        lake.write_hours(logs.where(~late), root, "logs")
        for rows in (logs.where(late & (F.unix_micros("ingest_ts") % 500 == 9)).withColumn("body", F.lit("first try")), logs.where(late)):
            lake.write_hours(rows, root, "logs", writer="late")
        _lakes[key] = root
    return _lakes[key]


def _stats(spark, sf):
    return lake.file_stats(spark, _lake(spark, sf), "logs")


_HOURLY = f"""WITH {ad.LOGS_SQL}, h AS (SELECT date_trunc('hour', ts) AS hour, epoch_us(ingest_ts) % 10 = 9 AS late, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts, max(ingest_ts) AS max_ingest_ts FROM logs GROUP BY 1, 2),
r AS (SELECT hour, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, max(max_ingest_ts) AS max_ingest_ts, CAST(sum(rows) * 1000 AS BIGINT) AS bytes FROM h GROUP BY 1)"""


def _report(spark, sf):
    """The report with 1000 bytes a row, as file sizes have no SQL form."""
    return lake.storage_report(_stats(spark, sf).withColumn("bytes", F.col("rows") * 1000))


query("scan_signal", f"WITH {ad.LOGS_SQL} SELECT {_LOG} FROM logs WHERE ts >= TIMESTAMP '2024-01-05 07:30:00' AND ts < TIMESTAMP '2024-01-12 16:00:00'")(
    lambda spark, sf: lake.scan_signal(spark, _lake(spark, sf), "logs", datetime(2024, 1, 5, 7, 30), datetime(2024, 1, 12, 16)).select(*_LOG_COLUMNS)
)


_FLAT = """CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 0 END AS severity_number, event_type AS body, md5('t' || (event_id // 5)) AS trace_id,
CASE WHEN user_id % 5 = 4 THEN 'unknown_service' ELSE 'svc-' || (user_id % 5) END AS service, '{"kind":"' || event_type || '","user":' || user_id || '}' AS attributes"""


def _both(spark: SparkSession, sf_dir: str) -> str:
    """A lake of two writers: the logs of events by hours, and the log exports of events by a stream whose second batch runs
    twice, the second time after a restart."""
    key = (spark.sparkContext.applicationId, sf_dir + "#both")
    if key not in _lakes:
        root, sent = _scratch(spark), ad.log_exports(spark, sf_dir)
        lake.write_hours(ad.logs(spark, sf_dir), root, "logs")
        for batch in (0, 1, 1):
            ingest.Ingest(root, "logs")(sent.where(F.col("request_id") % 2 == batch), batch)
        _lakes[key] = root
    return _lakes[key]


_TWO = "ts, severity_number, body, service"
query("lake_union", f"WITH {ad.LOGS_SQL}, sent AS (SELECT ts, {_FLAT} FROM events WHERE event_id % 9 <> 0), u AS (SELECT {_TWO} FROM logs UNION ALL SELECT {_TWO} FROM sent) SELECT {_TWO} FROM u WHERE ts >= TIMESTAMP '2024-01-05 07:30:00' AND ts < TIMESTAMP '2024-01-12 16:00:00'")(
    lambda spark, sf: lake.scan_signal(spark, _both(spark, sf), "logs", datetime(2024, 1, 5, 7, 30), datetime(2024, 1, 12, 16)).select("ts", "severity_number", "body", "service")
)
query("ingest_totals", "SELECT count(*) FILTER (event_id % 9 <> 0) AS accepted, count(*) FILTER (event_id % 9 = 0) AS rejected, count(*) FILTER (user_id % 5 = 4 AND event_id % 9 <> 0) AS unknown_service, 0 AS duplicates, 2 AS commits FROM events")(
    lambda spark, sf: manifest.totals(spark, _both(spark, sf), "logs", "stream").select("accepted", "rejected", "unknown_service", "duplicates", "commits")
)
query("write_hours", f"WITH {ad.LOGS_SQL} SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS rows FROM logs GROUP BY 1, 2")(
    lambda spark, sf: lake.committed(spark, _lake(spark, sf), "logs", datetime(1970, 1, 1)).groupBy("date", "hour").agg(F.count("*").alias("rows"))
)
query("closed_hours", f"WITH {ad.LOGS_SQL} SELECT DISTINCT date_trunc('hour', ts) AS hour FROM logs WHERE date_trunc('hour', ts) + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-20 06:00:00'")(
    lambda spark, sf: lake.closed_hours(ad.logs(spark, sf), datetime(2024, 1, 20, 6))
)
query("late_rows", f"{_HOURLY} SELECT hour, files, rows FROM r")(lambda spark, sf: lake.storage_report(_stats(spark, sf)).select("hour", "files", "rows"))
query("file_stats", f"{_HOURLY} SELECT hour, rows, min_ts, max_ts, max_ingest_ts FROM h")(lambda spark, sf: _stats(spark, sf).select("hour", "rows", "min_ts", "max_ts", "max_ingest_ts"))
query("files_for_range", f"{_HOURLY} SELECT rows, min_ts, max_ts FROM h WHERE min_ts < TIMESTAMP '2024-01-10 12:30:00' AND max_ts >= TIMESTAMP '2024-01-10 03:20:00'")(
    lambda spark, sf: lake.files_for_range(_stats(spark, sf), datetime(2024, 1, 10, 3, 20), datetime(2024, 1, 10, 12, 30)).select("rows", "min_ts", "max_ts")
)
query("storage_report", f"{_HOURLY} SELECT 'logs' AS signal, count(*) AS hours, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, min(hour) AS oldest_hour, arg_min(bytes, hour) AS oldest_bytes, max(max_ingest_ts) AS max_ingest_ts FROM r")(
    lambda spark, sf: lake.storage_totals(_report(spark, sf))
)
_NOW, _DAYS, _SHARE = datetime(2024, 1, 25), {"logs": 10}, 2_500_000
_AGE = "hour <= TIMESTAMP '2024-01-14 23:00:00'"
_SIZE = "o AS (SELECT *, sum(bytes) OVER (ORDER BY hour DESC) AS running FROM r)"
query("retention_by_age", f"{_HOURLY} SELECT hour, files, bytes FROM r WHERE {_AGE}")(lambda spark, sf: lake.retention_by_age(_report(spark, sf), _DAYS, _NOW).select("hour", "files", "bytes"))
query("retention_by_size", f"{_HOURLY}, {_SIZE} SELECT hour, files, bytes FROM o WHERE running > {_SHARE}")(lambda spark, sf: lake.retention_by_size(_report(spark, sf), _SHARE).select("hour", "files", "bytes"))
query("retention_report", f"""{_HOURLY}, {_SIZE} SELECT 'age' AS phase, count(*) AS hours, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM r WHERE {_AGE}
UNION ALL SELECT 'size', count(DISTINCT hour), CAST(coalesce(sum(files), 0) AS BIGINT), CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM o WHERE running > {_SHARE}""")(
    lambda spark, sf: lake.retention_report(lake.retention_by_age(_report(spark, sf), _DAYS, _NOW), lake.retention_by_size(_report(spark, sf), _SHARE))
)


@query("scan_mixed_schema", f"WITH {ad.LOGS_SQL} SELECT ingest_ts, CASE WHEN epoch_us(ingest_ts) % 2 = 0 THEN environment END AS environment FROM logs")
def _mixed(spark, sf):
    root, logs = _scratch(spark), ad.logs(spark, sf).select("ts", "ingest_ts", "environment")
    odd = F.unix_micros("ingest_ts") % 2 == 1
    logs.where(odd).drop("environment").write.parquet(f"{root}/old")
    logs.where(~odd).write.parquet(f"{root}/new")
    return lake.scan_mixed_schema(spark, f"{root}/old", f"{root}/new").select("ingest_ts", "environment")


# --- normalisation and ingest -----------------------------------------------------------------

query("flatten_logs", f"SELECT event_id // 50 AS request_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 9 = 0 THEN 'log record has no time_unix_nano or observed_time_unix_nano' END AS reject_reason, {_FLAT} FROM events")(
    lambda spark, sf: otlp.flatten_logs(ad.log_exports(spark, sf)).select("request_id", "ts", "reject_reason", "severity_number", "body", "trace_id", "service", "attributes")
)
query("attrs_to_json", "SELECT '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS attributes, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, sf: otlp.flatten_logs(ad.log_exports(spark, sf)).groupBy("attributes").agg(F.count("*").alias("n"))
)
query("flatten_spans", """SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 13 = 0 THEN 'ab' ELSE md5('t' || (event_id // 5)) END AS trace_id, substr(md5('s' || event_id), 1, 16) AS span_id, event_type AS name, event_id % 5 + 1 AS kind,
CASE WHEN event_id % 17 = 0 THEN epoch_us(ts) * 1000 + CAST(round(value * 1000) AS BIGINT) * 1000 ELSE CAST(round(value * 1000) AS BIGINT) * 1000 END AS duration_ns, '{"rate":0.5,"user":' || user_id || '}' AS attributes, 'svc-' || (user_id % 5) AS service,
CASE WHEN event_id % 13 = 0 THEN 'span trace_id must be 16 bytes' WHEN event_id % 17 = 0 THEN 'span has no start_time_unix_nano' END AS reject_reason FROM events""")(
    lambda spark, sf: otlp.flatten_spans(ad.span_exports(spark, sf)).select("ts", "trace_id", "span_id", "name", "kind", "duration_ns", "attributes", "service", "reject_reason")
)
query("flatten_metrics", """SELECT CASE event_id % 5 WHEN 0 THEN 'event.value' WHEN 1 THEN 'events.total' WHEN 2 THEN 'event.size' WHEN 3 THEN 'event.summary' ELSE '' END AS name, CASE WHEN event_id % 5 <> 3 THEN ts END AS ts, CASE WHEN event_id % 5 = 1 THEN user_id ELSE -1 END AS value_int, CASE WHEN event_id % 5 IN (0, 4) THEN round(value, 6) END AS value_double,
CASE WHEN event_id % 5 = 2 THEN 3 ELSE -1 END AS count, CASE WHEN event_id % 10 = 2 THEN '1,2,3' WHEN event_id % 5 = 2 THEN '1,2' END AS bucket_counts,
CASE WHEN event_id % 5 = 3 THEN 'summary metrics are not supported' WHEN event_id % 5 = 4 THEN 'metric has no name' WHEN event_id % 15 = 1 THEN 'sum has no aggregation temporality' WHEN event_id % 10 = 2 THEN 'histogram bucket_counts must have one more element than explicit_bounds' END AS reject_reason FROM events""")(
    lambda spark, sf: otlp.flatten_metrics(ad.metric_exports(spark, sf)).select("name", "ts", F.coalesce("value_int", F.lit(-1)).alias("value_int"), "value_double", F.coalesce("count", F.lit(-1)).alias("count"), "bucket_counts", "reject_reason")
)
query("series_hash", "SELECT CASE event_id % 5 WHEN 0 THEN 'event.value' WHEN 1 THEN 'events.total' ELSE 'event.size' END AS name, user_id AS user, count(*) AS points, 1 AS hashes FROM events WHERE event_id % 5 < 3 AND event_id % 15 <> 1 AND event_id % 10 <> 2 GROUP BY 1, 2")(
    lambda spark, sf: otlp.accepted(otlp.flatten_metrics(ad.metric_exports(spark, sf))).groupBy("name", tel.attributes_map(F.col("attributes"))["user"].cast("long").alias("user")).agg(F.count("*").alias("points"), F.countDistinct("series_hash").alias("hashes"))
)
query("reject_summary", "SELECT event_id // 50 AS request_id, CASE WHEN event_id % 9 = 0 THEN 'log record has no time_unix_nano or observed_time_unix_nano' END AS reject_reason, count(*) AS rows, count(*) FILTER (user_id % 5 = 4 AND event_id % 9 <> 0) AS unknown_service FROM events GROUP BY 1, 2")(
    lambda spark, sf: otlp.reject_summary(otlp.flatten_logs(ad.log_exports(spark, sf)))
)
query("dedup_spans", f"WITH {ad.ORDER_SPANS_SQL} SELECT trace_id, span_id, ts, service, duration_ns FROM spans WHERE span_id NOT LIKE '%-3' QUALIFY row_number() OVER (PARTITION BY project, trace_id, span_id ORDER BY ts, service, duration_ns) = 1")(
    lambda spark, sf: ingest.dedup_spans(s := ad.order_spans(spark, sf), s.where(F.col("span_id").endswith("-3")), (F.col("ts"), F.col("service"), F.col("duration_ns"))).select("trace_id", "span_id", "ts", "service", "duration_ns")
)


@query("dedup_points", f"WITH {ad.GAUGE_SQL} SELECT series AS series_hash, ts, round(v, 6) AS value_double FROM points WHERE epoch_us(ingest_ts) % 5 <> 0")
def _dedup_points(spark, sf):
    points = ad.gauge_points(spark, sf)
    us = F.unix_micros("ingest_ts")
    return ingest.dedup_points(points.unionByName(points.where(us % 3 == 0)), points.where(us % 5 == 0)).select("series_hash", "ts", "value_double")


@query("ingest_stamp", f"WITH {ad.LOGS_SQL} SELECT epoch_us(ingest_ts) % 2 AS batch, count(*) AS n, CASE epoch_us(ingest_ts) % 2 WHEN 0 THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-03-01 00:00:00.000001' END AS ingest_ts FROM logs GROUP BY 1, 3")
def _ingest_stamp(spark, sf):
    logs, last, parts = ad.logs(spark, sf).withColumn("batch", F.unix_micros("ingest_ts") % 2), 0, []
    for b in (0, 1):  # the clock stands still; the stamps still rise
        part, last = ingest.ingest_stamp(logs.where(F.col("batch") == b), last, datetime(2024, 3, 1))
        parts.append(part)
    return parts[0].unionByName(parts[1]).groupBy("batch", "ingest_ts").agg(F.count("*").alias("n"))


@query("ingest_stats", "SELECT count(*) FILTER (event_id % 13 <> 0 AND event_id % 17 <> 0) AS accepted, count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) AS rejected, 0 AS unknown_service, count(*) FILTER (event_id % 13 <> 0 AND event_id % 17 <> 0) AS duplicates FROM events")
def _ingest_stats(spark, sf):
    flat = otlp.flatten_spans(ad.span_exports(spark, sf))
    again = flat.unionByName(flat.where(F.col("reject_reason").isNull()))  # every good span is sent twice
    return ingest.ingest_stats(again, ingest.dedup_spans(otlp.accepted(again)))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The log exports of events, streamed from JSON files into a lake."""
    key = (spark.sparkContext.applicationId, sf_dir + "#stream")
    if key not in _lakes:
        root = _scratch(spark)
        ad.log_exports(spark, sf_dir).repartition(4).write.json(f"{root}/in")
        running, _ = ingest.stream_ingest(spark, f"{root}/in", f"{root}/lake", "logs", f"{root}/checkpoint", files_per_batch=2, available_now=True)
        running.awaitTermination()
        _lakes[key] = f"{root}/lake"
    return _lakes[key]


query("stream_ingest", f"SELECT ts, {_FLAT} FROM events WHERE event_id % 9 <> 0")(
    lambda spark, sf: lake.scan_signal(spark, _streamed(spark, sf), "logs", datetime(1970, 1, 1), datetime(2100, 1, 1)).select("ts", "severity_number", "body", "trace_id", "service", "attributes")
)


@query("logs_follow", f"WITH {ad.LOGS_SQL} SELECT {_LOG} FROM logs WHERE {P1} AND severity_number >= 13")
def _logs_follow(spark, sf):
    out = _scratch(spark)
    show = lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
    ingest.logs_follow(spark, _lake(spark, sf), replace(_BASE, level="warn"), show, f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(*_LOG_COLUMNS)


_LIVE = f"""WITH {ad.LOGS_SQL}, l AS (SELECT {_LOG}, CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-16' AND DATE '2024-01-18' THEN day(ts) - 15 ELSE 0 END AS part FROM logs WHERE {P1}),
c AS (SELECT count(*) FILTER (part = 1) AS c1, count(*) FILTER (part = 2) AS c2, count(*) FILTER (part = 3) AS c3 FROM l),
a AS (SELECT *, CASE WHEN c1 > 500 THEN 0 ELSE c1 END AS a1 FROM c), b AS (SELECT *, CASE WHEN a1 + c2 > 500 THEN 0 ELSE a1 + c2 END AS a2 FROM a),
r AS (SELECT CASE WHEN a2 + c3 > 500 THEN 3 WHEN a1 + c2 > 500 THEN 2 WHEN c1 > 500 THEN 1 ELSE 0 END AS reset FROM b),
page AS (SELECT l.* FROM l, r WHERE part <= reset ORDER BY ts DESC, ingest_ts DESC LIMIT 100)
SELECT {_LOG} FROM page UNION ALL SELECT {_LOG} FROM l, r WHERE part > reset"""


@query("live_list", _LIVE)
def _live_list(spark, sf):
    """Four commits and a poll after each: the list starts over when more than 500 rows have arrived."""
    root, folder, logs = _scratch(spark), _scratch(spark), ad.logs(spark, sf)
    part = F.datediff(F.to_date("ts"), F.lit("2024-01-15").cast("date"))  # three days come late, one after the other
    for n in range(4):
        lake.write_hours(logs.where(part == n if n else ~part.between(1, 3)), root, "logs")
        live.live_list(spark, root, _BASE, folder, available_now=True).awaitTermination()
    return live.live_rows(spark, _BASE, folder).select(*_LOG_COLUMNS)
