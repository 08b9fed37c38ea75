"""Nested exports (DataFrames of lumenlake.schema.EXPORTS) to rows of the signals, with a reject reason per record.

Every flatten_* returns the signal's columns but the stamp (ingest_ts is added on ingest), plus
request_id, unknown_service and reject_reason; a row with a reason is kept out by accepted().
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.functions import telemetry as tel
from lumenlake.schema import ATTRIBUTES

# Defaults, keys and reject reasons.
UNKNOWN_SERVICE, DEFAULT_ENVIRONMENT = "unknown_service", "default"
SERVICE_KEY, VERSION_KEY, ENVIRONMENT_KEY, OLD_ENVIRONMENT_KEY = "service.name", "service.version", "deployment.environment.name", "deployment.environment"
MAX_NS = 2**63 - 1
OUT_OF_RANGE = "timestamp out of range"
NO_LOG_TIME = "log record has no time_unix_nano or observed_time_unix_nano"
REASONS = {
    "no_name": "metric has no name", "no_time": "data point has no time_unix_nano", "no_value": "number data point has no value",
    "buckets": "histogram bucket_counts must have one more element than explicit_bounds", "sum_temporality": "sum has no aggregation temporality",
    "histogram_temporality": "histogram has no aggregation temporality", "delta_up_down": "delta up-down counters are not supported",
    "exponential": "exponential histogram metrics are not supported yet", "summary": "summary metrics are not supported",
}
SPAN_REASONS = (
    "span trace_id must be 16 bytes", "span span_id must be 8 bytes", "span trace_id must not be all zeros", "span span_id must not be all zeros", "span has no start_time_unix_nano",
)


def _plain(value) -> object:
    """A nested value (one of the value fields) as plain JSON data."""
    if not isinstance(value, dict):
        return None
    for kind in ("stringValue", "boolValue"):
        if value.get(kind) is not None:
            return value[kind]
    if value.get("intValue") is not None:
        return int(value["intValue"])
    if value.get("doubleValue") is not None:
        return _number(float(value["doubleValue"]))
    if value.get("bytesValue") is not None:
        return value["bytesValue"]
    if value.get("arrayValue") is not None:
        a = value["arrayValue"]
        return [_plain(v) for v in (a.get("values") or [] if isinstance(a, dict) else a)]
    if value.get("kvlistValue") is not None:
        a = value["kvlistValue"]
        return {kv["key"]: _plain(kv.get("value")) for kv in (a.get("values") or [] if isinstance(a, dict) else a)}
    return None


def _number(x: float) -> object:
    if math.isnan(x):
        return "NaN"
    return ("+Inf" if x > 0 else "-Inf") if math.isinf(x) else x


def _json(text: str, kind: str) -> str:
    return json.dumps(_plain({kind: json.loads(text)}), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _nested_json(text: pd.Series, is_list: pd.Series) -> pd.Series:
    """JSON text of nested array or key-value list contents, keys sorted; null for rows without any."""
    return pd.Series([None if t is None else _json(t, "arrayValue" if b else "kvlistValue") for t, b in zip(text, is_list, strict=True)])


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def value_json(v: Column, nested: bool = False) -> Column:
    """JSON text of a value: bytes as base64, NaN and infinities as strings, unset as null."""
    d = v["doubleValue"]
    number = F.when(F.isnan(d), F.lit('"NaN"')).when(d == float("inf"), F.lit('"+Inf"')).when(d == float("-inf"), F.lit('"-Inf"')).otherwise(F.to_json(F.struct(d.alias("d"))).substr(F.lit(6), F.length(F.to_json(F.struct(d.alias("d")))) - 6))
    out = (
        F.when(v["stringValue"].isNotNull(), _quoted(v["stringValue"]))
        .when(v["boolValue"].isNotNull(), v["boolValue"].cast("string"))
        .when(v["intValue"].isNotNull(), v["intValue"].cast("string"))
        .when(d.isNotNull(), number)
        .when(v["bytesValue"].isNotNull(), F.concat(F.lit('"'), F.base64(v["bytesValue"]), F.lit('"')))
    )
    return out.otherwise("null") if not nested else out


def string_attr(attributes: Column, key: str) -> Column:
    """The last value of a key, when it is a string; else ''."""
    found = F.filter(attributes, lambda x: x["key"] == key)
    return F.coalesce(F.get(found, F.size(found) - 1)["value"]["stringValue"], F.lit(""))


def attrs_to_json(attributes: Column) -> Column:
    """A JSON object with sorted keys; a repeated key keeps its last value; none gives null.

    Values that hold arrays or key-value lists are encoded by flatten_nested() beforehand.
    """
    last = F.filter(attributes, lambda x, i: ~F.exists(F.slice(attributes, i + 2, F.size(attributes)), lambda y: y["key"] == x["key"]))
    nested = lambda v: F.coalesce(v["kvlistValue"], v["arrayValue"])
    pairs = F.transform(last, lambda x: F.struct(x["key"].alias("k"), F.concat(_quoted(x["key"]), F.lit(":"), F.coalesce(nested(x["value"]), value_json(x["value"]))).alias("t")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: p["t"]), ","), F.lit("}"))
    return F.when(F.size(attributes) > 0, text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _encode_nested(values: pd.Series) -> pd.Series:
    """The JSON text of nested values that come as JSON text after 'a' (array) or 'k' (key-value list); null for rows without any."""
    one = lambda v: None if v is None else _json(v[1:], "arrayValue" if v[0] == "a" else "kvlistValue")
    return pd.Series([None if row is None else [one(v) for v in row] for row in values])


def _tagged(value: Column) -> Column:
    """A nested value's text after 'k' or 'a'; null for a plain value."""
    return F.coalesce(F.concat(F.lit("k"), value["kvlistValue"]), F.concat(F.lit("a"), value["arrayValue"]))


def _is_nested(x: Column) -> Column:
    return x["value"]["kvlistValue"].isNotNull() | x["value"]["arrayValue"].isNotNull()


def _with_json(attributes: Column, text: Column, first: Column) -> Column:
    """The attributes with text[first], text[first + 1], ... in the place of their nested values."""
    put = lambda x, i: F.struct(x["key"].alias("key"), x["value"].withField("kvlistValue", F.get(text, (first + i).cast("int"))).withField("arrayValue", F.lit(None).cast("string")).alias("value"))
    return F.transform(attributes, put)


def flatten_nested(df: DataFrame, column: str) -> DataFrame:
    """Replace the nested values of an attribute column by their JSON text. The Python step gets a null for each row that
    holds none, which is the rule; such rows keep their attributes as they are."""
    a = F.col(column)
    rows = df.withColumn("_enc", _encode_nested(F.when(F.exists(a, _is_nested), F.transform(a, lambda x: _tagged(x["value"])))))
    return rows.withColumn(column, F.when(F.col("_enc").isNull(), a).otherwise(_with_json(a, F.col("_enc"), F.lit(0)))).drop("_enc")


def flatten_nested_in(df: DataFrame, column: str) -> DataFrame:
    """The same for a column of records (span events, links) that have attributes of their own."""
    items = F.col(column)
    own = lambda e: F.coalesce(e["attributes"], F.array().cast(ATTRIBUTES.simpleString()))
    flat = F.flatten(F.transform(items, lambda e: F.transform(own(e), lambda x: _tagged(x["value"]))))
    rows = df.withColumn("_enc", _encode_nested(F.when(F.exists(items, lambda e: F.exists(own(e), _is_nested)), flat)))
    before = lambda i: F.aggregate(F.slice(items, 1, i), F.lit(0), lambda n, e: n + F.size(own(e)))
    put = F.transform(items, lambda e, i: e.withField("attributes", F.when(e["attributes"].isNotNull(), _with_json(e["attributes"], F.col("_enc"), before(i)))))
    return rows.withColumn(column, F.when(F.col("_enc").isNull(), items).otherwise(put)).drop("_enc")


def _empty_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _resource_columns(attributes: Column) -> dict[str, Column]:
    service, environment, old = string_attr(attributes, SERVICE_KEY), string_attr(attributes, ENVIRONMENT_KEY), string_attr(attributes, OLD_ENVIRONMENT_KEY)
    return {
        "service": F.coalesce(_empty_null(service), F.lit(UNKNOWN_SERVICE)),
        "environment": F.coalesce(_empty_null(environment), _empty_null(old), F.lit(DEFAULT_ENVIRONMENT)),
        "version": _empty_null(string_attr(attributes, VERSION_KEY)),
        "unknown_service": _empty_null(service).isNull(),
    }


def _records(exports: DataFrame, outer: str, inner: str, items: str, nested: bool) -> DataFrame:
    """One row per record: request_id, project, r (resource attributes), scope, x (the record)."""
    rows = exports.select("request_id", "project", F.explode(outer).alias("o")).select("request_id", "project", F.col("o.resource.attributes").alias("r"), F.explode(f"o.{inner}").alias("s"))
    rows = flatten_nested(rows, "r") if nested else rows
    return rows.select("request_id", "project", "r", F.col("s.scope").alias("scope"), F.explode(f"s.{items}").alias("x"))


def _time(ns: Column) -> Column:
    """Timestamp of unsigned nanoseconds, cut to microseconds; null for 0 and beyond int64."""
    return F.when((ns > 0) & (ns <= MAX_NS), F.timestamp_micros(F.floor(ns.cast("decimal(38,0)") / 1000).cast("long")))


def _out(ns: Column) -> Column:
    return F.coalesce(ns > MAX_NS, F.lit(False))


def flatten_logs(exports: DataFrame, nested: bool = True) -> DataFrame:
    """One row per log record. nested=False skips the Python step for exports known to hold no nested values."""
    rows = _records(exports, "resourceLogs", "scopeLogs", "logRecords", nested).withColumn("a", F.col("x.attributes"))
    rows = flatten_nested(rows, "a") if nested else rows
    time, observed, body = F.coalesce(F.col("x.timeUnixNano"), F.lit(0)), F.coalesce(F.col("x.observedTimeUnixNano"), F.lit(0)), F.col("x.body")
    own = F.when(time > 0, time).otherwise(observed)
    list_json = _nested_json(F.coalesce(body["arrayValue"], body["kvlistValue"]), body["arrayValue"].isNotNull()) if nested else F.lit(None).cast("string")
    r = _resource_columns(F.col("r"))
    return rows.select(
        "request_id", _time(own).alias("ts"), _time(observed).alias("observed_ts"), "project", r["service"].alias("service"), r["environment"].alias("environment"), r["version"].alias("version"),
        F.coalesce("x.severityNumber", F.lit(0)).cast("short").alias("severity_number"), _empty_null(F.col("x.severityText")).alias("severity_text"),
        _empty_null(F.when(body.isNotNull(), F.coalesce(body["stringValue"], list_json, value_json(body, nested=True)))).alias("body"),
        _empty_null(F.lower("x.traceId")).alias("trace_id"), _empty_null(F.lower("x.spanId")).alias("span_id"), _empty_null(F.col("scope.name")).alias("scope"),
        attrs_to_json(F.col("r")).alias("resource"), attrs_to_json(F.col("a")).alias("attributes"), r["unknown_service"].alias("unknown_service"),
        F.when(_out(time) | _out(observed), OUT_OF_RANGE).when(own == 0, NO_LOG_TIME).alias("reject_reason"),
    )


def _rfc3339_nano(ns: Column) -> Column:
    """UTC time text with the fraction's trailing zeros cut."""
    whole = F.floor(ns.cast("decimal(38,0)") / 1_000_000_000).cast("long")
    fraction = F.rtrim(F.lpad((ns - whole * F.lit(1_000_000_000)).cast("long").cast("string"), 9, "0"), F.lit("0"))
    day, second = F.floor(whole / 86_400), F.pmod(whole, F.lit(86_400))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(F.pmod(second, F.lit(3600)) / 60)), two(F.pmod(second, F.lit(60))))
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), clock, F.when(F.length(fraction) > 0, F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def _list_json(items: Column, fields) -> Column:
    """A JSON array of objects; fields(x) gives (name, JSON text or null: left out)."""
    def one(x: Column) -> Column:
        parts = [F.when(t.isNotNull(), F.concat(F.lit(f'"{n}":'), t)) for n, t in fields(x)]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    return F.when(F.size(items) > 0, F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]")))


def span_events_json(events: Column) -> Column:
    ns = lambda e: F.coalesce(e["timeUnixNano"], F.lit(0))
    return _list_json(events, lambda e: [("ts", F.when((ns(e) > 0) & (ns(e) <= MAX_NS), _quoted(_rfc3339_nano(ns(e))))), ("name", _quoted(F.coalesce(e["name"], F.lit("")))), ("attributes", attrs_to_json(e["attributes"]))])


def span_links_json(links: Column) -> Column:
    return _list_json(links, lambda k: [("trace_id", _quoted(F.lower(k["traceId"]))), ("span_id", _quoted(F.lower(k["spanId"]))), ("attributes", attrs_to_json(k["attributes"]))])


def flatten_spans(exports: DataFrame, nested: bool = True) -> DataFrame:
    """One row per span; the first reason that applies rejects it."""
    rows = _records(exports, "resourceSpans", "scopeSpans", "spans", nested).withColumns({"a": F.col("x.attributes"), "ev": F.col("x.events"), "li": F.col("x.links")})
    rows = flatten_nested_in(flatten_nested_in(flatten_nested(rows, "a"), "ev"), "li") if nested else rows
    start, end = F.coalesce(F.col("x.startTimeUnixNano"), F.lit(0)), F.coalesce(F.col("x.endTimeUnixNano"), F.lit(0))
    trace, span = F.coalesce(F.lower("x.traceId"), F.lit("")), F.coalesce(F.lower("x.spanId"), F.lit(""))
    until = F.when(end > 0, end).otherwise(start)
    late_event = F.coalesce(F.exists("x.events", lambda e: _out(e["timeUnixNano"])), F.lit(False))
    reasons = zip(SPAN_REASONS, (F.length(trace) != 32, F.length(span) != 16, F.ltrim(trace, F.lit("0")) == "", F.ltrim(span, F.lit("0")) == "", start == 0), strict=True)
    reject = F.lit(None).cast("string")
    for text, bad in [*reasons, (OUT_OF_RANGE, _out(start) | _out(end) | late_event)][::-1]:
        reject = F.when(bad, text).otherwise(reject)
    r = _resource_columns(F.col("r"))
    return rows.select(
        "request_id", _time(start).alias("ts"), _time(until).alias("end_ts"), "project", r["service"].alias("service"), r["environment"].alias("environment"), r["version"].alias("version"),
        trace.alias("trace_id"), span.alias("span_id"), _empty_null(F.lower("x.parentSpanId")).alias("parent_span_id"), F.coalesce("x.name", F.lit("")).alias("name"),
        F.coalesce("x.kind", F.lit(0)).cast("short").alias("kind"), F.coalesce("x.status.code", F.lit(0)).cast("short").alias("status_code"), _empty_null(F.col("x.status.message")).alias("status_message"),
        F.greatest(until - start, F.lit(0)).cast("long").alias("duration_ns"), _empty_null(F.col("scope.name")).alias("scope"), attrs_to_json(F.col("r")).alias("resource"),
        attrs_to_json(F.col("a")).alias("attributes"), span_events_json(F.col("ev")).alias("events"), span_links_json(F.col("li")).alias("links"),
        r["unknown_service"].alias("unknown_service"), reject.alias("reject_reason"),
    )


def series_hash(*fields: Column) -> Column:
    """Identity of a series. Each field is preceded by its length, so that field borders cannot shift; null counts as ''."""
    texts = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.xxhash64(*(x for t in texts for x in (F.length(t), t)))


def flatten_metrics(exports: DataFrame, nested: bool = True) -> DataFrame:
    """One row per data point of gauges, sums and explicit histograms, and one rejected row per point of other kinds.

    Points flagged as without a recorded value are skipped and not counted.
    """
    rows = _records(exports, "resourceMetrics", "scopeMetrics", "metrics", nested).withColumn("sa", F.col("scope.attributes"))
    rows = flatten_nested(rows, "sa") if nested else rows
    named = F.coalesce("x.name", F.lit("")) != ""
    none = F.lit(None)

    def temporal(data: str) -> Column:
        return ~F.coalesce(F.col(f"x.{data}.aggregationTemporality").isin(tel.DELTA, tel.CUMULATIVE), F.lit(False))

    def points(data: str, kind: int, reject: Column, temporality: Column, monotonic: Column) -> DataFrame:
        own = rows.where(F.col(f"x.{data}").isNotNull())
        own = own.select("*", F.explode(f"x.{data}.dataPoints").alias("p"), F.lit(kind).cast("short").alias("type"), temporality.cast("short").alias("temporality"), monotonic.cast("boolean").alias("monotonic"), reject.alias("_why"))
        own = own.where(F.pmod(F.coalesce("p.flags", F.lit(0)), F.lit(2)) == 0)
        own = own.withColumn("a", F.col("p.attributes"))
        own = flatten_nested(own, "a") if nested else own
        time, start = F.coalesce(F.col("p.timeUnixNano"), F.lit(0)), F.coalesce(F.col("p.startTimeUnixNano"), F.lit(0))
        when = F.when(_out(time) | _out(start), OUT_OF_RANGE).when(time == 0, REASONS["no_time"])
        if kind == tel.HISTOGRAM:
            counts, bounds = F.coalesce("p.bucketCounts", F.array().cast("array<bigint>")), F.coalesce("p.explicitBounds", F.array().cast("array<double>"))
            last = F.when((F.size(counts) > 0) & (F.size(counts) != F.size(bounds) + 1), REASONS["buckets"])
            values = {"value_int": none.cast("long"), "value_double": none.cast("double"), "count": F.coalesce("p.count", F.lit(0)).cast("long"), "sum": F.col("p.sum"), "min": F.col("p.min"), "max": F.col("p.max"),
                      "bucket_counts": F.when(F.size(counts) > 0, counts), "bucket_bounds": F.when(F.size(counts) > 0, bounds)}
        else:
            last = F.when(F.col("p.asInt").isNull() & F.col("p.asDouble").isNull(), REASONS["no_value"])
            values = {"value_int": F.col("p.asInt"), "value_double": F.when(F.col("p.asInt").isNull(), F.col("p.asDouble")), "count": none.cast("long"), "sum": none.cast("double"), "min": none.cast("double"), "max": none.cast("double"),
                      "bucket_counts": none.cast("array<bigint>"), "bucket_bounds": none.cast("array<double>")}
        r = _resource_columns(F.col("r"))
        resource, attributes = attrs_to_json(F.col("r")), attrs_to_json(F.col("a"))
        identity = series_hash(F.col("project"), F.col("x.name"), F.col("type"), F.col("temporality"), F.col("monotonic"), F.col("x.unit"), F.col("scope.name"), F.col("scope.version"), attrs_to_json(F.col("sa")), resource, attributes)
        return own.select(
            "request_id", _time(time).alias("ts"), _time(start).alias("start_ts"), "project", r["service"].alias("service"), r["environment"].alias("environment"), r["version"].alias("version"),
            F.col("x.name").alias("name"), _empty_null(F.col("x.unit")).alias("unit"), "type", "temporality", "monotonic", identity.alias("series_hash"), resource.alias("resource"), attributes.alias("attributes"),
            *(v.alias(k) for k, v in values.items()), r["unknown_service"].alias("unknown_service"), F.coalesce("_why", when, last).alias("reject_reason"),
        )

    no_name = F.when(~named, REASONS["no_name"])
    sum_t = F.col("x.sum.aggregationTemporality")
    up_down = (sum_t == tel.DELTA) & ~F.coalesce("x.sum.isMonotonic", F.lit(False))
    gauges = points("gauge", tel.GAUGE, no_name, F.lit(0), F.lit(False))
    sums = points("sum", tel.SUM, no_name.when(temporal("sum"), REASONS["sum_temporality"]).when(up_down, REASONS["delta_up_down"]), sum_t, F.coalesce("x.sum.isMonotonic", F.lit(False)))
    histograms = points("histogram", tel.HISTOGRAM, no_name.when(temporal("histogram"), REASONS["histogram_temporality"]), F.col("x.histogram.aggregationTemporality"), F.lit(False))
    out = gauges.unionByName(sums).unionByName(histograms)
    for data, reason in (("exponentialHistogram", "exponential"), ("summary", "summary")):
        other = rows.where(F.col(f"x.{data}").isNotNull()).select("request_id", "project", F.col("x.name").alias("name"), F.explode(f"x.{data}.dataPoints").alias("p"), F.lit(REASONS[reason]).alias("reject_reason"))
        out = out.unionByName(other.drop("p"), allowMissingColumns=True)
    return out


FLATTEN = {"logs": flatten_logs, "spans": flatten_spans, "metric_points": flatten_metrics}


def accepted(flat: DataFrame) -> DataFrame:
    """The rows to store: no reject reason; without the bookkeeping columns."""
    return flat.where(F.col("reject_reason").isNull()).drop("request_id", "unknown_service", "reject_reason")


def reject_summary(flat: DataFrame) -> DataFrame:
    """Per request: rows rejected, by reason, and kept rows whose service is unknown."""
    return flat.groupBy("request_id", "reject_reason").agg(F.count("*").alias("rows"), F.count_if(F.col("unknown_service") & F.col("reject_reason").isNull()).alias("unknown_service"))
