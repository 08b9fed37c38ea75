"""Fixed schemas of the three signals and of nested exports."""

from __future__ import annotations

from pyspark.sql import types as T

_TS, _S, _L, _D, _SH = T.TimestampType(), T.StringType(), T.LongType(), T.DoubleType(), T.ShortType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in ((*f, False)[:3] for f in fields)])


LOGS = _struct(
    ("ts", _TS, True), ("observed_ts", _TS), ("ingest_ts", _TS, True), ("project", _S, True), ("service", _S, True), ("environment", _S), ("version", _S),
    ("severity_number", _SH), ("severity_text", _S), ("body", _S), ("trace_id", _S), ("span_id", _S), ("scope", _S), ("resource", _S), ("attributes", _S),
)
SPANS = _struct(
    ("ts", _TS, True), ("end_ts", _TS, True), ("ingest_ts", _TS, True), ("project", _S, True), ("service", _S, True), ("environment", _S), ("version", _S),
    ("trace_id", _S, True), ("span_id", _S, True), ("parent_span_id", _S), ("name", _S, True), ("kind", _SH), ("status_code", _SH), ("status_message", _S),
    ("duration_ns", _L, True), ("scope", _S), ("resource", _S), ("attributes", _S), ("events", _S), ("links", _S),
)
POINTS = _struct(
    ("ts", _TS, True), ("start_ts", _TS), ("ingest_ts", _TS, True), ("project", _S, True), ("service", _S, True), ("environment", _S), ("version", _S),
    ("name", _S, True), ("unit", _S), ("type", _SH, True), ("temporality", _SH), ("monotonic", T.BooleanType()), ("series_hash", _L, True), ("resource", _S),
    ("attributes", _S), ("value_int", _L), ("value_double", _D), ("count", _L), ("sum", _D), ("min", _D), ("max", _D),
    ("bucket_counts", T.ArrayType(_L)), ("bucket_bounds", T.ArrayType(_D)),
)
SIGNALS = {"logs": LOGS, "spans": SPANS, "metric_points": POINTS}

# Nested exports: OTLP field names; 64-bit unsigned numbers as decimals, ids as hexadecimal text.
_UINT = T.DecimalType(20, 0)
#: A value: one of the fields is set; arrays and key-value lists come as JSON text of nested values.
VALUE = _struct(("stringValue", _S), ("boolValue", T.BooleanType()), ("intValue", _L), ("doubleValue", _D), ("bytesValue", T.BinaryType()), ("arrayValue", _S), ("kvlistValue", _S))
ATTRIBUTES = T.ArrayType(_struct(("key", _S), ("value", VALUE)))
_RESOURCE = _struct(("attributes", ATTRIBUTES))
_SCOPE = _struct(("name", _S), ("version", _S), ("attributes", ATTRIBUTES))


def _export(outer: str, inner: str, items: str, item: T.StructType) -> T.StructType:
    scopes = T.ArrayType(_struct(("scope", _SCOPE), (items, T.ArrayType(item))))
    return _struct(("request_id", _L), ("project", _S), (outer, T.ArrayType(_struct(("resource", _RESOURCE), (inner, scopes)))))


LOG_RECORD = _struct(("timeUnixNano", _UINT), ("observedTimeUnixNano", _UINT), ("severityNumber", T.IntegerType()), ("severityText", _S), ("body", VALUE), ("traceId", _S), ("spanId", _S), ("attributes", ATTRIBUTES))
SPAN = _struct(
    ("traceId", _S), ("spanId", _S), ("parentSpanId", _S), ("name", _S), ("kind", T.IntegerType()), ("startTimeUnixNano", _UINT), ("endTimeUnixNano", _UINT), ("attributes", ATTRIBUTES),
    ("status", _struct(("code", T.IntegerType()), ("message", _S))),
    ("events", T.ArrayType(_struct(("timeUnixNano", _UINT), ("name", _S), ("attributes", ATTRIBUTES)))),
    ("links", T.ArrayType(_struct(("traceId", _S), ("spanId", _S), ("attributes", ATTRIBUTES)))),
)
NUMBER_POINT = _struct(("timeUnixNano", _UINT), ("startTimeUnixNano", _UINT), ("attributes", ATTRIBUTES), ("asInt", _L), ("asDouble", _D), ("flags", _L))
HISTOGRAM_POINT = _struct(
    ("timeUnixNano", _UINT), ("startTimeUnixNano", _UINT), ("attributes", ATTRIBUTES), ("count", _L), ("sum", _D), ("min", _D), ("max", _D),
    ("bucketCounts", T.ArrayType(_L)), ("explicitBounds", T.ArrayType(_D)), ("flags", _L),
)
METRIC = _struct(
    ("name", _S), ("unit", _S), ("gauge", _struct(("dataPoints", T.ArrayType(NUMBER_POINT)))),
    ("sum", _struct(("dataPoints", T.ArrayType(NUMBER_POINT)), ("aggregationTemporality", T.IntegerType()), ("isMonotonic", T.BooleanType()))),
    ("histogram", _struct(("dataPoints", T.ArrayType(HISTOGRAM_POINT)), ("aggregationTemporality", T.IntegerType()))),
    ("exponentialHistogram", _struct(("dataPoints", T.ArrayType(_struct(("timeUnixNano", _UINT)))))),
    ("summary", _struct(("dataPoints", T.ArrayType(_struct(("timeUnixNano", _UINT)))))),
)
LOG_EXPORT = _export("resourceLogs", "scopeLogs", "logRecords", LOG_RECORD)
SPAN_EXPORT = _export("resourceSpans", "scopeSpans", "spans", SPAN)
METRIC_EXPORT = _export("resourceMetrics", "scopeMetrics", "metrics", METRIC)
EXPORTS = {"logs": LOG_EXPORT, "spans": SPAN_EXPORT, "metric_points": METRIC_EXPORT}
