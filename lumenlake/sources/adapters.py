"""Telemetry projections of the driver's tables, and the same projections as DuckDB SQL.

events gives logs, spans and gauge, counter and histogram points; orders and lineitem give spans with
natural duplicates.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: dict[tuple[str, str, str], DataFrame] = {}


def once(f):
    """One DataFrame per session and table folder: its plan is analysed once, not for every query that starts from it."""

    @wraps(f)
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f.__name__)
        if key not in _made or _made[key].sparkSession is not spark:
            _made[key] = f(spark, sf_dir)
        return _made[key]

    return made


BOUNDS, OTHER_BOUNDS = (10.0, 50.0, 100.0), (5.0, 50.0, 100.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({
        "ingest_ts": F.timestamp_micros(F.lit(1_706_745_600_000_000) + F.col("event_id")),
        "project": F.when(F.col("user_id") % 10 == 0, "p2").otherwise("p1"),
        "service": F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")),
        "environment": F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 2 == 0, "prod").otherwise("staging"),
    })


_EVENTS_SQL = """e AS (SELECT *, TIMESTAMP '2024-02-01' + to_microseconds(event_id) AS ingest_ts, CASE WHEN user_id % 10 = 0 THEN 'p2' ELSE 'p1' END AS project,
  'svc-' || (user_id % 5) AS service, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'prod' ELSE 'staging' END AS environment FROM events)"""


def _code(values: dict[str, int]):
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(F.col("event_type") == k, v).otherwise(out)
    return out.cast("short")


@once
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    none = F.lit(None).cast("string")
    return e.select(
        "ts", F.lit(None).cast("timestamp").alias("observed_ts"), "ingest_ts", "project", "service", "environment", none.alias("version"),
        _code({"error": 17, "purchase": 13, "signup": 9, "click": 5, "view": 1}).alias("severity_number"), F.upper("event_type").alias("severity_text"),
        F.concat("event_type", F.lit(" by user "), F.col("user_id").cast("string")).alias("body"), F.md5(F.concat(F.lit("t"), F.floor(F.col("event_id") / 5).cast("string"))).alias("trace_id"),
        none.alias("span_id"), none.alias("scope"), none.alias("resource"), F.col("props").alias("attributes"),
    )


LOGS_SQL = f"""{_EVENTS_SQL},
logs AS (SELECT ts, ingest_ts, project, service, environment, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 WHEN 'signup' THEN 9 WHEN 'click' THEN 5 WHEN 'view' THEN 1 ELSE 0 END AS severity_number,
  event_type || ' by user ' || user_id AS body, md5('t' || (event_id // 5)) AS trace_id, props AS attributes FROM e)"""


@once
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five events make a trace: each is the child of the one before; some name a parent that is absent."""
    e = _events(spark, sf_dir)
    sid = lambda n: F.substring(F.md5(F.concat(F.lit("s"), n.cast("string"))), 1, 16)
    none = F.lit(None).cast("string")
    n, us = F.col("event_id"), F.round(F.col("value") * 1000).cast("long")
    parent = F.when(n % 5 == 0, none).when(n % 35 == 3, F.lit("f" * 16)).otherwise(sid(n - F.when(n % 5 == 4, 2).otherwise(1)))
    links = F.when(n % 11 == 0, F.concat(F.lit('[{"trace_id":"'), F.md5(F.concat(F.lit("t"), F.floor((n + 5) / 5).cast("string"))), F.lit('","span_id":"'), sid(n + 5), F.lit('"}]')))
    return e.select(
        "ts", F.timestamp_micros(F.unix_micros("ts") + us).alias("end_ts"), "ingest_ts", "project", "service", "environment", none.alias("version"),
        F.md5(F.concat(F.lit("t"), F.floor(n / 5).cast("string"))).alias("trace_id"), sid(n).alias("span_id"), parent.alias("parent_span_id"), F.col("event_type").alias("name"),
        (n % 5 + 1).cast("short").alias("kind"), _code({"error": 2, "purchase": 1}).alias("status_code"), none.alias("status_message"), (us * 1000).alias("duration_ns"),
        none.alias("scope"), none.alias("resource"), F.col("props").alias("attributes"), none.alias("events"), links.alias("links"),
    )


SPANS_SQL = f"""{_EVENTS_SQL},
spans AS (SELECT ts, ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS end_ts, ingest_ts, project, service, environment, md5('t' || (event_id // 5)) AS trace_id, substr(md5('s' || event_id), 1, 16) AS span_id,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 35 = 3 THEN 'ffffffffffffffff' ELSE substr(md5('s' || (event_id - CASE WHEN event_id % 5 = 4 THEN 2 ELSE 1 END)), 1, 16) END AS parent_span_id,
  event_type AS name, event_id % 5 + 1 AS kind, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS status_code, CAST(round(value * 1000) AS BIGINT) * 1000 AS duration_ns, props AS attributes,
  CASE WHEN event_id % 11 = 0 THEN md5('t' || ((event_id + 5) // 5)) END AS link_trace, CASE WHEN event_id % 11 = 0 THEN substr(md5('s' || (event_id + 5)), 1, 16) END AS link_span FROM e)"""


@once
def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per order: the order is the root, its line items are children; line numbers repeat, so span ids do."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    none = F.lit(None).cast("string")
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    o_key, l_key = F.col("o_orderkey").cast("string"), F.col("l_orderkey").cast("string")
    trace = lambda k: F.md5(F.concat(F.lit("o"), k))
    roots = o.select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("p1").alias("project"), F.concat(F.lit("order-"), F.col("o_orderstatus")).alias("service"), trace(o_key).alias("trace_id"), F.concat(F.lit("o"), o_key).alias("span_id"), none.alias("parent_span_id"), F.lit("order").alias("name"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("duration_ns"))
    items = li.select(F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("p1").alias("project"), F.concat(F.lit("ship-"), F.col("l_returnflag")).alias("service"), trace(l_key).alias("trace_id"), F.concat(F.lit("l"), l_key, F.lit("-"), F.col("l_linenumber").cast("string")).alias("span_id"), F.concat(F.lit("o"), l_key).alias("parent_span_id"), F.lit("item").alias("name"), F.round(F.col("l_extendedprice") * 1000).cast("long").alias("duration_ns"))
    both = roots.unionByName(items)
    return both.withColumns({"end_ts": F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("duration_ns") / 1000)), "ingest_ts": F.col("ts"), "status_code": F.lit(0).cast("short"), "kind": F.lit(1).cast("short")})


ORDER_SPANS_SQL = """spans AS (
  SELECT o_orderdate AS ts, 'p1' AS project, 'order-' || o_orderstatus AS service, md5('o' || o_orderkey) AS trace_id, 'o' || o_orderkey AS span_id, CAST(NULL AS VARCHAR) AS parent_span_id, 'order' AS name, CAST(round(o_totalprice * 1000) AS BIGINT) AS duration_ns FROM orders
  UNION ALL SELECT l_shipdate, 'p1', 'ship-' || l_returnflag, md5('o' || l_orderkey), 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, 'item', CAST(round(l_extendedprice * 1000) AS BIGINT) FROM lineitem)"""


def _points(rows: DataFrame, name: str, kind: int, temporality: int, monotonic: bool, unit: str = "1") -> DataFrame:
    return rows.withColumns({"name": F.lit(name), "unit": F.lit(unit), "type": F.lit(kind).cast("short"), "temporality": F.lit(temporality).cast("short"), "monotonic": F.lit(monotonic), "version": F.lit(None).cast("string"), "resource": F.lit(None).cast("string"), "min": F.lit(None).cast("double"), "max": F.lit(None).cast("double")})


_POINT_COLUMNS = ("ts", "start_ts", "ingest_ts", "project", "service", "environment", "version", "name", "unit", "type", "temporality", "monotonic", "series_hash", "resource", "attributes", "value_int", "value_double", "count", "sum", "min", "max", "bucket_counts", "bucket_bounds")


def _filled(rows: DataFrame) -> DataFrame:
    kinds = {"value_int": "long", "value_double": "double", "count": "long", "sum": "double", "bucket_counts": "array<bigint>", "bucket_bounds": "array<double>"}
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns}).select(*_POINT_COLUMNS)


@once
def gauge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event.value: one series per user."""
    e = _events(spark, sf_dir).withColumns({"start_ts": F.lit(None).cast("timestamp"), "series_hash": F.col("user_id"), "value_double": F.col("value"), "attributes": F.concat(F.lit('{"kind":"'), F.col("event_type"), F.lit('"}'))})
    return _filled(_points(e, "event.value", 1, 0, False).withColumn("value_double", F.col("value")))


GAUGE_SQL = f"""{_EVENTS_SQL}, points AS (SELECT ts, ingest_ts, project, service, environment, user_id AS series, value AS v, event_type AS kind FROM e)"""


@once
def counter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.total: each user's running count, which starts over after every seventh event (the value falls)."""
    e = _events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = e.withColumns({"start_ts": F.timestamp_micros(F.lit(1_700_000_000_000_000)), "series_hash": F.col("user_id"), "value_int": (n % 7 + 1).cast("long"), "attributes": F.lit(None).cast("string")})
    return _filled(_points(e, "events.total", 2, 2, True))


COUNTER_SQL = f"""{_EVENTS_SQL}, points AS (SELECT ts, ingest_ts, project, service, environment, user_id AS series, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 7 + 1 AS v FROM e)"""


@once
def histogram_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event.size: each user's running bucket counts, count and sum of value; every seventh user has other bounds."""
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.when(F.col("user_id") % 7 == 0, OTHER_BOUNDS[0]).otherwise(BOUNDS[0])
    v = F.col("value")
    inside = (v <= low, (v > low) & (v <= 50), (v > 50) & (v <= 100), v > 100)
    e = e.withColumns({
        "start_ts": F.timestamp_micros(F.lit(1_700_000_000_000_000)), "series_hash": F.col("user_id"), "attributes": F.lit(None).cast("string"), "count": F.count("*").over(w), "sum": F.sum("value").over(w),
        "bucket_counts": F.array(*(F.sum(F.when(c, 1).otherwise(0)).over(w).cast("long") for c in inside)), "bucket_bounds": F.array(low, F.lit(50.0), F.lit(100.0)),
    })
    return _filled(_points(e, "event.size", 3, 2, False))


HISTOGRAM_SQL = f"""{_EVENTS_SQL}, points AS (SELECT ts, ingest_ts, event_id, project, service, environment, user_id AS series, value AS v, CASE WHEN user_id % 7 = 0 THEN 5.0 ELSE 10.0 END AS low,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM e)"""


@once
def all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauge_points(spark, sf_dir).unionByName(counter_points(spark, sf_dir)).unionByName(histogram_points(spark, sf_dir))


@once
def log_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested log exports: fifty events make a request; a request has one resource per service. Some records have only the
    observed time, some none at all, and one service sends no name."""
    e = _events(spark, sf_dir)
    text = lambda v: F.struct(v.cast("string").alias("stringValue"), F.lit(None).cast("boolean").alias("boolValue"), F.lit(None).cast("long").alias("intValue"), F.lit(None).cast("double").alias("doubleValue"), F.lit(None).cast("binary").alias("bytesValue"), F.lit(None).cast("string").alias("arrayValue"), F.lit(None).cast("string").alias("kvlistValue"))
    number = lambda v: text(F.lit(None)).withField("intValue", v.cast("long"))
    ns = (F.unix_micros("ts") * 1000).cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    record = F.struct(
        F.when(F.col("event_id") % 9 < 2, zero).otherwise(ns).alias("timeUnixNano"), F.when(F.col("event_id") % 9 == 0, zero).otherwise(ns).alias("observedTimeUnixNano"),
        _code({"error": 17, "purchase": 13, "signup": 9, "click": 5, "view": 1}).cast("int").alias("severityNumber"), F.upper("event_type").alias("severityText"), text(F.col("event_type")).alias("body"),
        F.md5(F.concat(F.lit("t"), F.floor(F.col("event_id") / 5).cast("string"))).alias("traceId"), F.lit("").alias("spanId"),
        F.array(F.struct(F.lit("user").alias("key"), number(F.col("user_id")).alias("value")), F.struct(F.lit("kind").alias("key"), text(F.col("event_type")).alias("value"))).alias("attributes"),
    )
    named = F.when(F.col("service") == "svc-4", F.array().cast("array<struct<key:string,value:struct<stringValue:string,boolValue:boolean,intValue:bigint,doubleValue:double,bytesValue:binary,arrayValue:string,kvlistValue:string>>>")).otherwise(F.array(F.struct(F.lit("service.name").alias("key"), text(F.col("service")).alias("value"))))
    per_service = e.withColumn("request_id", F.floor(F.col("event_id") / 50).cast("long")).groupBy("request_id", "service").agg(F.array_sort(F.collect_list(record)).alias("logRecords"), F.first(named).alias("attrs"))
    scope = F.struct(F.lit("app").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast(_attribute_type()).alias("attributes"))
    one = F.struct(F.struct(F.col("attrs").alias("attributes")).alias("resource"), F.array(F.struct(scope.alias("scope"), F.col("logRecords"))).alias("scopeLogs"))
    return per_service.groupBy("request_id").agg(F.collect_list(one).alias("resourceLogs")).select("request_id", F.lit("p1").alias("project"), "resourceLogs")


def _attribute_type() -> str:
    from lumenlake.schema import ATTRIBUTES

    return ATTRIBUTES.simpleString()


def _empty_value():
    from lumenlake.schema import VALUE

    return F.lit(None).cast(VALUE.simpleString())


def _value(**kinds):
    """A value struct with the given fields set."""
    from lumenlake.schema import VALUE

    return F.struct(*((kinds[f.name].cast(f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name) for f in VALUE))


def _attrs(**pairs):
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()))


def _resources(rows: DataFrame, items: str, outer: str, inner: str) -> DataFrame:
    """rows(request_id, service, item) to exports with one resource per service."""
    from lumenlake.schema import ATTRIBUTES

    per = rows.groupBy("request_id", "service").agg(F.collect_list("item").alias(items))
    scope = F.struct(F.lit("app").alias("name"), F.lit("1").alias("version"), F.lit(None).cast(ATTRIBUTES.simpleString()).alias("attributes"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), _value(stringValue=F.col("service")).alias("value"))).alias("attributes"))
    one = F.struct(resource.alias("resource"), F.array(F.struct(scope.alias("scope"), F.col(items))).alias(inner))
    return per.groupBy("request_id").agg(F.collect_list(one).alias(outer)).select("request_id", F.lit("p1").alias("project"), outer)


@once
def span_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested span exports; ids of every 13th span are too short and every 17th has no start time."""
    from lumenlake.schema import SPAN

    e = _events(spark, sf_dir)
    n = F.col("event_id")
    start = (F.unix_micros("ts") * 1000).cast("decimal(20,0)")
    kinds = {f.name: f.dataType for f in SPAN}
    span = {
        "traceId": F.when(n % 13 == 0, F.lit("ab")).otherwise(F.md5(F.concat(F.lit("t"), F.floor(n / 5).cast("string")))), "spanId": F.upper(F.substring(F.md5(F.concat(F.lit("s"), n.cast("string"))), 1, 16)),
        "name": F.col("event_type"), "kind": (n % 5 + 1).cast("int"), "startTimeUnixNano": F.when(n % 17 == 0, F.lit(0).cast("decimal(20,0)")).otherwise(start),
        "endTimeUnixNano": start + (F.round(F.col("value") * 1000).cast("long") * 1000).cast("decimal(20,0)"), "attributes": _attrs(user=_value(intValue=F.col("user_id")), rate=_value(doubleValue=F.lit(0.5))),
        "events": F.array(F.struct((start + 1500).cast("decimal(20,0)").alias("timeUnixNano"), F.lit("tick").alias("name"), F.lit(None).cast(kinds["attributes"].simpleString()).alias("attributes"))),
    }
    item = F.struct(*(span[k].cast(t).alias(k) if k in span else F.lit(None).cast(t).alias(k) for k, t in kinds.items()))
    return _resources(e.select(F.floor(n / 50).cast("long").alias("request_id"), "service", item.alias("item")), "spans", "resourceSpans", "scopeSpans")


@once
def metric_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metric exports: each event is a gauge, a counter, a histogram or a kind that is not taken, by event_id % 5."""
    from lumenlake.schema import METRIC

    e = _events(spark, sf_dir)
    n, ns = F.col("event_id"), (F.unix_micros("ts") * 1000).cast("decimal(20,0)")
    kinds = {f.name: f.dataType for f in METRIC}

    def filled(kind, **values):
        return F.struct(*((values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind))

    number, histo = kinds["gauge"]["dataPoints"].dataType.elementType, kinds["histogram"]["dataPoints"].dataType.elementType
    attributes = _attrs(user=_value(intValue=F.col("user_id")))
    gauge = filled(kinds["gauge"], dataPoints=F.array(filled(number, timeUnixNano=ns, attributes=attributes, asDouble=F.col("value"))))
    total = filled(kinds["sum"], dataPoints=F.array(filled(number, timeUnixNano=ns, startTimeUnixNano=ns - 1000, attributes=attributes, asInt=F.col("user_id"))), aggregationTemporality=F.when(n % 15 == 1, 0).otherwise(2), isMonotonic=F.lit(True))
    buckets = F.when(n % 10 == 2, F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1), F.lit(2)))
    histogram = filled(kinds["histogram"], dataPoints=F.array(filled(histo, timeUnixNano=ns, attributes=attributes, count=F.lit(3), sum=F.col("value"), bucketCounts=buckets, explicitBounds=F.array(F.lit(10.0)))), aggregationTemporality=F.lit(2))
    summary = filled(kinds["summary"], dataPoints=F.array(filled(kinds["summary"]["dataPoints"].dataType.elementType, timeUnixNano=ns)))
    pick = {"gauge": (gauge, (0, 4)), "sum": (total, (1,)), "histogram": (histogram, (2,)), "summary": (summary, (3,))}
    values = {k: F.when((n % 5).isin(*on), v) for k, (v, on) in pick.items()}
    names = F.when(n % 5 == 0, "event.value").when(n % 5 == 1, "events.total").when(n % 5 == 2, "event.size").when(n % 5 == 3, "event.summary").otherwise(F.lit(""))
    item = filled(METRIC, name=names, unit=F.lit("1"), **values)
    return _resources(e.select(F.floor(n / 50).cast("long").alias("request_id"), "service", item.alias("item")), "metrics", "resourceMetrics", "scopeMetrics")
