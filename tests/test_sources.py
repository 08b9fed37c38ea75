import json
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.operators.search import Search
from lumenlake.sources import lake, otlp
from lumenlake.streaming import ingest
from tests.data import H0, H1, H2, logs, points, spans

HOUR = timedelta(hours=1)


def value(**kinds):
    return {f.name: kinds.get(f.name) for f in schema.VALUE}


def attrs(**pairs):
    return [{"key": k.replace("__", "."), "value": v} for k, v in pairs.items()]


def ns(t):
    return Decimal(int((t - H0).total_seconds() * 1_000_000) + 1_790_812_800_000_000) * 1000  # H0 is 2026-10-01


def exports(spark, kind, outer, inner, items, records, resource=None, request_id=1):
    shape = schema.EXPORTS[kind]
    row = {"request_id": request_id, "project": "p1", outer: [{"resource": {"attributes": resource or []}, inner: [{"scope": {"name": "app", "version": None, "attributes": None}, items: records}]}]}
    return spark.createDataFrame([row], shape)


def log(time=None, observed=None, body=None, attributes=None):
    return {"timeUnixNano": time, "observedTimeUnixNano": observed, "severityNumber": 9, "severityText": "INFO", "body": body, "traceId": "AB" * 16, "spanId": "", "attributes": attributes}


def flat_logs(spark, records, resource=None):
    return otlp.flatten_logs(exports(spark, "logs", "resourceLogs", "scopeLogs", "logRecords", records, resource)).collect()


def test_log_times_and_resources(spark):
    got = flat_logs(spark, [log(ns(H0)), log(None, ns(H1)), log(), log(Decimal(2**63))])
    assert [r["ts"] for r in got] == [H0, H1, None, None] and got[1]["observed_ts"] == H1
    assert [r["reject_reason"] for r in got] == [None, None, otlp.NO_LOG_TIME, otlp.OUT_OF_RANGE]
    assert got[0]["service"] == "unknown_service" and got[0]["unknown_service"] and got[0]["environment"] == "default" and got[0]["resource"] is None and got[0]["trace_id"] == "ab" * 16 and got[0]["span_id"] is None
    text = lambda v: value(stringValue=v)
    one = flat_logs(spark, [log(ns(H0))], attrs(service__name=text("old"), deployment__environment=text("stage")) + attrs(service__name=text("api"), service__version=text("1.2")))[0]
    assert (one["service"], one["environment"], one["version"]) == ("api", "stage", "1.2")
    two = flat_logs(spark, [log(ns(H0))], attrs(deployment__environment=text("stage"), deployment__environment__name=text("prod"), service__name=value(intValue=3)))[0]
    assert (two["service"], two["environment"]) == ("unknown_service", "prod")


def test_attribute_values_and_bodies(spark):
    nested = value(kvlistValue=json.dumps([{"key": "z", "value": {"stringValue": "<&>"}}, {"key": "a", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "1"}]}}}]))
    given = attrs(s=value(stringValue='x"y'), i=value(intValue=42), d=value(doubleValue=1.5), b=value(boolValue=True), raw=value(bytesValue=b"hi"), nan=value(doubleValue=float("nan")), inf=value(doubleValue=float("-inf")), empty=value(), n=nested,
                  list=value(arrayValue=json.dumps([{"stringValue": "a"}, {"intValue": 1}, {}]))) + attrs(i=value(intValue=43))
    got = flat_logs(spark, [log(ns(H0), body=value(stringValue="text"), attributes=given), log(ns(H0), body=value(intValue=7)), log(ns(H0), body=nested), log(ns(H0))])
    assert json.loads(got[0]["attributes"]) == {"s": 'x"y', "i": 43, "d": 1.5, "b": True, "raw": "aGk=", "nan": "NaN", "inf": "-Inf", "empty": None, "n": {"a": ["a", 1], "z": "<&>"}, "list": ["a", 1, None]}
    assert list(json.loads(got[0]["attributes"])) == sorted(json.loads(got[0]["attributes"]))
    assert got[0]["body"] == "text" and got[1]["body"] == "7" and json.loads(got[2]["body"]) == {"a": ["a", 1], "z": "<&>"} and got[3]["body"] is None and got[3]["attributes"] is None


def span(trace="ab" * 16, sid="cd" * 8, start=ns(H0), end=None, events=None, links=None):
    return {"traceId": trace, "spanId": sid, "parentSpanId": "", "name": "n", "kind": 2, "startTimeUnixNano": start, "endTimeUnixNano": end, "attributes": None, "status": {"code": 2, "message": ""}, "events": events, "links": links}


def test_span_checks_and_lists(spark):
    event = {"timeUnixNano": ns(H0) + 1500, "name": "e", "attributes": attrs(k=value(intValue=1))}
    records = [
        span("AB"), span(sid="cd"), span("0" * 32), span(sid="0" * 16), span(start=None), span(start=Decimal(2**63)), span(events=[{"timeUnixNano": Decimal(2**63), "name": "x", "attributes": None}]),
        span("AB" * 16, end=ns(H0) + 2500, events=[event, {"timeUnixNano": None, "name": "f", "attributes": None}], links=[{"traceId": "AB" * 16, "spanId": "EF" * 8, "attributes": None}]), span(end=ns(H0) - 5),
    ]
    got = otlp.flatten_spans(exports(spark, "spans", "resourceSpans", "scopeSpans", "spans", records)).collect()
    assert [r["reject_reason"] for r in got] == [*otlp.SPAN_REASONS, otlp.OUT_OF_RANGE, otlp.OUT_OF_RANGE, None, None]
    good = got[7]
    assert good["trace_id"] == "ab" * 16 and good["duration_ns"] == 2500 and good["end_ts"] - good["ts"] == timedelta(microseconds=2) and good["parent_span_id"] is None and good["status_code"] == 2
    assert json.loads(good["events"]) == [{"ts": "2026-10-01T00:00:00.0000015Z", "name": "e", "attributes": {"k": 1}}, {"name": "f"}]
    assert json.loads(good["links"]) == [{"trace_id": "ab" * 16, "span_id": "ef" * 8}]
    assert got[8]["duration_ns"] == 0 and got[8]["events"] is None and got[8]["links"] is None


def number(**more):
    return {"timeUnixNano": ns(H0), "startTimeUnixNano": None, "attributes": None, "asInt": 1, "asDouble": None, "flags": None} | more


def histo(**more):
    return {"timeUnixNano": ns(H0), "startTimeUnixNano": None, "attributes": None, "count": 3, "sum": 1.0, "min": None, "max": None, "bucketCounts": [1, 2], "explicitBounds": [10.0], "flags": None} | more


def metric(name="m", **data):
    return {"name": name, "unit": "1", "gauge": None, "sum": None, "histogram": None, "exponentialHistogram": None, "summary": None} | data


def test_metric_checks(spark):
    total = lambda pts, t=2, mono=True: {"dataPoints": pts, "aggregationTemporality": t, "isMonotonic": mono}
    records = [
        metric(gauge={"dataPoints": [number(), number(asInt=None, asDouble=2.5), number(asInt=None), number(timeUnixNano=None), number(timeUnixNano=Decimal(2**63)), number(flags=1)]}),
        metric("", gauge={"dataPoints": [number()]}), metric(sum=total([number()])), metric(sum=total([number()], 0)), metric(sum=total([number()], 1, False)), metric(sum=total([number()], 2, False)),
        metric(histogram={"dataPoints": [histo(), histo(bucketCounts=[1, 2, 3]), histo(bucketCounts=[], explicitBounds=[1.0]), histo(bucketCounts=[4], explicitBounds=None)], "aggregationTemporality": 2}),
        metric(histogram={"dataPoints": [histo()], "aggregationTemporality": None}), metric(exponentialHistogram={"dataPoints": [{"timeUnixNano": ns(H0)}] * 2}), metric("", summary={"dataPoints": [{"timeUnixNano": ns(H0)}]}),
    ]
    flat = otlp.flatten_metrics(exports(spark, "metric_points", "resourceMetrics", "scopeMetrics", "metrics", records))
    reasons = {}
    for r in flat.collect():
        reasons[r["reject_reason"]] = reasons.get(r["reject_reason"], 0) + 1
    R = otlp.REASONS
    assert reasons == {None: 7, R["no_value"]: 1, R["no_time"]: 1, otlp.OUT_OF_RANGE: 1, R["no_name"]: 1, R["sum_temporality"]: 1, R["delta_up_down"]: 1, R["buckets"]: 1, R["histogram_temporality"]: 1, R["exponential"]: 2, R["summary"]: 1}
    kept = otlp.accepted(flat)
    assert set(kept.columns) | {"ingest_ts"} == set(schema.POINTS.names)
    buckets = [(r["bucket_counts"], r["bucket_bounds"]) for r in kept.where("type = 3").collect()]
    assert sorted(buckets, key=str) == sorted([([1, 2], [10.0]), (None, None), ([4], [])], key=str)
    summary = {r["reject_reason"]: (r["rows"], r["unknown_service"]) for r in otlp.reject_summary(flat).collect()}
    assert summary[None] == (7, 7) and summary[R["exponential"]] == (2, 0)


def test_series_hash(spark):
    def of(*fields):
        return spark.range(1).select(otlp.series_hash(*map(F.lit, fields))).first()[0]

    assert of("a", "b") == of("a", "b") and of("a\0b", "c") != of("a", "b\0c") and of("ab", "c") != of("a", "bc") and of("a", None, "b") != of("a", "b", None) and of("p1") != of("p2")


def test_lake_round_trip_pruning_and_stats(spark, tmp_path):
    root = str(tmp_path)
    rows = logs(spark, [{"ts": H0 + timedelta(minutes=m), "body": str(i)} for m in range(180) for i in range(2)])
    lake.write_hours(rows, root, "logs")
    lake.write_hours(logs(spark, [{"ts": H0 + timedelta(minutes=5), "body": "late"}], ingest_ts=H0 + timedelta(days=3)), root, "logs")
    part = lake.scan_signal(spark, root, "logs", H0 + timedelta(minutes=30), H1 + timedelta(minutes=30))
    assert part.count() == 120 and part.columns == schema.LOGS.names
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "hour" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(ts" in plan
    assert lake.scan_signal(spark, root, "logs", H0, H0 + 3 * HOUR).count() == 361
    stats = lake.file_stats(spark, root, "logs").cache()
    assert stats.agg(F.sum("rows")).first()[0] == 361 and stats.count() == 4
    assert lake.files_for_range(stats, H1, H2).count() == 1
    report = lake.storage_report(stats)
    assert {r["hour"]: (r["files"], r["rows"]) for r in report.collect()} == {H0: (2, 121), H1: (1, 120), H2: (1, 120)}
    assert [r["hour"] for r in lake.closed_hours(rows, H0 + 3 * HOUR).orderBy("hour").collect()] == [H0, H1]
    assert lake.drop_hours(spark, root, report.where(F.col("hour") == F.lit(H0))) == 1
    assert lake.scan_signal(spark, root, "logs", H0, H0 + 3 * HOUR).count() == 240


def test_retention(spark):
    report = spark.createDataFrame([(s, H0 + i * HOUR, 1, 1000) for s in ("logs", "spans") for i in range(5)], "signal string, hour timestamp, files long, bytes long")
    age = lake.retention_by_age(report, {"logs": 1}, H0 + 26 * HOUR)
    assert sorted(r["hour"] for r in age.collect()) == [H0, H1] and {r["signal"] for r in age.collect()} == {"logs"}
    size = lake.retention_by_size(report, 4500)
    assert size.count() == 6 and report.join(size, ["signal", "hour"], "left_anti").agg(F.sum("bytes")).first()[0] == 4000
    out = {r["phase"]: (r["hours"], r["files"], r["bytes"]) for r in lake.retention_report(age, size).collect()}
    assert out == {"age": (2, 2, 2000), "size": (3, 6, 6000)}


def test_dedup(spark):
    def batch(ids, stamp, project="p1"):
        return spans(spark, [{"ts": H0, "trace_id": "t", "span_id": i, "name": stamp} for i in ids], project=project)

    first, second = batch("abc", "one"), batch("abcdee", "two")
    new = ingest.dedup_spans(second, first)
    assert sorted(r["span_id"] for r in new.collect()) == ["d", "e"]
    assert ingest.dedup_spans(batch("abc", "x", "p2"), first).count() == 3
    p = points(spark, [{"ts": H0, "start_ts": s, "series_hash": 1} for s in (None, H0, H1)])
    again = points(spark, [{"ts": H0, "start_ts": s, "series_hash": 1} for s in (None, H0, H1, H2, H2)] + [{"ts": H1, "start_ts": None, "series_hash": 1}])
    assert sorted((r["start_ts"] is None, r["ts"]) for r in ingest.dedup_points(again, p).collect()) == [(False, H0), (True, H1)]
    assert ingest.recent(first, H0 + HOUR).count() == 3 and ingest.recent(first, H0 + 2 * HOUR).count() == 0


def test_stream_is_idempotent_and_keeps_late_rows(spark, tmp_path):
    now = H0 + timedelta(minutes=30)
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    good = [span(sid=f"{i:016x}", start=ns(H0 + timedelta(minutes=i))) for i in range(1, 6)]
    exports(spark, "spans", "resourceSpans", "scopeSpans", "spans", good + [good[0], span("xx")]).write.json(f"{source}/1")
    run = lambda: ingest.stream_ingest(spark, f"{source}/*", root, "spans", str(tmp_path / "cp"), available_now=True, clock=lambda: now)
    query, stats = run()
    query.awaitTermination()
    assert (stats.accepted, stats.rejected, stats.duplicates, stats.unknown_service, stats.commits) == (5, 1, 1, 6, 1)
    exports(spark, "spans", "resourceSpans", "scopeSpans", "spans", good[:3] + [span(sid="f" * 16, start=ns(H0 - 5 * HOUR))]).write.json(f"{source}/2")
    query, stats = run()
    query.awaitTermination()
    assert (stats.accepted, stats.duplicates, stats.commits) == (6, 4, 2)  # counts survive the restart
    def stored():
        return lake.scan_signal(spark, root, "spans", H0 - 9 * HOUR, H0 + 9 * HOUR)

    before = sorted(r["span_id"] for r in stored().collect())
    assert len(before) == 6 and stored().select("ingest_ts").distinct().count() == 2
    again = ingest.Ingest(root, "spans", clock=lambda: now)  # the last batch runs once more after a failure
    again(spark.read.schema(schema.SPAN_EXPORT).json(f"{source}/2"), 1)
    assert sorted(r["span_id"] for r in stored().collect()) == before
    assert (again.stats.accepted, again.stats.rejected, again.stats.duplicates, again.stats.commits) == (6, 1, 4, 2)


def test_follow_shows_late_rows(spark, tmp_path):
    root, out = str(tmp_path / "lake"), str(tmp_path / "out")
    def step():
        show = lambda rows, epoch: rows.write.parquet(f"{out}/rows/epoch={epoch}")
        ingest.logs_follow(spark, root, Search("p1", H0, H0 + timedelta(days=1), level="info"), show, f"{out}/cp", available_now=True).awaitTermination()
        return sorted(r["body"] for r in spark.read.parquet(f"{out}/rows").collect())

    lake.write_hours(logs(spark, [{"ts": H1, "body": "a", "severity_number": 9}, {"ts": H1, "body": "quiet", "severity_number": 1}]), root, "logs")
    assert step() == ["a"]
    lake.write_hours(logs(spark, [{"ts": H0, "body": "late", "severity_number": 9}]), root, "logs")
    assert step() == ["a", "late"]


def test_a_large_hour_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).selectExpr("timestamp_micros(1790812800000000 + id * 50000) AS ts", "timestamp_micros(id) AS ingest_ts", "'p1' AS project", "md5(string(id)) AS body")  # 50 minutes
    for key, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")):
        spark.conf.set(key, value)
    try:
        lake.write_hours(rows.repartition(6), str(tmp_path / "split"), "logs")
    finally:
        for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"):
            spark.conf.unset(key)
    lake.write_hours(rows.repartition(6), str(tmp_path / "whole"), "logs")
    for name, few in (("split", False), ("whole", True)):
        back = spark.read.parquet(str(tmp_path / name / "logs"))
        assert back.count() == 60_000 and back.select("hour").distinct().count() == 1
        assert (len(back.inputFiles()) == 1) == few


def test_nested_values_in_attributes_events_and_links(spark):
    from lumenlake import schema

    value = lambda **v: tuple(v.get(f.name) for f in schema.VALUE)
    deep = '{"values":[{"stringValue":"x"},{"arrayValue":{"values":[{"intValue":"7"},{"boolValue":true}]}},{"kvlistValue":{"values":[{"key":"z","value":{"doubleValue":0.5}},{"key":"a","value":{}}]}}]}'
    plain, nested, pairs = ("p", value(stringValue="v")), ("n", value(arrayValue=deep)), ("k", value(kvlistValue='{"values":[{"key":"b","value":{"intValue":"1"}}]}'))
    want = '["x",[7,true],{"a":null,"z":0.5}]'

    def span(i, attributes, events, links):
        own = {"traceId": "a" * 32, "spanId": f"{i:016d}", "name": "s", "startTimeUnixNano": Decimal(10**18), "attributes": attributes, "events": events, "links": links}
        return tuple(own.get(f.name) for f in schema.SPAN)

    given = [
        span(1, [plain, nested], [(Decimal(10**18), "e0", [plain]), (Decimal(10**18), "e1", [nested, plain, pairs]), (Decimal(10**18), "e2", None)], [("b" * 32, "c" * 16, [pairs])]),
        span(2, [plain], [(Decimal(10**18), "only", [plain])], None), span(3, None, None, None), span(4, None, None, [("b" * 32, "c" * 16, None), ("b" * 32, "d" * 16, [nested])]),
    ]
    exports = spark.createDataFrame([(1, "p1", [((None,), [((None, None, None), given)])])], schema.EXPORTS["spans"])
    got = {int(r["span_id"]): r for r in otlp.flatten_spans(exports).collect()}
    time = '"ts":"2001-09-09T01:46:40Z"'
    assert got[1]["attributes"] == f'{{"n":{want},"p":"v"}}'
    assert got[1]["events"] == f'[{{{time},"name":"e0","attributes":{{"p":"v"}}}},{{{time},"name":"e1","attributes":{{"k":{{"b":1}},"n":{want},"p":"v"}}}},{{{time},"name":"e2"}}]'
    assert got[1]["links"] == f'[{{"trace_id":"{"b" * 32}","span_id":"{"c" * 16}","attributes":{{"k":{{"b":1}}}}}}]'
    assert got[2]["events"] == f'[{{{time},"name":"only","attributes":{{"p":"v"}}}}]' and got[2]["links"] is None and got[3]["attributes"] is None
    assert got[4]["links"] == f'[{{"trace_id":"{"b" * 32}","span_id":"{"c" * 16}"}},{{"trace_id":"{"b" * 32}","span_id":"{"d" * 16}","attributes":{{"n":{want}}}}}]'
