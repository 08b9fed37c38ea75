from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel
from lumenlake.operators import catalog, metrics
from lumenlake.plans import panels
from lumenlake.plans.metric_query import MetricQuery, metric_query
from lumenlake.sources import lake
from tests.data import H0, H1, H2, minute, points

OLD = H1 - timedelta(hours=1)


@pytest.fixture(params=["memory", "lake"])
def store(request, tmp_path):
    """The rows as they are, and written to and read back from the lake."""

    def through(df):
        if request.param == "memory":
            return df
        lake.write_hours(df, str(tmp_path), "metric_points")
        return lake.scan_signal(df.sparkSession, str(tmp_path), "metric_points", H0 - timedelta(days=1), H0 + timedelta(days=2))

    return through


def values(df, start, end, aggregate, group_by=None, step_s=60, **more):
    result = metric_query(df, MetricQuery("m", "p1", minute(start), minute(end), aggregate, group_by, step_s, **more))
    out = {}
    for r in result.series.collect():
        out.setdefault(r["grp"], []).append(r["value"])
    return out


def counter(spark, given, start=OLD, **more):
    """given: (minute, value) or (minute, value, start)."""
    rows = []
    for m, v, *s in given:
        rows.append({"ts": minute(m), "start_ts": s[0] if s else start, ("value_double" if isinstance(v, float) else "value_int"): v} | more)
    return rows


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None) and (w is None or g == pytest.approx(w)), (got, want)


@pytest.mark.parametrize("cast", [int, float])
def test_reset_by_drop(spark, store, cast):
    df = store(points(spark, counter(spark, [(i, cast(v)) for i, v in enumerate((10, 20, 30, 5, 15))], minute(0))))
    near(values(df, 1, 5, "increase")[""], [10, 10, 5, 10])
    near(values(df, 1, 5, "rate")[""], [x / 60 for x in (10, 10, 5, 10)])


def test_reset_by_start(spark):
    rows = counter(spark, [(i, v) for i, v in enumerate((10, 20, 30, 5, 15))], minute(0))
    rows += counter(spark, [(0, 100), (1, 110), (2, 120, minute(1.5)), (3, 130, minute(1.5)), (4, 140, minute(1.5))], series_hash=2)
    near(values(points(spark, rows), 1, 5, "increase")[""], [20, 130, 15, 20])


def test_single_long_running_point_is_seeded(spark):
    near(values(points(spark, counter(spark, [(40, 50)])), 40, 42, "increase")[""], [None, None])


def test_new_series_counts_whole(spark):
    rows = counter(spark, [(2, 7, minute(1.5))]) + counter(spark, [(2, 50), (3, 60)], series_hash=2)
    near(values(points(spark, rows), 1, 4, "increase")[""], [None, 7, 10])


def test_replicas_delta_precision_and_mixed(spark):
    rows = counter(spark, [(i, 100 + 10 * i) for i in range(5)]) + counter(spark, [(i + 0.5, 1000 + 5 * i) for i in range(5)], series_hash=2)
    near(values(points(spark, rows), 1, 5, "increase")[""], [15, 15, 15, 15])
    near(values(points(spark, counter(spark, [(1, 3), (2, 4), (3, 5)], temporality=1)), 1, 4, "increase")[""], [3, 4, 5])
    near(values(points(spark, counter(spark, [(0, 2**53), (1, 2**53 + 1), (2, 2**53 + 3)])), 1, 3, "increase")[""], [1, 2])
    near(values(points(spark, counter(spark, [(0, 10), (1, 15.0), (2, 18), (3, 4.0)])), 1, 4, "increase")[""], [5, 3, 4])


def test_gauges_and_up_down(spark, store):
    rows = [{"ts": minute(m), "value_double": float(v), "series_hash": s} for s, m, v in ((10, 0, 1), (10, 0.5, 3), (10, 1, 5), (11, 0, 10), (11, 1.5, 20))]
    df = store(points(spark, rows, type=1, temporality=0, monotonic=False))
    for f, want in {"avg": [6, 12.5, None], "min": [1, 5, None], "max": [10, 20, None], "sum": [13, 25, None]}.items():
        near(values(df, 0, 3, f)[""], want)
    near(values(points(spark, counter(spark, [(0, 4), (1, 6)], monotonic=False)), 0, 2, "")[""], [4, 6])


def test_groups_rank_and_cap(spark):
    rows = []
    for s, (step, service, route) in enumerate(((1, "api", "/a"), (10, "worker", "/b"), (100, "api", None))):
        rows += counter(spark, [(i, step * i) for i in range(3)], series_hash=s, service=service, attributes=f'{{"route":"{route}"}}' if route else "{}")
    df = points(spark, rows)
    assert values(df, 1, 3, "increase", "service") == {"api": [101, 101], "worker": [10, 10]}
    assert list(values(df, 1, 3, "increase", "route").items()) == [("", [100, 100]), ("/b", [10, 10]), ("/a", [1, 1])]
    assert values(df, 1, 3, "increase") == {"": [111, 111]}
    many = points(spark, [{"ts": minute(0), "value_double": float(i), "series_hash": i, "attributes": f'{{"k":"{i:02d}"}}'} for i in range(25)], type=1, monotonic=False)
    result = metric_query(many, MetricQuery("m", "p1", minute(0), minute(1), "avg", "k", 60))
    groups = [r["grp"] for r in result.series.collect()]
    assert result.truncated.first()[0] and len(groups) == 20 and groups[0] == "24" and groups[-1] == "05"


def test_groups_without_deltas_stay(spark):
    rows = counter(spark, [(1, 10), (2, 20)], service="svc-01") + counter(spark, [(2, 50)], service="worker", series_hash=2)
    got = values(points(spark, rows), 1, 3, "increase", "service")
    near(got["svc-01"], [None, 10])
    near(got["worker"], [None, None])


def test_start_is_aligned_down(spark):
    df = points(spark, counter(spark, [(i, 60 * i) for i in range(5)]))
    for s in (80, 100):
        q = MetricQuery("m", "p1", H1 + timedelta(seconds=s), minute(4) + timedelta(seconds=10), "rate", None, 60)
        r = metric_query(df, q)
        assert r.start == minute(1) and [x["value"] for x in r.series.collect()] == [1, 1, 1, 1]


def test_kind_errors(spark):
    df = points(spark, [{"ts": minute(0), "value_int": 1, "service": "a", "type": 1, "monotonic": False}, {"ts": minute(0), "value_int": 1, "service": "b", "series_hash": 2}])
    with pytest.raises(ValueError, match="several kinds"):
        values(df, 0, 1, "")
    assert values(df, 0, 1, "", service="a") == {"": [1]}
    for bad in ({"aggregate": "rate", "service": "a"}, {"aggregate": "", "service": "a", "step_s": 1}):
        with pytest.raises(ValueError):
            values(df, 0, 1, **bad)
    with pytest.raises(LookupError):
        values(df.where("false"), 0, 1, "")


B3 = [10.0, 50.0, 100.0]


def histogram(given, **more):
    return [{"ts": minute(m), "start_ts": OLD, "bucket_bounds": b, "bucket_counts": c, "count": sum(c), "sum": s} | more for m, b, c, s in given]


def quantile_rows():
    rows = histogram([(0, B3, [1, 1, 1, 1], 1.0), (1, B3, [3, 7, 3, 1], 2.0)])
    rows += histogram([(0, B3, [5, 5, 5, 5], 1.0), (1, B3, [5, 9, 9, 7], 2.0)], series_hash=2)
    return rows + histogram([(0, [5.0, 10.0], [1, 1, 1], 1.0), (1, [5.0, 10.0], [2, 2, 2], 2.0)], series_hash=3)


def test_histograms(spark, store):
    df = store(points(spark, quantile_rows(), type=3, monotonic=False))
    for p, want in {"p50": 42, "p90": 100, "p99": 100, "": 100}.items():
        result = metric_query(df, MetricQuery("m", "p1", minute(1), minute(2), p, None, 60))
        row = result.series.first()
        assert row["value"] == pytest.approx(want) and row["incompatible_series"] == 1
    near(values(df, 1, 2, "rate")[""], [23 / 60])


def test_histogram_bounds_change_and_reset(spark):
    df = points(spark, histogram([(0, [5.0, 10.0], [1, 1, 1], 1.0), (1, B3, [3, 7, 3, 1], 2.0), (2, B3, [5, 9, 9, 7], 3.0)]), type=3, monotonic=False)
    near(values(df, 1, 3, "rate")[""], [11 / 60, 16 / 60])
    near(values(df, 1, 3, "p50")[""], [None, 50 + 50 * 4 / 6])
    assert {r["incompatible_series"] for r in metric_query(df, MetricQuery("m", "p1", minute(1), minute(3), "p50", None, 60)).series.collect()} == {0}
    df = points(spark, histogram([(0, [5.0, 10.0], [5, 5, 5], 9.0), (1, B3, [1, 1, 0, 0], 1.0)]), type=3, monotonic=False)
    near(values(df, 1, 2, "rate")[""], [2 / 60])
    near(values(df, 1, 2, "p50")[""], [10])
    rows = [{"ts": minute(m), "start_ts": OLD, "count": c, "sum": s} for m, c, s in ((0, 4, 10.0), (1, 10, 40.0))]
    near(values(points(spark, rows, type=3, monotonic=False), 1, 2, "avg")[""], [5])


@pytest.mark.parametrize(("counts", "bounds", "want"), [([0, 0, 0, 0], B3, None), ([3], [], None), ([4, 0, 0, 0], B3, 5), ([1, 2], B3, None), ([2, 2], [-1.0], -1), ([0, 0, 0, 4], B3, 100)])
def test_interpolation_edges(spark, counts, bounds, want):
    df = spark.createDataFrame([(counts, bounds)], "c array<long>, b array<double>")
    assert df.select(tel.histogram_quantile("c", "b", 0.5)).first()[0] == want


def test_merged_bounds_choice(spark):
    def chosen(rows):
        df = spark.createDataFrame([("", b, s, c) for b, s, c in rows], "grp string, bucket_bounds array<double>, series_hash long, db array<long>")
        return [(r["bounds"], r["incompatible_series"]) for r in metrics.merged_bounds(df).collect()]

    assert chosen([([1.0], 1, [9, 9]), ([2.0], 2, [1, 1]), ([2.0], 3, [1, 1])]) == [([2.0], 1)]
    assert chosen([([1.0], 1, [1, 1]), ([2.0], 2, [5, 5])]) == [([2.0], 1)]
    assert chosen([([1.0, 2.0], 1, [1, 1, 0]), ([1.0], 2, [1, 1])]) == [([1.0], 1)]
    assert chosen([]) == []


def test_steps_and_aggregates():
    hour = timedelta(hours=1)
    for span, want in ((hour / 12, 60), (hour, 60), (6 * hour, 120), (24 * hour, 600), (168 * hour, 3600)):
        assert tel.resolve_step(H0, H0 + span) == want
    for bad in (5, 10.5):
        with pytest.raises(ValueError):
            tel.resolve_step(H0, H0 + hour, bad)
    with pytest.raises(ValueError):
        tel.resolve_step(H0, H0 + 24 * hour, 10)
    assert tel.parse_aggregate(tel.HISTOGRAM, False, "p99.9") == ("p99.9", pytest.approx(0.999))
    for bad in ("p0", "p100", "p1000", "p99.99", "p"):
        with pytest.raises(ValueError):
            tel.parse_aggregate(tel.HISTOGRAM, False, bad)


def test_catalog(spark):
    rows = [{"ts": minute(0), "name": "queue.depth", "type": 1, "monotonic": False, "service": s, "series_hash": h, "attributes": a}
            for s, h, a in (("api", 1, '{"http.route":"/a","queue":"jobs"}'), ("worker", 2, '{"http.route":"/b","queue":"mail"}'), ("api", 1, '{"http.route":"/a","queue":"jobs","none":null}'))]
    rows += [{"ts": minute(m), "name": "Orders.Created", "unit": "{order}", "series_hash": 3} for m in (0, 30)] + [{"ts": minute(0), "name": "mem.used", "type": 1, "monotonic": False}, {"ts": minute(0), "name": "other.metric", "project": "p2"}]
    df = points(spark, rows)
    got = catalog.metric_catalog(df, "p1", H0, minute(60)).collect()
    assert [(r["name"], r["services"], r["series"], r["points"]) for r in got] == [("Orders.Created", ["api"], 1, 2), ("mem.used", ["api"], 1, 1), ("queue.depth", ["api", "worker"], 2, 3)]
    assert [r["name"] for r in catalog.metric_catalog(df, "p1", H0, minute(60), "orders").collect()] == ["Orders.Created"]
    assert catalog.metric_catalog(df, "p1", H0, minute(60), "%").collect() == []
    attrs = {r["key"]: (r["distinct_values"], r["first_values"]) for r in catalog.metric_attributes(df, "p1", "queue.depth", H0, minute(60)).collect()}
    assert attrs == {"http.route": (2, ["/a", "/b"]), "queue": (2, ["jobs", "mail"]), "none": (0, [])}
    wide = points(spark, [{"ts": minute(0), "attributes": f'{{"k":"{i:03d}"}}'} for i in range(120)])
    row = catalog.metric_attributes(wide, "p1", "m", H0, minute(60)).first()
    assert row["distinct_values"] == 120 and len(row["first_values"]) == 20


def test_panel_reductions(spark):
    def one(vals, end):
        df = spark.createDataFrame([("p", minute(i), v) for i, v in enumerate(vals)], "panel_id string, step_ts timestamp, value double")
        return panels.reduce_last(df, end, 60).first()["value"]

    assert one([1.0, 2.0, 0.5], minute(2.5)) == 2 and one([1.0, 2.0, 0.5], minute(3)) == 0.5
    assert one([1.0, None, None], minute(3)) == 1 and one([None, None, 4.0], minute(2.5)) == 4 and one([None, None], minute(2)) is None
    df = spark.createDataFrame([("p", 1.0), ("p", None), ("p", 2.5)], "panel_id string, value double")
    assert panels.reduce_sum(df).first()["value"] == 3.5
    for bad in ({"reduce": "last", "group_by": "service"}, {"reduce": "sum", "aggregate": "rate"}):
        with pytest.raises(ValueError):
            panels.Panel("x", "m", **bad)


@pytest.mark.parametrize("kind", ["counter", "histogram"])
def test_a_carried_predecessor_gives_the_same_deltas(spark, kind):
    """One series holds nine tenths of the points; with chunks its rows lie in many tasks."""
    import random

    r, rows, value = random.Random(5), [], 0
    for i in range(900):
        value = 0 if r.random() < 0.02 else value + r.randrange(9)
        rows.append({"ts": minute(r.choice((i, i, i + 0.5))), "start_ts": H0, "series_hash": 1 if i % 10 else 2 + i % 3, "value_int": value})
    if kind == "histogram":
        rows = [{k: v for k, v in row.items() if k != "value_int"} | {"type": 3, "count": row["value_int"], "sum": 1.5 * row["value_int"], "bucket_counts": [row["value_int"], i], "bucket_bounds": [1.0 if i % 50 else 2.0]} for i, row in enumerate(rows)]
    frame = points(spark, rows)
    columns = ("series_hash", "ts", "ingest_ts", "dv", "dc", "ds", "db", "is_reset", "is_fresh")

    def got(chunk):
        return sorted(map(str, metrics.series_deltas(frame, minute(5), minute(880), chunk=chunk).select(*columns).collect()))

    whole = got(None)
    assert len(whole) > 800 and whole == got(timedelta(minutes=7)) == got(timedelta(hours=1)) == got(timedelta(days=30))
    split = metrics.with_before(frame, timedelta(minutes=30))
    sizes = split.groupBy("series_hash", F.floor(F.unix_micros("ts") / 1_800_000_000)).count().agg(F.max("count")).first()[0]
    assert sizes <= 60 and split.columns == metrics.with_before(frame).columns


def test_bucket_sums_are_pre_aggregated(spark):
    plan = metrics.histogram_quantiles(metrics.grouped(metrics.series_deltas(points(spark, []), H0, H2), None, 60), 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1  # the buckets of one step, of a few rows
