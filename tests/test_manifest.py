"""The table of committed files: writers side by side, replays, failures, footers, Bloom filters, upkeep and retention."""

import os
import re
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenlake import schema
from lumenlake.operators import search, traces
from lumenlake.operators.search import Search
from lumenlake.sources import lake, manifest
from lumenlake.streaming import ingest
from tests.data import H0, H1, H2, logs, spans
from tests.test_sources import exports, log, ns, value

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def bodies(df):
    return sorted(r["body"] for r in df.select("body").collect())


def log_export(spark, pairs):
    return exports(spark, "logs", "resourceLogs", "scopeLogs", "logRecords", [log(ns(t), body=value(stringValue=b)) for t, b in pairs])


@pytest.fixture
def shared(spark, tmp_path):
    """A lake that both writers have written: hours, a stream, and a batch of either that came twice."""
    root = str(tmp_path / "lake")
    lake.write_hours(logs(spark, [{"ts": H0, "body": "filled", "severity_number": 9}, {"ts": H1, "body": "filled 2", "severity_number": 9}]), root, "logs")
    stream = ingest.Ingest(root, "logs", clock=lambda: H2)
    stream(log_export(spark, [(H0, "streamed"), (H1, "streamed 2")]), 0)
    stream(log_export(spark, [(H2, "again")]), 1)
    stream(log_export(spark, [(H2, "again")]), 1)  # after a failure
    for body in ("late, first try", "late"):
        lake.write_hours(logs(spark, [{"ts": H0, "body": body, "severity_number": 9}]), root, "logs", writer="repair", batch=7)
    return root


ALL = ["again", "filled", "filled 2", "late", "streamed", "streamed 2"]


def test_writers_share_a_lake_and_a_replay_replaces_its_batch(spark, shared):
    whole = lake.scan_signal(spark, shared, "logs", H0, H0 + DAY)
    assert whole.columns == schema.LOGS.names and bodies(whole) == ALL
    assert bodies(lake.scan_signal(spark, shared, "logs", H1, H2)) == ["filled 2", "streamed 2"]
    assert whole.select("ingest_ts").where(F.col("body").startswith("str")).distinct().count() == 1
    stats = lake.file_stats(spark, shared, "logs")
    assert stats.agg(F.sum("rows")).first()[0] == len(ALL)
    merged = search.live_merge(whole.where("body <> 'late'"), whole.where("body = 'late'"), H0)  # rows of both writers have the same columns
    assert merged.columns == schema.LOGS.names and "late" in bodies(merged)


def test_a_follower_sees_the_committed_rows_of_both_writers(spark, shared, tmp_path):
    def poll():
        got = []

        def show(rows, epoch):
            assert rows.columns == schema.LOGS.names
            got.extend(bodies(rows))

        ingest.logs_follow(spark, shared, Search("p1", H0, H0 + DAY), show, str(tmp_path / "cp"), available_now=True).awaitTermination()
        return sorted(got)

    assert poll() == ALL and poll() == []
    lake.write_batch(logs(spark, [{"ts": H1, "body": "half written"}]), shared, "logs", manifest.new_attempt("stream", 9))
    lake.write_hours(logs(spark, [{"ts": H0 - DAY, "body": "out of range"}, {"ts": H0, "body": "later", "severity_number": 9}]), shared, "logs")
    assert poll() == ["later"]
    manifest.compact(spark, shared, "logs")
    assert poll() == []


def test_a_keyed_stream_knows_keys_across_batches_and_restarts(spark, tmp_path):
    from tests.test_sources import span

    hour = datetime.utcnow().replace(minute=0, second=0, microsecond=0)
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")

    def send(name, times):
        records = [span(sid=f"{i:016x}", start=ns(t)) for i, t in times]
        exports(spark, "spans", "resourceSpans", "scopeSpans", "spans", [*records, span("xx")]).coalesce(1).write.json(f"{source}/{name}")

    def run():
        query, _ = ingest.stream_ingest(spark, f"{source}/*", root, "spans", str(tmp_path / "cp"), available_now=True, keyed=True)
        query.awaitTermination()
        assert any("numDroppedDuplicateRows" in s.customMetrics for p in query.recentProgress for s in p.stateOperators)
        return sorted(int(r["span_id"], 16) for r in lake.scan_signal(spark, root, "spans", hour - 9 * DAY, hour + DAY).collect())

    old = hour - 30 * HOUR
    send(1, [(1, hour), (2, hour), (2, hour), (3, old), (3, old), (4, hour - 5 * DAY)])
    assert run() == [1, 2, 3, 4]
    send(2, [(1, hour), (5, hour), (3, old)])  # a restart; the hour of 3 is closed, so it is kept
    assert run() == [1, 2, 3, 3, 4, 5]
    deadline = datetime.now() + timedelta(seconds=20)
    while (got := manifest.totals(spark, root, "spans").first())["duplicates"] < 3 and datetime.now() < deadline:
        pass
    assert (got["accepted"], got["rejected"], got["duplicates"]) == (6, 2, 3)


def test_counts_survive_restarts_and_replays(spark, shared):
    got = manifest.totals(spark, shared, "logs", "stream").first()
    assert (got["accepted"], got["rejected"], got["commits"]) == (3, 0, 2)
    fresh = ingest.Ingest(shared, "logs", clock=lambda: H2)
    fresh(exports(spark, "logs", "resourceLogs", "scopeLogs", "logRecords", [log(), log(ns(H2), body=value(stringValue="more"))]), 2)
    assert (fresh.stats.accepted, fresh.stats.rejected, fresh.stats.commits) == (4, 1, 3)
    assert fresh.stats.last_stamp_us > got["last_stamp_us"]


def test_what_is_not_committed_is_not_seen_and_is_swept(spark, shared):
    lost = manifest.new_attempt("stream", 9)
    lake.write_batch(logs(spark, [{"ts": H1, "body": "half written"}]), shared, "logs", lost)
    assert bodies(lake.scan_signal(spark, shared, "logs", H0, H0 + DAY)) == ALL
    assert manifest.vacuum(spark, shared, "logs", datetime(2000, 1, 1)) == 0
    assert manifest.vacuum(spark, shared, "logs", datetime(2100, 1, 1)) == 3  # and the first tries of two batches
    assert bodies(lake.scan_signal(spark, shared, "logs", H0, H0 + DAY)) == ALL
    assert spark.read.parquet(f"{shared}/logs").count() == len(ALL)


def test_compaction_changes_nothing_to_be_seen(spark, shared):
    def view():
        return sorted(map(tuple, manifest.files(spark, shared, "logs").collect())), manifest.totals(spark, shared, "logs").first()

    before = view()
    manifest.compact(spark, shared, "logs")
    assert len([f for f in os.listdir(manifest.folder(shared, "logs")) if f.endswith(".parquet")]) == 1
    assert view() == before and bodies(lake.scan_signal(spark, shared, "logs", H0, H0 + DAY)) == ALL


def test_footers_tell_what_rows_tell_and_sizes_are_real(spark, shared, tmp_path):
    stats = {r["path"]: r for r in lake.file_stats(spark, shared, "logs").collect()}
    for path, r in stats.items():
        own = spark.read.parquet(path).agg(F.count("*"), F.min("ts"), F.max("ts"), F.max("ingest_ts")).first()
        assert tuple(own) == (r["rows"], r["min_ts"], r["max_ts"], r["max_ingest_ts"])
        assert os.path.getsize(path.removeprefix("file:").replace("///", "/")) == r["bytes"]
    lake.write_hours(logs(spark, [{"ts": H0 + timedelta(seconds=(i * 37) % 600), "body": str(i)} for i in range(600)]), shared, "logs")
    for path in (r["path"] for r in lake.file_stats(spark, shared, "logs").collect()):
        times = pq.read_table(path.removeprefix("file:").replace("///", "/"), columns=["ts"]).column("ts").to_pylist()
        assert times == sorted(times)  # rows lie in order within a file
    files = manifest.listing(spark, f"{shared}/logs").where(F.col("path").isin(*stats))
    told = manifest.describe(spark, files)
    leaves = told._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" not in leaves and "binaryFile" in leaves.replace("BinaryFile", "binaryFile")
    by_driver = manifest._footers_by_hadoop(spark, files).collect()  # stores that only Spark opens
    assert {(r["path"], r["rows"], r["min_us"], r["max_us"], r["ingest_us"]) for r in by_driver} == {
        tuple(r) for r in told.select("path", "rows", F.unix_micros("min_ts"), F.unix_micros("max_ts"), F.unix_micros("max_ingest_ts")).collect()
    }


def scanned(df):
    """Rows that the scan has handed on, from the metrics of the plan that ran."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan()
    nodes, total = [text], 0
    while nodes:
        node = nodes.pop()
        if "Scan" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return total


def test_a_trace_is_looked_up_by_bloom_filters_over_168_hours(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(168 * 300).selectExpr(
        "timestamp_micros(1790812800000000 + id * 12000000) AS ts", "timestamp_micros(1790812800000000 + id * 12000000) AS end_ts", "timestamp_micros(id) AS ingest_ts", "'p1' AS project", "'s' AS service",
        "md5(string(id)) AS trace_id", "string(id) AS span_id", "'n' AS name", "0L AS duration_ns",
    )
    lake.write_hours(rows, root, "spans")
    assert lake.file_stats(spark, root, "spans").count() >= 168
    all_ = lake.scan_signal(spark, root, "spans", H0, H0 + 8 * DAY)
    wanted = rows.where("id = 25001").first()["trace_id"]
    assert traces.trace_get(all_, "p1", wanted, H0, H0 + 8 * DAY).count() == 1
    spark.conf.set("parquet.filter.dictionary.enabled", "false")
    try:
        assert scanned(all_.where(F.col("trace_id") == wanted)) <= 6 * 300  # of 50,400 rows, those of a few files
        spark.conf.set("parquet.filter.bloom.enabled", "false")
        without = lake.scan_signal(spark, root, "spans", H0, H0 + 8 * DAY)
        assert scanned(without.where(F.col("trace_id") == wanted)) > 100 * 300
    finally:
        for name in ("dictionary", "bloom"):
            spark.conf.unset(f"parquet.filter.{name}.enabled")
    assert scanned(all_.where(F.col("ts") == F.lit(H0 + 30 * HOUR))) <= 300  # and ts has statistics


def test_plain_files_are_read_and_can_be_adopted(spark, tmp_path):
    root = str(tmp_path)
    old = lake.with_hour(logs(spark, [{"ts": H0, "body": "old"}, {"ts": H1, "body": "old 2"}]))
    with lake._timestamps_with_statistics(spark):
        old.write.partitionBy("date", "hour").parquet(f"{root}/logs")
    assert bodies(lake.scan_signal(spark, root, "logs", H0, H2)) == ["old", "old 2"]
    assert lake.file_stats(spark, root, "logs").agg(F.sum("rows")).first()[0] == 2
    lake.write_hours(logs(spark, [{"ts": H0, "body": "new"}]), root, "logs")
    assert bodies(lake.scan_signal(spark, root, "logs", H0, H2)) == ["new"]
    for _ in range(2):
        manifest.adopt(spark, root, "logs")
    got = lake.scan_signal(spark, root, "logs", H0, H2)
    assert bodies(got) == ["new", "old", "old 2"] and got.columns == schema.LOGS.names


def test_retention_drops_by_age_and_by_real_size(spark, tmp_path):
    root = str(tmp_path)
    lake.write_hours(logs(spark, [{"ts": H0 + i * HOUR, "body": "x" * 50} for i in range(6)]), root, "logs")
    lake.write_hours(spans(spark, [{"ts": H0 + i * HOUR, "trace_id": "t", "span_id": str(i)} for i in range(6)]), root, "spans")
    sizes = {(r["signal"], r["hour"]): r["bytes"] for r in lake.storage_report(lake.all_stats(spark, root)).collect()}
    cap = sum(b for (_, h), b in sizes.items() if h >= H0 + 4 * HOUR) + 10
    got = {r["phase"]: (r["hours"], r["files"], r["bytes"]) for r in lake.apply_retention(spark, root, {"logs": 1}, cap, H0 + DAY + 2 * HOUR).collect()}
    aged = {k for k in sizes if k[0] == "logs" and k[1] <= H1}
    sized = {k for k in sizes if k not in aged and k[1] < H0 + 4 * HOUR}
    assert got == {"age": (2, 2, sum(sizes[k] for k in aged)), "size": (4, len(sized), sum(sizes[k] for k in sized))}
    left = {(r["signal"], r["hour"]) for r in lake.all_stats(spark, root).collect()}
    assert left == set(sizes) - aged - sized
    assert lake.scan_signal(spark, root, "logs", H0, H0 + DAY).count() == 2 == lake.scan_signal(spark, root, "spans", H0, H0 + DAY).count()
    lake.write_hours(logs(spark, [{"ts": H0, "body": "back"}]), root, "logs")  # a later commit of a dropped hour is seen
    assert bodies(lake.scan_signal(spark, root, "logs", H0, H1)) == ["back"]
    assert len(re.findall("hour=", " ".join(d for d, _, f in os.walk(f"{root}/logs") if any(x.endswith(".parquet") for x in f)))) == 3


def test_empty_writes_and_empty_lakes(spark, tmp_path):
    root = str(tmp_path)
    lake.write_hours(logs(spark, []), root, "logs")
    assert lake.scan_signal(spark, root, "logs", H0, H0 + DAY).count() == 0 and lake.file_stats(spark, root, "logs").count() == 0
    assert lake.scan_signal(spark, root, "logs", H0, H0 + DAY).columns == schema.LOGS.names
    assert lake.apply_retention(spark, root, {"logs": 1}, 10, H0).agg(F.sum("files")).first()[0] == 0


def test_an_attempt_is_listed_and_described_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no folder of the attempt, and the footers are read by more than one task though their paths are few bytes."""
    root, listing = str(tmp_path / "lake"), manifest.listing
    rows = spark.range(10).select(F.timestamp_micros(F.col("id") * 3_600_000_000 + 1_704_067_200_000_000).alias("ts"), F.lit("x").alias("body"))
    monkeypatch.setattr(manifest, "listing", lambda *a: pytest.fail("listed by the driver"))
    lake.write_hours(rows, root, "logs")
    stats = lake.file_stats(spark, root, "logs").collect()
    assert len(stats) == 10 and {(r["rows"], r["hour"]) for r in stats} == {(1, r["min_ts"]) for r in stats}
    assert {(r["path"], r["bytes"]) for r in stats} == {(r["path"], r["bytes"]) for r in listing(spark, f"{root}/logs").collect()}
    monkeypatch.setattr(manifest, "FOLDERS_A_TASK", 3)
    attempt = stats[0]["path"].split("/batch=")[1].split("/")[0]
    facts = manifest.describe_attempt(spark, root, "logs", attempt, [1_704_067_200_000_000 + h * 3_600_000_000 for h in range(10)])
    assert facts.rdd.getNumPartitions() == 4 and facts.count() == 10
