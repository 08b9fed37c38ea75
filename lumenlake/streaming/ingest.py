"""Ingest: deduplication, stamps, the streaming path from exports to the lake, and the live follower."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lumenlake.functions import telemetry as tel
from lumenlake.operators.search import Search, log_predicates
from lumenlake.schema import EXPORTS, SIGNALS
from lumenlake.sources import lake, manifest, otlp

#: Identity of a stored row; logs have none.
KEYS = {"spans": ("project", "trace_id", "span_id"), "metric_points": ("series_hash", "start_ts", "ts")}


def first_of_each(batch: DataFrame, keys: tuple[str, ...], arrival: tuple = ()) -> DataFrame:
    """The first row of each key in order of arrival."""
    order = Window.partitionBy(*keys).orderBy(*(arrival or [F.monotonically_increasing_id()]))
    return batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _not_stored(batch: DataFrame, stored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    known = stored.select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return batch.join(known, same, "left_anti")


def recent(stored: DataFrame, now: datetime) -> DataFrame:
    """Rows of the hours that are not closed yet: a retry of an older row is kept, not dropped."""
    us = tel.micros(now)
    return stored.where(F.col("ts") >= tel.at(us - us % 3_600_000_000 - 3_600_000_000))


def dedup_spans(batch: DataFrame, stored: DataFrame | None = None, arrival: tuple = ()) -> DataFrame:
    """Spans new by (project, trace_id, span_id), the first of each; stored holds the rows of the recent hours."""
    one = first_of_each(batch, KEYS["spans"], arrival)
    return one if stored is None else _not_stored(one, stored, KEYS["spans"])


def dedup_points(batch: DataFrame, stored: DataFrame | None = None, arrival: tuple = ()) -> DataFrame:
    """Points new by (series_hash, start_ts, ts); a null start equals a null start."""
    one = first_of_each(batch, KEYS["metric_points"], arrival)
    return one if stored is None else _not_stored(one, stored, KEYS["metric_points"])


def ingest_stamp(batch: DataFrame, last_us: int, now: datetime) -> tuple[DataFrame, int]:
    """One stamp per batch, greater than all before it; rows of a batch become visible together, so the stamp is a watermark."""
    stamp = max(tel.micros(now), last_us + 1)
    return batch.withColumn("ingest_ts", tel.at(stamp)), stamp


@dataclass
class IngestStats:
    """Counts of what an ingest stream has done."""

    accepted: int = 0
    rejected: int = 0
    unknown_service: int = 0
    duplicates: int = 0
    commits: int = 0
    failed_commits: int = 0
    last_stamp_us: int = 0
    last_latency_s: float = 0.0
    reasons: dict[str, int] = field(default_factory=dict)


def ingest_stats(flat: DataFrame, stored: DataFrame) -> DataFrame:
    """accepted, rejected, unknown_service and duplicates of flattened records and what was stored of them."""
    kept = flat.agg(
        F.count_if(F.col("reject_reason").isNull()).alias("_kept"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_if(F.col("unknown_service") & F.col("reject_reason").isNull()).alias("unknown_service")
    )
    return kept.crossJoin(stored.agg(F.count("*").alias("accepted"))).select("accepted", "rejected", "unknown_service", (F.col("_kept") - F.col("accepted")).alias("duplicates"))  # one row each


class Ingest:
    """Writes micro-batches of nested exports of one signal to the lake.

    Each run of a batch is an attempt with files of its own, which the commit makes visible in place of any earlier attempt
    of the batch (manifest.py), so a replay changes nothing. Duplicates are looked up in the committed files of the recent
    hours, those of the batch's own earlier attempts left out. Late rows are never dropped. The counts of a batch are
    committed with it: they survive a restart, and a batch that runs twice counts once. Streams of other names, and
    write_hours(), may write to the same lake.
    """

    def __init__(self, root: str, signal: str, nested: bool = True, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), writer: str = "stream"):
        self.root, self.signal, self.nested, self.clock, self.writer = root, signal, nested, clock, writer
        self.stats = IngestStats()

    def refresh(self, spark: SparkSession) -> None:
        """The counts of all batches that this writer has committed, in this run or before."""
        for name, value in manifest.totals(spark, self.root, self.signal, self.writer).first().asDict().items():
            setattr(self.stats, name, value)

    def last_stamp(self, spark: SparkSession, epoch: int) -> int:
        """The greatest stamp of the lake, whoever wrote it, this batch's earlier attempts left out."""
        other = (F.col("writer") != self.writer) | (F.col("batch") != epoch)
        stamps = manifest.files(spark, self.root, self.signal).where(other).select(F.unix_micros("max_ingest_ts").alias("us"))
        stamps = stamps.unionAll(manifest.batches(spark, self.root, self.signal).where(other).select(F.col("stamp_us")))
        return int(stamps.agg(F.max("us")).first()[0] or 0)

    def __call__(self, exports: DataFrame, epoch: int) -> None:
        """One batch of nested exports; duplicates are looked up in the lake."""
        self.store(otlp.FLATTEN[self.signal](exports, self.nested), epoch, self.signal in KEYS)

    def store(self, flat: DataFrame, epoch: int, look_up: bool) -> None:
        """One batch of flattened records; without look_up, those of recent hours are new already (keyed_new())."""
        spark, began = flat.sparkSession, self.clock()
        flat = flat.persist()
        try:
            seen = Observation(f"ingest-{uuid.uuid4().hex}")
            told = flat.observe(
                seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_if(F.col("unknown_service") & F.col("reject_reason").isNull()).alias("unknown")
            )
            rows, start = otlp.accepted(told), self.recent_start(began)
            if look_up:
                known = lake.committed(spark, self.root, self.signal, start, without=(self.writer, epoch))
                rows = (dedup_spans if self.signal == "spans" else dedup_points)(rows, recent(known, began))
            elif self.signal in KEYS:  # late rows keep no state: the first of each in its batch
                late = F.col("ts") < tel.at(tel.micros(start))
                rows = rows.where(~late).unionByName(first_of_each(rows.where(late), KEYS[self.signal]))
            rows, stamp = ingest_stamp(rows, self.last_stamp(spark, epoch), began)
            attempt = manifest.new_attempt(self.writer, epoch)
            hours, stored = lake.write_batch(rows, self.root, self.signal, attempt)
            got = {"rows": 0, "rejected": 0, "unknown": 0} | lake.observed(seen)
            if not look_up and self.signal in KEYS:  # both branches have been observed
                got = flat.agg(F.count("*").alias("rows"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_if(F.col("unknown_service") & F.col("reject_reason").isNull()).alias("unknown")).first().asDict()
            counts = {"accepted": stored, "rejected": got["rejected"], "unknown_service": got["unknown"], "duplicates": got["rows"] - got["rejected"] - stored}
            counts |= {"stamp_us": stamp, "latency_s": (self.clock() - began).total_seconds()}
            manifest.commit(spark, self.root, self.signal, self.writer, epoch, attempt, hours, counts)
            self.refresh(spark)
        except Exception:
            self.stats.failed_commits += 1
            raise
        finally:
            flat.unpersist()

    @staticmethod
    def recent_start(now: datetime) -> datetime:
        us = tel.micros(now)
        return datetime(1970, 1, 1) + timedelta(microseconds=us - us % 3_600_000_000 - 3_600_000_000)


#: How long the state of a keyed stream knows a key: the hours that are not closed reach back less than this.
KNOWN_FOR = "2 hours"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_new(flat: DataFrame, signal: str) -> DataFrame:
    """A stream of flattened records without those whose key came in the last two hours, by state in the stream's checkpoint
    and not by a look at the lake. Time is the time of arrival, which no row is late for, so no watermark drops any: rejected
    records, and rows of closed hours, which have no known keys, get a key of their own and pass."""
    arrival = F.current_timestamp()
    passes = F.col("reject_reason").isNotNull() | (F.col("ts") < F.date_trunc("hour", arrival) - F.expr("INTERVAL 1 HOUR"))
    own = flat.withColumn("_arrival", arrival).withColumn("_own", F.when(F.coalesce(passes, F.lit(True)), F.uuid()))
    return own.withWatermark("_arrival", KNOWN_FOR).dropDuplicatesWithinWatermark([*KEYS[signal], "_own"]).drop("_arrival", "_own")


class _Dropped(StreamingQueryListener):
    """Commits the number of rows that a keyed stream's state has dropped, beside the batch that it dropped them from."""

    def __init__(self, spark: SparkSession, ingest: Ingest):
        self.spark, self.ingest, self.run_id = spark, ingest, None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if str(p.runId) != self.run_id or not p.stateOperators:
            return
        dropped = sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in p.stateOperators)
        if dropped:
            manifest.commit_counts(self.spark, self.ingest.root, self.ingest.signal, self.ingest.writer, p.batchId, {"duplicates": dropped})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.spark.streams.removeListener(self)


def stream_ingest(
    spark: SparkSession, source: str, root: str, signal: str, checkpoint: str, nested: bool = True, files_per_batch: int = 1000, available_now: bool = False, interval: str = "250 milliseconds", clock=None, writer: str = "stream", keyed: bool | None = None
) -> tuple[StreamingQuery, IngestStats]:
    """Run exports (JSON files) of one signal into the lake, continuously or until what is there has been read.

    keyed: known keys are state of the stream (RocksDB), which costs a batch no more than its own rows; else each batch
    reads the keys of the lake's recent hours, other writers' included. By default continuous streams are keyed. The counts
    of a keyed stream's dropped rows are committed after each batch; a crash in between loses that one number."""
    ingest = Ingest(root, signal, nested, writer=writer, **({"clock": clock} if clock else {}))
    ingest.refresh(spark)
    exports = spark.readStream.schema(EXPORTS[signal]).option("maxFilesPerTrigger", files_per_batch).json(source)
    if signal in KEYS and (not available_now if keyed is None else keyed):
        rows = keyed_new(otlp.FLATTEN[signal](exports, nested), signal)
        writes = rows.writeStream.foreachBatch(lambda flat, epoch: ingest.store(flat, epoch, False))
        listener = _Dropped(spark, ingest)
    else:
        writes, listener = exports.writeStream.foreachBatch(ingest), None
    writes = writes.option("checkpointLocation", checkpoint)
    writes = writes.trigger(availableNow=True) if available_now else writes.trigger(processingTime=interval)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if listener:
        spark.conf.set(key, STATE_STORE)
        spark.streams.addListener(listener)
    try:
        query = writes.start()  # takes the session's settings of this moment with it
    finally:
        if listener:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    if listener:
        listener.run_id = str(query.runId)
    return query, ingest.stats


def logs_follow(
    spark: SparkSession, root: str, p: Search, show: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, interval: str = "1 second"
) -> StreamingQuery:
    """show(rows, epoch) gets the logs that match as batches are committed, late rows among them, each batch's last attempt.

    The stream runs over the table of committed files, so rows that are not committed, or replaced before they were shown, are
    never seen; no watermark drops any. A batch that is replaced after it was shown is shown again."""
    entries = spark.readStream.schema(manifest.SCHEMA).parquet(manifest.folder(root, "logs"))

    def run(new: DataFrame, epoch: int) -> None:
        come = new.where("kind = 'file' AND moved IS NULL").select("path").distinct()
        rows = lake.read_paths(spark, root, "logs", manifest.files(spark, root, "logs").join(come, "path", "left_semi"))
        for predicate in log_predicates(p):
            rows = rows.where(predicate)
        show(rows.select(*SIGNALS["logs"].names), epoch)

    writes = entries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writes = writes.trigger(availableNow=True) if available_now else writes.trigger(processingTime=interval)
    return writes.start()
