"""The table of committed files: what of a lake's folders may be read.

root/_manifest/<signal> is an append-only Parquet table. A writer numbers its batches; each run of a batch is an attempt
with a name of its own and files of its own, root/<signal>/date=YYYY-MM-DD/hour=HH/batch=<attempt>/*.parquet. When the files
are there, one row for the batch and one a file are appended together: only then the batch can be seen. Of several
attempts of a batch the one committed last counts, so a batch that is run again replaces its rows, and files of an attempt
that failed are never read. Dropped hours are rows as well. compact() puts the small files of many commits together.

Facts of a file come from its Parquet footer: row counts and the statistics of ts and ingest_ts, no data pages. Tasks read
the footers of one batch, side by side; a file is described once, when it is committed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("accepted", "rejected", "unknown_service", "duplicates")
_TYPES = {"long": T.LongType(), "string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType()}
_COLUMNS = (
    ("kind", "string"), ("writer", "string"), ("batch", "long"), ("attempt", "string"), ("committed_us", "long"), ("path", "string"), ("hour", "timestamp"), ("rows", "long"), ("bytes", "long"),
    ("min_ts", "timestamp"), ("max_ts", "timestamp"), ("max_ingest_ts", "timestamp"), *((c, "long") for c in COUNTS), ("stamp_us", "long"), ("latency_s", "double"), ("moved", "long"),
)
SCHEMA = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in _COLUMNS])
#: Folders of an attempt that one task lists and reads the footers of.
FOLDERS_A_TASK = 250
#: File systems that tasks open by themselves; footers in any other are read through Hadoop by the driver.
TASK_SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def folder(root: str, signal: str) -> str:
    return f"{root}/_manifest/{signal}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders or files, several at a time; returns how many were there."""

    def one(path: str) -> bool:
        fs, p = _hadoop(spark, path)
        return bool(fs.delete(p, True))

    with ThreadPoolExecutor(16) as pool:
        return sum(pool.map(one, paths))


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes and modified of the Parquet files below the paths. Spark lists many folders in parallel; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths))
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


# ---- footers


def _facts(meta, path: str, size: int) -> tuple:
    """rows, least and greatest ts, greatest ingest_ts of a footer, times in microseconds; null where a file has no statistics."""
    names = [meta.schema.column(i).path for i in range(meta.num_columns)]
    found: dict[str, list] = {"ts": [], "ingest_ts": []}
    for g in range(meta.num_row_groups):
        for name, values in found.items():
            if name in names:
                s = meta.row_group(g).column(names.index(name)).statistics
                values.append((s.min, s.max) if s is not None and s.has_min_max else None)

    def us(values: list, side: int, pick):
        if not values or None in values:
            return None
        t = pick(v[side] for v in values)
        t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)

    return path, size, meta.num_rows, us(found["ts"], 0, min), us(found["ts"], 1, max), us(found["ingest_ts"], 1, max)


_FACTS = "path string, bytes long, rows long, min_us long, max_us long, ingest_us long"


def _store(path: str):
    """The file system of a path and the path's name in it."""
    from pyarrow import fs

    uri = path.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _footers(files: Iterator[tuple[str, int]]) -> pa.RecordBatch:
    import pyarrow.parquet as pq

    rows = []
    for path, size in files:
        store, name = _store(path)
        with store.open_input_file(name) as f:
            rows.append(_facts(pq.read_metadata(f), path, size))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "bytes", "rows", "min_us", "max_us", "ingest_us"])


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _footers(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))


def _list_and_read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def inside(folder: str) -> Iterator[tuple[str, int]]:
        store, name = _store(folder)
        for f in store.get_file_info(fs.FileSelector(name)):
            if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
                yield f"{folder}/{f.base_name}", f.size

    for batch in batches:
        yield _footers(f for folder in batch.column(0).to_pylist() for f in inside(folder))


def _footers_by_hadoop(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The same through Hadoop's file systems, file after file on the driver: for stores that only Spark opens."""
    jvm, rows = spark.sparkContext._jvm, []
    for file in files.toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(file["path"])
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, spark.sparkContext._jsc.hadoopConfiguration()))
        try:
            n, span = 0, {"ts": [], "ingest_ts": []}
            for block in reader.getFooter().getBlocks():
                n += block.getRowCount()
                for column in block.getColumns():
                    name, s = column.getPath().toDotString(), column.getStatistics()
                    if name in span:
                        span[name].append((s.genericGetMin(), s.genericGetMax()) if s.hasNonNullValue() else None)
        finally:
            reader.close()
        whole = {k: v if v and None not in v else None for k, v in span.items()}
        ts, seen = whole["ts"], whole["ingest_ts"]
        rows.append((file["path"], file["bytes"], n, ts and min(x[0] for x in ts), ts and max(x[1] for x in ts), seen and max(x[1] for x in seen)))
    return spark.createDataFrame(rows, _FACTS)


def describe(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Files of listing() with the facts of their footers and the hour of their folder."""
    schemes = {r[0] for r in files.select(F.regexp_extract("path", r"^([a-zA-Z0-9+.-]+):", 1)).distinct().limit(2).collect()}
    if schemes <= {"", *TASK_SCHEMES}:
        spread = files.select("path", "bytes").repartition(4 * spark.sparkContext.defaultParallelism, F.xxhash64("path"))  # a number, as few bytes are many files
        facts = spread.mapInArrow(_read_footers, _FACTS)
    else:
        facts = _footers_by_hadoop(spark, files)
    return _described(facts)


def describe_attempt(spark: SparkSession, root: str, signal: str, attempt: str, hours_us: list[int]) -> DataFrame:
    """The same for an attempt's files below its hours. Tasks list the folders too, FOLDERS_A_TASK each: what the driver does
    does not grow but by one number an hour."""
    fs, p = _hadoop(spark, f"{root}/{signal}")
    base = fs.makeQualified(p).toString()  # as listings give it
    us = F.col("us")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / 86_400_000_000).cast("int")).cast("string")
    hour = F.floor(F.pmod(us, F.lit(86_400_000_000)) / 3_600_000_000).cast("string")
    folders = spark.createDataFrame(pa.table({"us": pa.array(hours_us, pa.int64())})).select(F.concat(F.lit(f"{base}/date="), day, F.lit("/hour="), hour, F.lit(f"/batch={attempt}")).alias("folder"))
    if base.split(":/", 1)[0] not in TASK_SCHEMES:
        return describe(spark, listing(spark, *(r[0] for r in folders.collect())))
    return _described(folders.repartition(-(-len(hours_us) // FOLDERS_A_TASK), F.xxhash64("folder")).mapInArrow(_list_and_read_footers, _FACTS))


def _described(facts: DataFrame) -> DataFrame:
    date, hour = F.regexp_extract("path", r"/date=(\d{4}-\d\d-\d\d)/", 1), F.regexp_extract("path", r"/hour=(\d{1,2})/", 1)
    start = F.timestamp_micros(F.datediff(F.try_to_date(date), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + hour.try_cast("long") * F.lit(3_600_000_000))
    at = lambda c: F.timestamp_micros(c)
    return facts.select("path", start.alias("hour"), "rows", "bytes", at("min_us").alias("min_ts"), at("max_us").alias("max_ts"), at("ingest_us").alias("max_ingest_ts"))


# ---- commits


def _append(rows: DataFrame, root: str, signal: str) -> None:
    """One task and so one file, which appears as a whole or not at all. The rows are shuffled to it: what makes them (the
    reading of footers) stays in many tasks."""
    full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))
    full.repartition(1).write.mode("append").parquet(folder(root, signal))


def new_attempt(writer: str, batch: int) -> str:
    return f"{writer}-{batch:012d}-{uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, signal: str, writer: str, batch: int, attempt: str, hours_us: list[int], counts: dict) -> None:
    """Make the attempt's files below the hours visible, in place of any earlier attempt of the batch."""
    own = spark.createDataFrame([("batch", *(counts.get(c) for c in (*COUNTS, "stamp_us", "latency_s")))], f"kind string, {', '.join(f'{c} long' for c in COUNTS)}, stamp_us long, latency_s double")
    rows = own.unionByName(describe_attempt(spark, root, signal, attempt, hours_us).withColumn("kind", F.lit("file")), allowMissingColumns=True) if hours_us else own
    named = {"writer": F.lit(writer), "batch": F.lit(batch), "attempt": F.lit(attempt), "committed_us": F.lit(time.time_ns() // 1000)}
    _append(rows.withColumns(named), root, signal)


def commit_counts(spark: SparkSession, root: str, signal: str, writer: str, batch: int, counts: dict) -> None:
    """Numbers of a batch that are only known after its commit; told again, they count once."""
    row = {"kind": "counts", "writer": writer, "batch": batch, "attempt": new_attempt(writer, batch), "committed_us": time.time_ns() // 1000} | counts
    _append(spark.createDataFrame([tuple(row.get(f.name) for f in SCHEMA)], SCHEMA), root, signal)


def adopt(spark: SparkSession, root: str, signal: str) -> None:
    """Take files that were put straight into date=/hour= folders, and that no batch knows, into the table."""
    known = entries(spark, root, signal).where("kind = 'file'").select("path")
    files = listing(spark, f"{root}/{signal}").where(~F.col("path").contains("/batch=")).join(known, "path", "left_anti")
    attempt = new_attempt("adopted", 0)
    rows = describe(spark, files).withColumn("kind", F.lit("file"))
    own = spark.createDataFrame([("batch",)], "kind string").unionByName(rows, allowMissingColumns=True)
    _append(own.withColumns({"writer": F.lit(attempt), "batch": F.lit(0), "attempt": F.lit(attempt), "committed_us": F.lit(time.time_ns() // 1000)}), root, signal)


def drop(spark: SparkSession, root: str, signal: str, hours: DataFrame) -> None:
    """Hide all files of the hours that are committed by now."""
    _append(hours.select("hour").distinct().withColumns({"kind": F.lit("drop"), "committed_us": F.lit(time.time_ns() // 1000)}), root, signal)


# ---- what can be seen


def entries(spark: SparkSession, root: str, signal: str) -> DataFrame:
    if not exists(spark, folder(root, signal)):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder(root, signal))


def batches(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """The row of each batch's last attempt."""
    own = entries(spark, root, signal).where("kind = 'batch'")
    return own.groupBy("writer", "batch").agg(F.max_by(F.struct("attempt", *COUNTS, "stamp_us", "latency_s", "committed_us"), F.struct("committed_us", "attempt")).alias("b")).select("writer", "batch", "b.*")


def files(spark: SparkSession, root: str, signal: str) -> DataFrame:
    """writer, batch, path, hour, rows, bytes, min_ts, max_ts, max_ingest_ts of every file that can be seen."""
    all_ = entries(spark, root, signal)
    last = batches(spark, root, signal).select("attempt")
    dropped = all_.where("kind = 'drop'").groupBy("hour").agg(F.max("committed_us").alias("_dropped_us"))
    seen = all_.where("kind = 'file'").dropDuplicates(["attempt", "path"]).join(last, "attempt", "left_semi").join(dropped, "hour", "left")
    return seen.where("_dropped_us IS NULL OR committed_us > _dropped_us").select("writer", "batch", "path", "hour", "rows", "bytes", "min_ts", "max_ts", "max_ingest_ts")


def totals(spark: SparkSession, root: str, signal: str, writer: str | None = None) -> DataFrame:
    """accepted, rejected, unknown_service, duplicates, commits, last_stamp_us and last_latency_s of all batches, each counted
    once however often it was run: one row."""
    later = entries(spark, root, signal).where("kind = 'counts'").groupBy("writer", "batch").agg(*(F.max_by(c, F.struct("committed_us", "attempt")).alias(f"_{c}") for c in COUNTS))
    own = batches(spark, root, signal).join(later, ["writer", "batch"], "left")
    own = own if writer is None else own.where(F.col("writer") == writer)
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))), F.lit(0)).alias(c) for c in COUNTS]
    return own.agg(*sums, F.count("*").alias("commits"), F.coalesce(F.max("stamp_us"), F.lit(0)).alias("last_stamp_us"), F.coalesce(F.max_by("latency_s", "committed_us"), F.lit(0.0)).alias("last_latency_s"))


# ---- upkeep


def compact(spark: SparkSession, root: str, signal: str, before: datetime | None = None) -> None:
    """One file in place of the small files that commits wrote before the time (all, where it is null). Rows are known by
    attempt and path, so a crash between the new file and the deletion of the old ones leaves doubles that change nothing.
    The rows are marked as moved: followers, who must have read the small files by then, pass over them."""
    old = listing(spark, folder(root, signal))
    paths = [r[0] for r in (old if before is None else old.where(F.col("modified") < F.lit(before))).select("path").toLocalIterator()]
    if len(paths) > 1:
        _append(spark.read.schema(SCHEMA).parquet(*paths).withColumn("moved", F.lit(1)).dropDuplicates(), root, signal)
        delete(spark, paths)


def vacuum(spark: SparkSession, root: str, signal: str, before: datetime) -> int:
    """Delete folders of attempts that cannot be seen and were last written before the time: failed or replaced ones."""
    held = listing(spark, f"{root}/{signal}").where(F.col("path").contains("/batch=")).select(F.regexp_extract("path", r"^(.*/batch=[^/]+)/", 1).alias("of"), "modified")
    seen = files(spark, root, signal).select(F.regexp_extract("path", r"^(.*/batch=[^/]+)/", 1).alias("of"))
    gone = held.groupBy("of").agg(F.max("modified").alias("modified")).where(F.col("modified") < F.lit(before)).join(seen, "of", "left_anti")
    return delete(spark, [r[0] for r in gone.select("of").toLocalIterator()])
