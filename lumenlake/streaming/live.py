"""The live list of logs: a base page and what has arrived since, as state of a stream.

The stream follows the table of committed files. The state after batch n is a small Parquet table (a page and at most
MAX_ARRIVALS rows) made of the state before and the rows that came, so a batch that runs again makes the same state, and a
restart goes on from the last one. A list that more rows arrive at than it holds, or that are more than one poll shows,
starts over from a new base page of the lake.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake.operators import search
from lumenlake.operators.search import MAX_ARRIVALS, Search
from lumenlake.schema import SIGNALS
from lumenlake.sources import lake, manifest
from lumenlake.streaming.ingest import logs_follow

COLUMNS = SIGNALS["logs"].names


def _state(folder: str, epoch: int) -> str:
    return f"{folder}/state/epoch={epoch:012d}"


def base_page(spark: SparkSession, root: str, p: Search) -> DataFrame:
    """The newest rows that match, as many as a page holds."""
    rows = search.logs_search(lake.scan_signal(spark, root, "logs", p.start, p.end), p)
    return rows.orderBy(F.desc("ts"), F.desc("ingest_ts")).limit(p.limit).select(*COLUMNS)


def _arrive(rows: DataFrame, epoch: int, root: str, p: Search, folder: str, most: int) -> None:
    spark, start_over = rows.sparkSession, True
    come = rows.orderBy(F.desc("ts"), F.desc("ingest_ts")).limit(most + 1).withColumn("arrived", F.lit(True)).persist()
    try:
        if epoch > 0:
            before = spark.read.parquet(_state(folder, epoch - 1))
            start_over = before.where("arrived").count() + come.count() > most
        if start_over:  # what has come is committed, and so on the page if it is new enough
            state = base_page(spark, root, p).withColumn("arrived", F.lit(False))
        else:
            state = before.drop("resets").unionByName(come)
        resets = F.lit(0 if epoch == 0 else before.agg(F.coalesce(F.max("resets"), F.lit(0))).first()[0] + int(start_over))
        state.withColumn("resets", resets.cast("int")).coalesce(1).write.mode("overwrite").parquet(_state(folder, epoch))
        if epoch > 1:
            manifest.delete(spark, [_state(folder, epoch - 2)])
    finally:
        come.unpersist()


def live_list(spark: SparkSession, root: str, p: Search, folder: str, available_now: bool = False, interval: str = "1 second", most: int = MAX_ARRIVALS) -> StreamingQuery:
    """Keep the list of the logs that match below the folder; see live_rows()."""
    show = partial(_arrive, root=root, p=p, folder=folder, most=most)
    return logs_follow(spark, root, p, show, f"{folder}/checkpoint", available_now, interval)


def live_rows(spark: SparkSession, p: Search, folder: str) -> DataFrame:
    """The list as it stands: arrivals and base page, each row once, newest first, from the range's start on."""
    epochs = spark.read.parquet(f"{folder}/state")
    last = epochs.agg(F.max("epoch")).first()[0]
    state = epochs.where(F.col("epoch") == last).drop("epoch", "resets")
    return search.live_merge(state.where("NOT arrived").drop("arrived"), state.where("arrived").drop("arrived"), p.start)
