"""Metric series: deltas of cumulative points, and values per group and step."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel

LOOKBACK = timedelta(minutes=10)
MAX_SERIES = 20


def aligned_start(start: datetime, step_s: int) -> datetime:
    us = tel.micros(start)
    return datetime(1970, 1, 1) + timedelta(microseconds=us - us % (step_s * 1_000_000))


#: What a delta needs of the point before.
LAGS = ("start_ts", "value_int", "value_double", "count", "sum", "bucket_counts", "bucket_bounds")


def with_before(rows: DataFrame, chunk: timedelta | None = None) -> DataFrame:
    """rows with _has and _<column> of the series' point before, in order of (ts, ingest_ts).

    With a chunk, no task holds a series: the rows of a series are split by spans of time, and the last point of each such
    span is carried, as one more row, to the next one that has any."""
    order = ("ts", "ingest_ts")
    before = lambda w: (F.lag(F.lit(True)).over(w).alias("_has"), *(F.lag(c).over(w).alias(f"_{c}") for c in LAGS))
    if chunk is None:
        return rows.select("*", *before(Window.partitionBy("series_hash").orderBy(*order)))
    rows = rows.withColumn("_chunk", F.floor(F.unix_micros("ts") / (chunk // timedelta(microseconds=1))).cast("long"))
    last = rows.groupBy("series_hash", "_chunk").agg(F.max_by(F.struct(*order, *LAGS), F.struct(*order)).alias("_last"))
    following = F.lead("_chunk").over(Window.partitionBy("series_hash").orderBy("_chunk"))
    carried = last.select("series_hash", following.alias("_chunk"), "_last.*", F.lit(0).alias("_own")).where(F.col("_chunk").isNotNull())
    both = rows.withColumn("_own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy("series_hash", "_chunk").orderBy("_own", *order)
    return both.select("*", *before(w)).where("_own = 1").drop("_own", "_chunk")


def series_deltas(points: DataFrame, start: datetime, end: datetime, lookback: timedelta = LOOKBACK, chunk: timedelta | None = None) -> DataFrame:
    """Each point of [start, end) with its change since the series' point before: dv, dc, ds, db, and is_reset, is_fresh.

    A delta point stands for itself. A cumulative one is the difference to its predecessor; the whole
    value after a reset (start changed, value or count fell), or when it is the first and began within
    the rows read; nothing when it is the first otherwise. New bounds without a reset void the bucket
    delta only. Rows are read from `lookback` before start. `chunk`: see with_before(); for tables in
    which one series may hold a large share of the rows.
    """
    read_from = start - lookback
    rows = with_before(points.where(tel.in_range(F.col("ts"), read_from, end)), chunk)
    value, before = F.coalesce("value_double", F.col("value_int").cast("double")), F.coalesce("_value_double", F.col("_value_int").cast("double"))
    has, delta = F.coalesce("_has", F.lit(False)), F.coalesce(F.col("temporality") == tel.DELTA, F.lit(False))
    fell = F.coalesce(F.col("value_int") < F.col("_value_int"), value < before, F.lit(False)) | F.coalesce(F.col("count") < F.col("_count"), F.lit(False))
    reset = has & (~F.col("start_ts").eqNullSafe(F.col("_start_ts")) | fell)
    fresh = ~has & F.col("start_ts").isNotNull() & (F.col("start_ts") >= tel.at(tel.micros(read_from)))
    exact = (F.col("value_int").cast("decimal(38,0)") - F.col("_value_int").cast("decimal(38,0)")).cast("double")

    def change(own: Column, difference: Column) -> Column:
        return F.when(delta | reset | F.coalesce(fresh, F.lit(False)), own).when(has, difference)

    buckets = F.when(F.col("bucket_bounds").eqNullSafe(F.col("_bucket_bounds")), F.zip_with("bucket_counts", "_bucket_counts", lambda a, b: a - b))
    return (
        rows.withColumns({
            "dv": change(value, F.coalesce(exact, value - before)), "dc": change(F.col("count"), F.col("count") - F.col("_count")),
            "ds": change(F.col("sum"), F.col("sum") - F.col("_sum")), "db": change(F.col("bucket_counts"), buckets),
            "is_reset": reset, "is_fresh": F.coalesce(fresh, F.lit(False)), "_kept": delta | has | F.coalesce(fresh, F.lit(False)),
        })
        .where(F.col("_kept") & (F.col("ts") >= tel.at(tel.micros(start))))
        .drop("_has", "_kept", *(f"_{c}" for c in LAGS))
    )


def grouped(rows: DataFrame, group_by: str | None, step_s: int) -> DataFrame:
    """rows plus grp (the group's label) and step_ts."""
    return rows.withColumns({"grp": tel.group_label(group_by), "step_ts": tel.step_bucket(F.col("ts"), step_s)})


def counter_increase(deltas: DataFrame) -> DataFrame:
    """(grp, step_ts, value): the sum of value changes of grouped deltas."""
    return deltas.groupBy("grp", "step_ts").agg(F.sum("dv").alias("value"))


def counter_rate(deltas: DataFrame, step_s: int) -> DataFrame:
    return counter_increase(deltas).withColumn("value", F.col("value") / step_s)


def gauge(points: DataFrame, function: str) -> DataFrame:
    """(grp, step_ts, value): each series reduced in the step, then the series combined; 'sum' adds the series' last points."""
    value = F.coalesce("value_double", F.col("value_int").cast("double"))
    rows = points.withColumn("_v", value).where(F.col("_v").isNotNull())
    if function == "sum":
        one = F.max_by("_v", F.struct("ts", "ingest_ts"))
        return rows.groupBy("grp", "series_hash", "step_ts").agg(one.alias("_v")).groupBy("grp", "step_ts").agg(F.sum("_v").alias("value"))
    f = {"avg": F.avg, "min": F.min, "max": F.max}[function]
    return rows.groupBy("grp", "series_hash", "step_ts").agg(f("_v").alias("_v")).groupBy("grp", "step_ts").agg(f("_v").alias("value"))


def histogram_rate(deltas: DataFrame, step_s: int) -> DataFrame:
    return deltas.groupBy("grp", "step_ts").agg((F.sum("dc") / step_s).alias("value"))


def histogram_avg(deltas: DataFrame) -> DataFrame:
    """Sum over count of the changes of points that carry a sum."""
    count = F.sum(F.when(F.col("ds").isNotNull(), F.col("dc")))
    return deltas.groupBy("grp", "step_ts").agg((F.sum("ds") / F.nullif(count, F.lit(0))).alias("value"))


def bucket_cells(deltas: DataFrame) -> DataFrame:
    """(grp, bounds, step_ts, pos, n, series, only, firsts): bucket changes added up per group, bounds, step and bucket.

    series counts the series under these bounds, only those seen under no others, firsts each series of the group once; all
    three are told at one cell each and add up over any cells. Sums merge: no list of points or steps is built. The windows
    run over the sums of a series, where the deltas have left them."""
    rows = deltas.where(F.col("db").isNotNull()).select("series_hash", "grp", "step_ts", F.col("bucket_bounds").alias("bounds"), F.posexplode("db").alias("pos", "n"))
    own = rows.groupBy("series_hash", "grp", "bounds", "step_ts", "pos").agg(F.sum("n").alias("n"))
    series = Window.partitionBy("series_hash", "grp").orderBy("bounds", "step_ts", "pos")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = own.select("grp", "bounds", "step_ts", "pos", "n", F.lag("bounds").over(series).alias("_b"), (F.first("bounds").over(whole) == F.last("bounds").over(whole)).alias("_alone"))
    lead = (~F.col("bounds").eqNullSafe(F.col("_b"))).cast("long")
    told = seen.select("grp", "bounds", "step_ts", "pos", "n", lead.alias("series"), (lead * F.col("_alone").cast("long")).alias("only"), F.col("_b").isNull().cast("long").alias("firsts"))
    return told.groupBy("grp", "bounds", "step_ts", "pos").agg(*(F.sum(c).alias(c) for c in ("n", "series", "only", "firsts")))


def _listed(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells as one row per group, bounds and step, its buckets in order."""
    rows = cells.groupBy("grp", "bounds", "step_ts", *keys).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("_l"))
    return rows.select("grp", "step_ts", "bounds", F.transform("_l", lambda x: x["n"]).alias("counts"), *keys)


def bucket_sums(deltas: DataFrame) -> DataFrame:
    """(grp, step_ts, bounds, counts): bucket changes added element by element."""
    return _listed(bucket_cells(deltas))


def _under_best(cells: DataFrame) -> DataFrame:
    """The cells of each group's best bounds (of most series over the whole range, then of the larger total, then the smaller
    ones), with the number of series that were seen under others. Cells are few rows a group."""
    under, group = Window.partitionBy("grp", "bounds"), Window.partitionBy("grp")
    ranked = cells.repartition("grp").withColumns({"_series": F.sum("series").over(under), "_total": F.sum("n").over(under)})
    ranked = ranked.withColumn("_best", F.first("bounds").over(group.orderBy(F.desc("_series"), F.desc("_total"), "bounds")))
    fine = F.sum(F.when(F.col("bounds") == F.col("_best"), F.col("only")).otherwise(0)).over(group)
    return ranked.withColumn("incompatible_series", F.sum("firsts").over(group) - fine).where(F.col("bounds") == F.col("_best"))


def merged_bounds(deltas: DataFrame) -> DataFrame:
    """(grp, bounds, incompatible_series): the bounds under which a group's buckets are merged, and the number of series seen
    under other bounds."""
    whole = deltas.withColumn("step_ts", F.lit(None).cast("timestamp"))  # the choice holds for all steps
    return _under_best(bucket_cells(whole)).select("grp", "bounds", "incompatible_series").distinct()


def merged_buckets(deltas: DataFrame) -> DataFrame:
    """(grp, step_ts, bounds, counts, incompatible_series): bucket_sums() under the bounds of merged_bounds(), in one pass."""
    return _listed(_under_best(bucket_cells(deltas)), "incompatible_series")


def histogram_quantiles(deltas: DataFrame, q: float) -> DataFrame:
    """(grp, step_ts, value, incompatible_series): quantiles of each group's merged buckets."""
    return merged_buckets(deltas).select("grp", "step_ts", tel.histogram_quantile("counts", "bounds", q).alias("value"), "incompatible_series")


def seed_groups(points: DataFrame) -> DataFrame:
    """Every group with points in the range."""
    return points.select("grp").distinct()


def _steps(start: datetime, end: datetime, step_s: int) -> Column:
    """The starts of the steps of [aligned start, end)."""
    first, last = tel.micros(aligned_start(start, step_s)), tel.micros(end)
    return F.transform(F.sequence(F.lit(first), F.lit(max(first, last - 1)), F.lit(step_s * 1_000_000)), lambda u: F.timestamp_micros(u))


def folded(groups: DataFrame, values: DataFrame) -> DataFrame:
    """(grp, total, steps, incompatible_series): each group's values as a map of at most MAX_STEPS steps, and their sum."""
    bad = F.max("incompatible_series") if "incompatible_series" in values.columns else F.max(F.lit(None).cast("long"))
    own = values.groupBy("grp").agg(F.sum("value").alias("total"), F.map_from_entries(F.collect_list(F.struct("step_ts", "value"))).alias("steps"), bad.alias("incompatible_series"))
    return groups.join(own, "grp", "left").withColumn("total", F.coalesce("total", F.lit(0.0)).cast("double"))


def ranked_steps(groups: DataFrame, values: DataFrame, limit: int = MAX_SERIES) -> DataFrame:
    """folded() with the rank of the limit + 1 groups with the largest totals; the last one only tells that there are more."""
    top = folded(groups, values).orderBy(F.desc("total"), "grp").limit(limit + 1)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), "grp")))  # limit + 1 rows


def rank_series(groups: DataFrame, values: DataFrame, limit: int = MAX_SERIES) -> DataFrame:
    """(grp, total, rank) of the limit + 1 groups with the largest sums of values."""
    return ranked_steps(groups, values, limit).select("grp", "total", "rank")


def unfolded(groups: DataFrame, start: datetime, end: datetime, step_s: int) -> DataFrame:
    """One row for every step of [aligned start, end) of folded groups, null where there is no value."""
    spine = groups.withColumn("step_ts", F.explode(_steps(start, end, step_s)))
    return spine.withColumn("value", F.try_element_at("steps", F.col("step_ts"))).drop("steps")


def fill_steps(groups: DataFrame, values: DataFrame, start: datetime, end: datetime, step_s: int) -> DataFrame:
    """(grp, step_ts, value): every step of [aligned start, end) for every group."""
    return unfolded(folded(groups, values), start, end, step_s).select("grp", "step_ts", "value")


def metric_table(series: DataFrame) -> DataFrame:
    """One row per step and one column per group of a metric query's at most MAX_SERIES series."""
    labels = [r["grp"] for r in series.select("grp", "rank").distinct().orderBy("rank").limit(MAX_SERIES).collect()]
    return series.groupBy("step_ts").pivot("grp", labels).agg(F.first("value")).orderBy("step_ts")


def last_value(series: DataFrame) -> DataFrame:
    """Each group's last value that is not null."""
    return series.groupBy("grp").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("step_ts"))).alias("value"))


def incompatible_total(merged: DataFrame) -> DataFrame:
    return merged.agg(F.coalesce(F.sum("incompatible_series"), F.lit(0)).alias("incompatible_series"))
