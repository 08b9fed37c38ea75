"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a key hashed from its id and text. Within its source the documents are
range-sorted by that key: equal-width key ranges are sorted on their own, and a prefix sum over the
table of bucket totals gives each bucket's offset, so a source that holds a third of all rows is
spread over many tasks. A bucket holds about max(bucket_rows, sqrt(rows of the source)) documents,
so neither it nor the table of totals grows beyond the square root of a source. The source is then
cut at its exact budget: whole epochs first, then the documents below the cut, the last of them in
part. Where one (id, text) is repeated more than a bucket's rows, its copies follow the bucket's other
rows in chunks of their own: as they are equal, it does not matter which of them is taken.

Defined cases: a null text has size 0; a null source is a source of its own and sorts last; ties
of the key are broken by doc_id, then size (rows that tie then are equal); repeated rows are documents of their own; no
documents give an empty result; extra columns are ignored (mix) or kept (mixed_documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import broadcast_if_small, materialize

#: The weights repeat over the sources in code point order; at most three epochs.
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BUCKET_ROWS = 5_000
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per source: rank, total size, target and key buckets.

    Water-filling in closed form: with the sources in order of cap / weight, the level that the
    uncapped sources share is the largest of (total - caps before) / (weights not before). The
    unpartitioned windows here run over one row per source, not over documents.
    """
    total = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_rows"))
    ranked = total.withColumn("_rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("_source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", F.col("_source_size") * max_epochs)
    before = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("_source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    return (
        ranked.withColumn("_level", level)
        .withColumn("_target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.max("_level").over(everything)))
        .withColumn("_budget", F.least(F.round("_target").cast("long"), F.col("_cap")))
        .withColumn("_bucket_rows", F.greatest(F.lit(bucket_rows).cast("double"), F.floor(F.sqrt("_rows"))))
        .withColumn("_buckets", F.ceil(F.col("_rows") / F.col("_bucket_rows")))
        .select("_source", "_rank", "_source_size", "_target", "_budget", "_buckets", "_bucket_rows")
    )


def _taken(sized: DataFrame, narrow: DataFrame, seed: str, **options) -> DataFrame:
    """sized (with _source, _size, _key and any other columns) plus _source_size, _target, _taken."""
    targets = broadcast_if_small(materialize(source_targets(narrow, **options), "mix-targets"))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    bucket = F.floor(share * F.col("_buckets") / F.lit(1 << 32)).cast("long")

    def dealt(df: DataFrame) -> DataFrame:
        named = targets.withColumnRenamed("_source", "_named")
        return df.join(named, df["_source"].eqNullSafe(named["_named"])).drop("_named").withColumn("_bucket", bucket)

    ranged = dealt(narrow)
    full = ranged.groupBy("_rank", "_bucket", "_bucket_rows").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * F.col("_bucket_rows")).select("_rank", "_bucket")
    crowded = materialize(full, "mix-crowded")
    copies = None
    if crowded.limit(1).count():
        of = ranged.join(broadcast_if_small(crowded), ["_rank", "_bucket"]).groupBy("_rank", "_bucket", "_bucket_rows", "_key").agg(F.count("*").alias("_n"))
        copies = broadcast_if_small(materialize(of.where(F.col("_n") > F.col("_bucket_rows")).select("_rank", "_bucket", "_key", F.ceil(F.col("_n") / F.col("_bucket_rows")).alias("_chunks")), "mix-copies"))

    def chunked(df: DataFrame) -> DataFrame:
        """df with the chunk of a row that has very many copies; 0 for all others, which come first in their bucket."""
        if copies is None:
            return df.withColumn("_chunk", F.lit(0).cast("long"))
        own = F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) * (1 << 20) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_chunks")) + 1
        return df.join(copies, ["_rank", "_bucket", "_key"], "left").withColumn("_chunk", F.coalesce(F.when(F.col("_chunks").isNotNull(), own), F.lit(0)).cast("long")).drop("_chunks")

    # which copy falls into which chunk must not change between the two uses below
    narrow, sized = (ranged, dealt(sized)) if copies is None else (dealt(sized),) * 2
    rows = chunked(sized) if copies is None else materialize(chunked(sized), "mix-chunked")
    starts = (
        (chunked(narrow) if copies is None else rows)
        .groupBy("_rank", "_bucket", "_chunk")
        .agg(F.sum("_size").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_bucket", "_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("_rank", "_bucket", "_chunk", "_offset")
    )
    order = Window.partitionBy("_rank", "_bucket", "_chunk").orderBy("_key", F.asc_nulls_first("doc_id"), "_size")
    run = rows.withColumn("_before", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    epochs = F.when(F.col("_source_size") > 0, F.expr("_budget div _source_size")).otherwise(0)
    rest = F.col("_budget") - epochs * F.col("_source_size") - F.col("_offset") - F.col("_before")
    return (
        run.join(starts, ["_rank", "_bucket", "_chunk"])
        .withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), rest)))
        .withColumn("_epochs", epochs)
        .withColumn("_taken", F.col("_epochs") * F.col("_size") + F.col("_part"))
    )


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.withColumns({"_source": F.col("source"), "_size": n_words(F.col("text")), "_key": mix_key(F.col("doc_id"), F.col("text"), seed)})


def mix(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words the mix takes) of every document."""
    narrow = materialize(_sized(docs.select("doc_id", "text", "source"), seed).select("doc_id", "_source", "_size", "_key"), "mix-sizes")
    return _taken(narrow, narrow, seed, **options).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document once per epoch taken; the document at
    the cut once more with as many of its words as the budget still holds, joined by single spaces."""
    sized = _sized(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source"), seed).drop("text", "source")  # the text travels once, in its row
    narrow = materialize(sized.select("_source", "_size", "_key"), "mix-sizes")
    taken = _taken(sized, narrow, seed, **options)
    whole = F.col("_epochs") + F.when((F.col("_part") == F.col("_size")) & (F.col("_size") > 0), 1).otherwise(0)
    cut = (F.col("_part") > 0) & (F.col("_part") < F.col("_size"))
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), whole.cast("int")),
        F.when(cut, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>")),
    )
    head = F.array_join(F.slice(F.split(F.regexp_replace(F.col("_row.text"), r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("_copy").cast("int")), " ")
    out = taken.withColumn("_copy", F.explode(copies))
    new = {"text": head} | ({"n_chars": F.length(head).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {})
    part = F.col("_copy") > 0
    return out.select(*((F.when(part, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM d GROUP BY source),
w AS (SELECT *, CAST((rnk - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS lvl
      FROM w WINDOW b AS (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(lvl) OVER ()) AS target, cap FROM l),
g AS (SELECT *, least(CAST(round(target) AS BIGINT), cap) AS budget FROM t),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target,
             CASE WHEN g.source_size > 0 THEN g.budget // g.source_size ELSE 0 END AS epochs, g.budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM r
"""
