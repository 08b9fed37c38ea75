"""Traces: lookup, summaries, trees and waterfalls."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions import telemetry as tel

#: Spans that the lookup of one trace returns; the forms over all traces take every span.
MAX_SPANS = 5000
#: Tree rows in an Arrow batch at most.
OUT_ROWS = 10_000
#: The least width of a bar, and the slack of logs after a trace's end and around a linked span.
MIN_WIDTH, LOG_SLACK_US, LINK_SLACK_US = 0.5, 1_000_000, 86_400_000_000
_TREE = pa.schema([("project", pa.string()), ("trace_id", pa.string()), ("span_id", pa.string()), ("position", pa.int32()), ("depth", pa.int32()), ("is_orphan", pa.bool_()), ("has_children", pa.bool_())])


def check_trace_id(trace_id: str) -> str:
    """32 hexadecimal characters, lower-cased."""
    if not re.fullmatch(r"[0-9a-fA-F]{32}", trace_id):
        raise ValueError("a trace id has 32 hexadecimal characters")
    return trace_id.lower()


def trace_get(spans: DataFrame, project: str, trace_id: str, start: datetime, end: datetime, cap: int = MAX_SPANS) -> DataFrame:
    """The trace's spans in the range, oldest first; cap + 1 rows at most, the last one telling that there are more."""
    found = spans.where(tel.in_range(F.col("ts"), start, end) & (F.col("project") == project) & (F.col("trace_id") == check_trace_id(trace_id)))
    return found.orderBy("ts", "ingest_ts").limit(cap + 1)


def capped(spans: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` spans of every trace; all of them without a cap."""
    if cap is None:
        return spans
    order = Window.partitionBy("project", "trace_id").orderBy("ts", "ingest_ts", "span_id")
    return spans.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def trace_summary(spans: DataFrame, cap: int | None = None) -> DataFrame:
    """start_ts, end_ts, duration_ns, services and spans of every trace, over all its spans or its first `cap`."""
    out = capped(spans, cap).groupBy("project", "trace_id").agg(
        F.min("ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.array_sort(F.collect_set("service")).alias("services"), F.count("*").alias("spans")
    )
    return out.withColumn("duration_ns", F.greatest((F.unix_micros("end_ts") - F.unix_micros("start_ts")) * 1000, F.lit(0)))


def depth_first(ids: list[str], parents: list[str | None]) -> list[tuple[str, int, bool, bool]]:
    """(span_id, depth, is_orphan, has_children) in depth-first order; spans sorted by (ts, span_id), ids unique."""
    known: set[str] = set(ids)
    children: dict[str | None, list[str]] = {}
    for i, p in zip(ids, parents, strict=True):
        children.setdefault(p, []).append(i)
    seen: set[str] = set()
    out = []

    def walk(root: str, orphan: bool) -> None:
        stack = [(root, 0, orphan)]
        while stack:
            i, depth, lost = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            below = [c for c in children.get(i, ()) if c not in seen]
            out.append((i, depth, lost, bool(below)))
            stack.extend((c, depth + 1, False) for c in reversed(below))

    for i, p in zip(ids, parents, strict=True):
        if p is None or p not in known:
            walk(i, p is not None)
    for i in ids:  # reached from no root: a cycle
        if i not in seen:
            walk(i, True)
    return out


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """The values of text columns as numbers, equal for equal values across the columns; -1 for null."""
    whole = pa.chunked_array([c.cast(pa.large_string()) for c in columns]).combine_chunks().dictionary_encode()
    codes = np.nan_to_num(whole.indices.to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """The number of each row's trace; the rows of a trace follow each other."""
    change = np.zeros(batch.num_rows, bool)
    for column in batch.columns[:2]:
        code = _codes(column)[0]
        change[1:] |= code[1:] != code[:-1]
    return np.cumsum(change)


def _along(parent: np.ndarray, value: np.ndarray, add=np.add) -> tuple[np.ndarray, np.ndarray]:
    """Each span's value together with those of all its ancestors, by doubling the distance to the ancestor looked at; and
    whether it has a root at all (none in a cycle)."""
    out, up = value.copy(), parent.copy()
    for _ in range(len(parent).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            break
        out[on] = add(out[on], out[up[on]])
        up[on] = up[up[on]]
    return out, up < 0


def positions(trace: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in its trace, depth, has a root) of every span of a forest; spans are sorted by trace and then as siblings
    are, and parent is a row number, -1 for roots. Subtree sizes come from the deepest level up; a span lies behind its
    parent and the subtrees of its earlier siblings, and these distances add up along its ancestors."""
    n = len(parent)
    depth, rooted = _along(parent, (parent >= 0).astype(np.int64))
    size = np.ones(n, np.int64)
    by_depth = np.flatnonzero(rooted)[np.argsort(-depth[rooted], kind="stable")]
    bounds = np.append(np.flatnonzero(np.diff(depth[by_depth], prepend=-1)), len(by_depth))
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        own = by_depth[first:last]
        if depth[own[0]]:
            np.add.at(size, parent[own], size[own])
    order = np.lexsort((np.arange(n), parent, trace))
    before = np.cumsum(size[order]) - size[order]
    new = np.append(True, (trace[order][1:] != trace[order][:-1]) | (parent[order][1:] != parent[order][:-1]))[:n]
    before -= np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), n)))
    step = np.zeros(n, np.int64)
    step[order] = before
    return _along(parent, step + (parent >= 0))[0], depth, rooted


def tree_rows(batch: pa.RecordBatch, hide: set[str]) -> pa.RecordBatch:
    """The tree rows of whole traces (project, trace_id, span_id, parent_span_id), sorted as trace_tree() sorts them."""
    trace = _runs(batch)
    ids, parents = _codes(batch.column(2), batch.column(3))
    room = int(max(ids.max(), parents.max())) + 1
    key = trace * room + ids
    order = np.argsort(key)
    at = np.minimum(np.searchsorted(key[order], trace * room + parents), len(key) - 1)
    found = (parents >= 0) & (key[order][at] == trace * room + parents)
    parent = np.where(found, order[at], -1)
    lost = (parents >= 0) & ~found
    position, depth, rooted = positions(trace, parent)
    more = np.bincount(parent[found], minlength=len(parent)) > 0
    shown = np.ones(len(parent), bool)
    if hide:
        named = np.isin(np.array(batch.column(2).to_numpy(zero_copy_only=False), dtype=object), list(hide))
        shown = ~_along(parent, np.where(parent >= 0, named[parent], False), np.logical_or)[0]
    for t in np.unique(trace[~rooted]).tolist():  # a cycle: the few such traces are walked span by span
        own = np.flatnonzero(trace == t)
        names = batch.column(2).take(pa.array(own)).to_pylist()
        where = dict(zip(names, own.tolist(), strict=True))
        shown[own], skip = False, None
        for n, (i, d, orphan, below) in enumerate(depth_first(names, batch.column(3).take(pa.array(own)).to_pylist())):
            r = where[i]
            position[r], depth[r], lost[r], more[r] = n, d, orphan, below
            if skip is None or d <= skip:
                shown[r], skip = True, d if i in hide else None
    kept = np.flatnonzero(shown)
    kept = kept[np.lexsort((position[kept], trace[kept]))]
    first = np.flatnonzero(np.append(True, np.diff(trace[kept]) != 0))[: len(kept)]
    number = np.arange(len(kept)) - np.repeat(first, np.diff(np.append(first, len(kept))))
    names = batch.select([0, 1, 2]).take(pa.array(kept))
    return pa.RecordBatch.from_arrays([*names.columns, pa.array(number.astype(np.int32)), pa.array(depth[kept].astype(np.int32)), pa.array(lost[kept]), pa.array(more[kept])], schema=_TREE)


def trace_tree(spans: DataFrame, cap: int | None = None, collapsed: list[str] | None = None) -> DataFrame:
    """position, depth, is_orphan and has_children of every span, in depth-first order of its trace.

    Roots have no parent or one that is absent (orphans); siblings go by (ts, span_id); spans that no
    root reaches follow as orphans. A span id counts once (its first row). Traces are whole, or cut to
    `cap` spans where one is given. `collapsed` hides the descendants of the spans named. All traces of a
    block of rows are laid out together, in arrays; a block holds whole traces.
    """
    first = Window.partitionBy("project", "trace_id", "span_id").orderBy("ts", "ingest_ts")
    single = capped(spans, cap).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    rows = single.select("project", "trace_id", "span_id", "parent_span_id", F.unix_micros("ts").alias("us"))
    hide = set(collapsed or ())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the trace that the batch may have cut
        for batch in batches:
            if not batch.num_rows:
                continue
            trace = _runs(batch)
            last = int(np.searchsorted(trace, trace[-1]))
            same = bool(held) and all(held[0].column(i)[0].as_py() == batch.column(i)[0].as_py() for i in (0, 1))
            if last or not same:  # what was held is whole, with this batch's first rows if they belong to it
                parts = [*held, *([batch.slice(0, last)] if last else [])]
                if parts:
                    yield from _in_pieces(tree_rows(_joined(parts), hide))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from _in_pieces(tree_rows(_joined(held), hide))

    # a trace is one run of sorted rows; many traces share a batch, and a long one spans many
    dealt = rows.repartition("project", "trace_id").sortWithinPartitions("project", "trace_id", "us", "span_id")
    return dealt.select("project", "trace_id", "span_id", "parent_span_id").mapInArrow(build, "project string, trace_id string, span_id string, position int, depth int, is_orphan boolean, has_children boolean")


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _in_pieces(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, OUT_ROWS):
        yield rows.slice(at, OUT_ROWS)


def waterfall_bars(spans: DataFrame) -> DataFrame:
    """offset_pct and width_pct of every span within its trace's duration."""
    total = trace_summary(spans).select("project", "trace_id", F.unix_micros("start_ts").alias("_start"), F.col("duration_ns").alias("_total"))
    rows = spans.join(total, ["project", "trace_id"])
    width = F.least(F.greatest(F.col("duration_ns") / F.col("_total") * 100, F.lit(MIN_WIDTH)), F.lit(100.0))
    offset = F.least(F.greatest((F.unix_micros("ts") - F.col("_start")) * 1000 / F.col("_total") * 100, F.lit(0.0)), 100 - width)
    some = F.col("_total") > 0
    return rows.withColumns({"offset_pct": F.when(some, offset).otherwise(0.0), "width_pct": F.when(some, width).otherwise(MIN_WIDTH)}).drop("_start", "_total")


def first_error_span(spans: DataFrame, tree: DataFrame) -> DataFrame:
    """The first span with status error of each trace, in tree order."""
    first = Window.partitionBy("project", "trace_id", "span_id").orderBy("ts", "ingest_ts")
    single = spans.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project", "trace_id", "span_id", "status_code")
    errors = tree.join(single.where("status_code = 2"), ["project", "trace_id", "span_id"])
    return errors.groupBy("project", "trace_id").agg(F.min_by("span_id", "position").alias("span_id"))


def span_links(spans: DataFrame) -> DataFrame:
    """Each link of each span, with the linked span's name and service where it is within a day of the span."""
    kind = "array<struct<trace_id:string,span_id:string>>"
    links = spans.where(F.col("links").isNotNull()).select("project", F.col("trace_id").alias("from_trace_id"), F.col("span_id").alias("from_span_id"), F.unix_micros("ts").alias("_us"), F.explode(F.from_json("links", kind)).alias("l"))
    links = links.select("project", "from_trace_id", "from_span_id", "_us", "l.trace_id", "l.span_id")
    target = spans.select("project", "trace_id", "span_id", F.unix_micros("ts").alias("_to_us"), F.col("service").alias("to_service"), F.col("name").alias("to_name"))
    near = (F.abs(F.col("_to_us") - F.col("_us")) <= LINK_SLACK_US) & (links["project"] == target["project"]) & (links["trace_id"] == target["trace_id"]) & (links["span_id"] == target["span_id"])
    return links.join(target, near, "left").select(links["project"], "from_trace_id", "from_span_id", links["trace_id"].alias("to_trace_id"), links["span_id"].alias("to_span_id"), "to_service", "to_name")


def trace_logs(logs: DataFrame, spans: DataFrame) -> DataFrame:
    """The logs of each trace from its start to a second past its end."""
    bounds = trace_summary(spans).select("project", "trace_id", F.unix_micros("start_ts").alias("_a"), (F.unix_micros("end_ts") + LOG_SLACK_US).alias("_b"))
    us = F.unix_micros("ts")
    return logs.join(bounds, ["project", "trace_id"]).where((us >= F.col("_a")) & (us < F.col("_b"))).drop("_a", "_b")
