"""Traces built at random against plain recursion, and a few shapes by hand."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import search, traces
from tests.data import H0, H2, logs, spans

MS = 1_000_000
ms = lambda n: timedelta(milliseconds=n)


def made(seed: int = 5, n_traces: int = 25) -> list[dict]:
    r, out = random.Random(seed), []
    for t in range(n_traces):
        begin = r.randint(0, 7_000_000)
        for i in range(r.randint(1, 14)):
            parent = None if i == 0 else r.choice([f"{t}-{r.randrange(i)}"] * 5 + [f"{t}-gone", None])
            out.append({
                "ts": H0 + ms(begin + r.randint(0, 900) * (i > 0)), "trace_id": f"{t:032x}", "span_id": f"{t}-{i}", "parent_span_id": parent, "service": r.choice(("mill", "forge", "kiln")), "name": r.choice(("grind", "melt", "bake")),
                "kind": r.randint(0, 5), "status_code": r.choice((0, 0, 1, 2)), "duration_ns": r.randint(0, 400) * MS, "project": "p1" if t % 6 else "p9", "attributes": r.choice((None, '{"step":"3"}')),
            })
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def given():
    return made()


@pytest.fixture(scope="module")
def rows(spark, given):
    return spans(spark, given)


def by_trace(given):
    out = {}
    for s in given:
        out.setdefault((s["project"], s["trace_id"]), []).append(s)
    return out


def plain_tree(own, hidden=()):
    """(span, depth, orphan, has children) by recursion; without cycles."""
    ids = {s["span_id"] for s in own}
    below = lambda p: sorted((s for s in own if s["parent_span_id"] == p), key=lambda s: (s["ts"], s["span_id"]))

    def visit(s, depth, lost):
        children = below(s["span_id"])
        yield s["span_id"], depth, lost, bool(children)
        if s["span_id"] not in hidden:
            for c in children:
                yield from visit(c, depth + 1, False)

    for s in sorted(own, key=lambda s: (s["ts"], s["span_id"])):
        if s["parent_span_id"] is None or s["parent_span_id"] not in ids:
            yield from visit(s, 0, s["parent_span_id"] is not None)


BASE = search.Search("p1", H0, H2)


@pytest.mark.parametrize(("filters", "keep"), [
    ({}, lambda s: True), ({"service": "kiln"}, lambda s: s["service"] == "kiln"), *[({"status": name}, lambda s, c=c: s["status_code"] == c) for c, name in enumerate(("unset", "OK", "error"))],
    ({"min_duration_ns": 250 * MS}, lambda s: s["duration_ns"] >= 250 * MS), ({"root": True}, lambda s: s["parent_span_id"] is None), ({"name": "melt"}, lambda s: s["name"] == "melt"),
    ({"trace_id": f"{11:032X}"}, lambda s: s["trace_id"] == f"{11:032x}"), ({"attrs": ("step:3",)}, lambda s: s["attributes"] is not None), ({"start": H0 + ms(3_000_000)}, lambda s: s["ts"] >= H0 + ms(3_000_000)),
])
def test_spans_search_equals_plain_filters(given, rows, filters, keep):
    want = [(s["ts"], n, s["span_id"]) for n, s in enumerate(given) if s["project"] == "p1" and keep(s)]
    got = [r["span_id"] for r in search.spans_search(rows, replace(BASE, **(filters | {"limit": 1000}))).collect()]
    assert got == [i for *_, i in sorted(want, reverse=True)] and got


def test_lookup_and_summary_equal_plain_ones(given, rows):
    summary = {(r["project"], r["trace_id"]): r for r in traces.trace_summary(rows).collect()}
    groups = by_trace(given)
    assert summary.keys() == groups.keys()
    for key, own in groups.items():
        start, end = min(s["ts"] for s in own), max(s["ts"] + ms(s["duration_ns"] // MS) for s in own)
        r = summary[key]
        assert (r["start_ts"], r["end_ts"], r["spans"], r["services"], r["duration_ns"]) == (start, end, len(own), sorted({s["service"] for s in own}), int((end - start) / ms(1)) * MS)
    own = groups["p1", f"{7:032x}"]
    got = [r["ts"] for r in traces.trace_get(rows, "p1", f"{7:032X}", H0, H2 + timedelta(hours=1)).collect()]
    assert got == sorted(s["ts"] for s in own)
    assert traces.trace_get(rows, "p1", own[0]["trace_id"], H0, H2 + timedelta(hours=1), cap=1).count() == min(2, len(own))
    for bad in ("", "7", "g" * 32, "0" * 33):
        with pytest.raises(ValueError):
            traces.trace_get(rows, "p1", bad, H0, H2)
    for key, n in {k: len(v) for k, v in groups.items()}.items():
        cut = traces.trace_summary(rows.where((F.col("project") == key[0]) & (F.col("trace_id") == key[1])), cap=3).first()
        assert cut["spans"] == min(n, 3)
        break


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_trees_equal_plain_recursion(spark, given, rows, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for hidden in ((), tuple(f"{t}-0" for t in range(0, 25, 2)) + ("3-1", "9-2")):
            got = {}
            for r in traces.trace_tree(rows, collapsed=list(hidden)).orderBy("position").collect():
                got.setdefault((r["project"], r["trace_id"]), []).append((r["span_id"], r["depth"], r["is_orphan"], r["has_children"]))
            assert got == {k: list(plain_tree(own, hidden)) for k, own in by_trace(given).items()}
        assert traces.trace_tree(rows.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bars_lie_within_their_trace(given, rows):
    bars = {r["span_id"]: (r["offset_pct"], r["width_pct"]) for r in traces.waterfall_bars(rows).collect()}
    for own in by_trace(given).values():
        start = min(s["ts"] for s in own)
        total = max(s["ts"] + ms(s["duration_ns"] // MS) for s in own) - start
        for s in own:
            offset, width = bars[s["span_id"]]
            if not total:
                assert (offset, width) == (0, traces.MIN_WIDTH)
                continue
            share = ms(s["duration_ns"] // MS) / total * 100
            assert width == pytest.approx(min(max(share, traces.MIN_WIDTH), 100)) and offset == pytest.approx(min((s["ts"] - start) / total * 100, 100 - width))


def test_cycles_and_repeated_spans(spark):
    of = lambda *given: spans(spark, [{"ts": H0 + ms(i), "trace_id": "c" * 32, "span_id": s, "parent_span_id": p} for i, (s, p) in enumerate(given)])
    ring = traces.trace_tree(of(("k", "m"), ("l", "k"), ("m", "l"), ("own", "own"))).collect()
    assert sorted(r["span_id"] for r in ring) == ["k", "l", "m", "own"] and min(r["depth"] for r in ring) == 0
    twice = traces.trace_tree(of(("k", None), ("l", "k"), ("l", "k"))).collect()
    assert sorted((r["span_id"], r["depth"]) for r in twice) == [("k", 0), ("l", 1)]


def test_first_errors_equal_plain_ones(given, rows):
    got = {(r["project"], r["trace_id"]): r["span_id"] for r in traces.first_error_span(rows, traces.trace_tree(rows)).collect()}
    code = {s["span_id"]: s["status_code"] for s in given}
    want = {k: next((i for i, *_ in plain_tree(own) if code[i] == 2), None) for k, own in by_trace(given).items()}
    assert got == {k: v for k, v in want.items() if v}


def test_links_find_spans_within_a_day(spark):
    day = timedelta(days=1)
    rows = spans(spark, [
        {"ts": H0, "trace_id": "d" * 32, "span_id": "from", "links": '[{"trace_id":"%s","span_id":"near"},{"trace_id":"%s","span_id":"far"}]' % ("e" * 32, "e" * 32)},
        {"ts": H0 + day, "trace_id": "e" * 32, "span_id": "near", "service": "forge", "name": "melt"}, {"ts": H0 + day + ms(1), "trace_id": "e" * 32, "span_id": "far", "service": "forge", "name": "melt"},
    ])
    assert {r["to_span_id"]: (r["from_span_id"], r["to_service"], r["to_name"]) for r in traces.span_links(rows).collect()} == {"near": ("from", "forge", "melt"), "far": ("from", None, None)}


def test_logs_of_a_trace_reach_a_second_past_its_end(spark, given, rows):
    own = by_trace(given)["p1", f"{8:032x}"]
    start, end = min(s["ts"] for s in own), max(s["ts"] + ms(s["duration_ns"] // MS) for s in own)
    at = {"too early": start - ms(1), "first": start, "last": end + ms(999), "too late": end + ms(1000)}
    lines = logs(spark, [{"ts": t, "trace_id": own[0]["trace_id"], "body": b} for b, t in at.items()] + [{"ts": start, "trace_id": "f" * 32, "body": "of no trace"}])
    assert sorted(r["body"] for r in traces.trace_logs(lines, rows).collect()) == ["first", "last"]


def test_a_long_trace_is_whole(spark):
    n = traces.MAX_SPANS + 400
    own = [{"ts": H0 + ms(3 * i), "trace_id": "a" * 32, "span_id": f"{i:06d}", "parent_span_id": f"{i // 3:06d}" if i else None, "service": "kiln" if i == n - 1 else "mill", "status_code": 2 if i == n - 2 else 0, "duration_ns": MS, "project": "p1"} for i in range(n)]
    rows = spans(spark, own)
    one = traces.trace_summary(rows).first()
    assert (one["spans"], one["services"], one["duration_ns"]) == (n, ["kiln", "mill"], (3 * n - 2) * MS)
    got = [(r["span_id"], r["depth"], r["is_orphan"], r["has_children"]) for r in traces.trace_tree(rows).orderBy("position").collect()]
    assert got == traces.depth_first([s["span_id"] for s in own], [s["parent_span_id"] for s in own]) and len(got) == n
    assert [r["span_id"] for r in traces.first_error_span(rows, traces.trace_tree(rows)).collect()] == [f"{n - 2:06d}"]
    assert traces.trace_tree(rows, collapsed=["000000"]).count() == 1 and traces.waterfall_bars(rows).count() == n


def test_arrays_lay_out_traces_as_a_walk_does(spark):
    """Random forests with orphans, cycles, trees that hang from cycles, and chains; batches that cut traces."""
    import random

    r, rows, want = random.Random(11), [], {}
    for t in range(60):
        n = r.choice((1, 2, 7, 40))
        own = [(f"{t}", f"{i:03d}", r.choice([None, "gone", *(f"{j:03d}" for j in range(n))]) if r.random() < 0.4 else (f"{i - 1:03d}" if i and t % 2 else f"{r.randrange(n):03d}")) for i in range(n)]
        r.shuffle(own)
        for at, (trace, i, p) in enumerate(own):
            rows.append({"ts": H0 + timedelta(seconds=at // 3), "trace_id": trace, "span_id": i, "parent_span_id": p})
        order = sorted(range(n), key=lambda k: (k // 3, own[k][1]))
        want[f"{t}"] = traces.depth_first([own[k][1] for k in order], [own[k][2] for k in order])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for hide in ([], ["003", "010", "000"]):
            got = traces.trace_tree(spans(spark, rows), collapsed=hide).orderBy("trace_id", "position").collect()
            for t, tree in want.items():
                shown, skip = [], None
                for row in tree:
                    if skip is None or row[1] <= skip:
                        skip = row[1] if row[0] in hide else None
                        shown.append(row)
                own = [x for x in got if x["trace_id"] == t]
                assert [(x["span_id"], x["depth"], x["is_orphan"], x["has_children"]) for x in own] == shown
                assert [x["position"] for x in own] == list(range(len(own)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_deep_and_wide_trace(spark):
    n = 3_000
    rows = [{"ts": H0, "trace_id": "t", "span_id": f"{i:05d}", "parent_span_id": f"{i - 1:05d}" if i % 1_500 else None} for i in range(n)]
    got = traces.trace_tree(spans(spark, rows)).orderBy("position").collect()
    assert [(x["span_id"], x["depth"]) for x in got] == [(f"{i:05d}", i % 1_500) for i in range(n)]
