"""Log search over random rows against plain Python over the same rows."""

import json
import random
from dataclasses import replace
from datetime import timedelta

import pytest

from lumenlake.operators import search
from tests.data import H0, H1, H2, logs, spans

WORDS = ("Alpha", "bravo", "CHARLIE", "delta", "100%_done", "échelle")


def made(seed: int = 21, n: int = 400) -> list[dict]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        attributes = {"zone": r.choice("xyz"), "n": r.randint(1, 4), "a.b": r.choice(("1", "2")), 'odd"key': "v"}
        out.append({
            "ts": H0 + timedelta(seconds=r.choice((r.randint(0, 7199), 3600))), "project": r.choice(("p1", "p1", "p1", "p9")), "service": r.choice(("mill", "forge", "kiln")), "environment": r.choice((None, "lab", "site")),
            "severity_number": r.choice((None, 0, 1, 8, 9, 12, 13, 16, 17, 20, 21, 24)), "body": r.choice((None, f"{r.choice(WORDS)} {r.choice(WORDS)} {i}")), "trace_id": r.choice((None, f"{i % 5:032x}")),
            "attributes": r.choice((None, json.dumps(attributes), json.dumps({"zone": {"inner": "x"}}))),
        })
    return out


@pytest.fixture(scope="module")
def given():
    return made()


@pytest.fixture(scope="module")
def rows(spark, given):
    return logs(spark, given)


BASE = search.Search("p1", H0, H2)
KEYS = ("ts", "service", "body", "severity_number")


def plain(given, keep, start=H0, end=H2, project="p1", limit=100):
    """What a search must give: newest first, among equal times the later stored first, one row more than the limit."""
    own = [(r["ts"], n, r) for n, r in enumerate(given) if r["project"] == project and start <= r["ts"] < end and keep(r)]
    return [tuple(r[k] for k in KEYS) for *_, r in sorted(own, key=lambda x: x[:2], reverse=True)][: limit + 1]


def shown(df):
    return [tuple(r[k] for k in KEYS) for r in df.collect()]


def top(r):
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(r["attributes"] or "{}").items()}


@pytest.mark.parametrize(("filters", "keep"), [
    ({}, lambda r: True), ({"service": "kiln"}, lambda r: r["service"] == "kiln"), ({"environment": "lab"}, lambda r: r["environment"] == "lab"),
    *[({"level": name}, lambda r, low=low: (r["severity_number"] or 0) >= low) for name, low in (("trace", 1), ("DEBUG", 5), ("info", 9), ("Warn", 13), ("error", 17), ("fatal", 21))],
    ({"body": "alpha BRAVO"}, lambda r: "alpha bravo" in (r["body"] or "").lower()), ({"body": "%_D"}, lambda r: "%_d" in (r["body"] or "").lower()), ({"body": "É"}, lambda r: "é" in (r["body"] or "").lower()), ({"body": "a_p"}, lambda r: False),
    ({"trace_id": "0" * 31 + "3"}, lambda r: r["trace_id"] == "0" * 31 + "3"), ({"attrs": ("zone:x",)}, lambda r: top(r).get("zone") == "x"), ({"attrs": ("n:2", "a.b:1")}, lambda r: (top(r).get("n"), top(r).get("a.b")) == ("2", "1")),
    ({"attrs": ('odd"key:v',)}, lambda r: 'odd"key' in top(r)), ({"attrs": ("zone.inner:x",)}, lambda r: False), ({"service": "mill", "level": "warn", "environment": "site"}, lambda r: (r["service"], r["environment"]) == ("mill", "site") and (r["severity_number"] or 0) >= 13),
])
def test_logs_search_equals_plain_filters(given, rows, filters, keep):
    for more in ({}, {"start": H1}, {"end": H1}, {"project": "p9"}, {"limit": 7}):
        want = plain(given, keep, **more)
        assert shown(search.logs_search(rows, replace(BASE, **(filters | more)))) == want


def test_pages_make_up_the_whole_result_and_keep_the_first_range(given, rows):
    whole, p = plain(given, lambda r: True, limit=10**6), replace(BASE, limit=37)
    cursor, seen, sizes = None, [], []
    while not sizes or cursor:
        asked = p if cursor is None else replace(p, start=H1, end=H1 + timedelta(seconds=1))  # the cursor's own range holds
        got, more, cursor = search.page(search.logs_search(rows, asked, cursor), p)
        seen += [tuple(r[k] for k in KEYS) for r in got]
        sizes.append(len(got))
        assert more == (len(seen) < len(whole)) == bool(cursor)
    assert seen == whole and set(sizes[:-1]) == {37}


def test_a_tail_takes_what_was_stored_or_happened_since(spark, given, rows):
    mark = search.tail_watermark(rows).first()[0]
    assert search.tail_watermark(rows.limit(0), mark).first()[0] == mark and search.tail_watermark(rows, mark + 9).first()[0] == mark + 9
    late = logs(spark, [{"ts": H0 + timedelta(seconds=s), "severity_number": 1, "body": f"late {s}"} for s in (5, 7000)], ingest_ts=H0 + timedelta(days=3))
    for since in (H2, H1 + timedelta(minutes=50)):
        want = {b for _, _, b, _ in plain(given, lambda r: r["ts"] >= since, limit=10**6)} | {"late 5", "late 7000"}
        got = [r["body"] for r in search.logs_tail(rows.unionByName(late), replace(BASE, limit=1000), mark, since).collect()]
        assert set(got) == want and got[-1] == "late 5"


def test_a_live_merge_takes_the_arrival_of_a_row_known_twice(rows):
    own = rows.where("project = 'p1'")
    again = own.where("service = 'forge'").withColumn("body", search.F.lit("arrived"))
    got = search.live_merge(own, again, H1)
    assert got.count() == own.where(search.F.col("ts") >= search.F.lit(H1)).count() and {r["body"] for r in got.where("service = 'forge'").collect()} == {"arrived"}
    assert search.live_reset(again, True) and search.live_reset(own, False, 3) and not search.live_reset(again, False, 10**6)


def test_services_count_the_rows_of_the_project(spark, given, rows):
    none = spans(spark, [])
    got = {r["service"]: r["logs"] for r in search.services(rows, none, none, "p1", H0, H1).collect()}
    assert got == {s: sum(r["service"] == s and r["project"] == "p1" and r["ts"] < H1 for r in given) for s in ("mill", "forge", "kiln")}


@pytest.mark.parametrize("bad", [{"limit": search.tel.MAX_LIMIT + 1}, {"limit": -3}, {"project": ""}, {"level": "shout"}, {"attrs": ("no colon",)}, {"attrs": (":v",)}])
def test_arguments_are_checked(rows, bad):
    with pytest.raises(ValueError):
        search.logs_search(rows, replace(BASE, **bad))
    with pytest.raises(ValueError):
        search.logs_search(rows, BASE, "no cursor")
