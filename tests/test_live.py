"""The live list as a stream: arrivals, the reset beyond its bound, restarts and replays."""

from datetime import timedelta

from lumenlake.operators.search import Search
from lumenlake.sources import lake
from lumenlake.streaming import live
from tests.data import H0, logs

DAY = timedelta(days=1)


def test_a_list_starts_over_beyond_its_bound_and_goes_on_after_a_restart(spark, tmp_path):
    root, folder, p = str(tmp_path / "lake"), str(tmp_path / "list"), Search("p1", H0, H0 + DAY, level="info", limit=3)
    seconds = iter(range(1000))
    stamp = iter(range(1000))

    def come(*bodies, at=None):
        rows = [{"ts": H0 + timedelta(seconds=next(seconds) if at is None else at), "ingest_ts": H0 + DAY + timedelta(microseconds=next(stamp)), "body": b, "severity_number": 1 if b == "quiet" else 9} for b in bodies]
        lake.write_hours(logs(spark, rows), root, "logs")

    def poll():
        live.live_list(spark, root, p, folder, available_now=True, most=5).awaitTermination()  # each poll is a restart
        return [r["body"] for r in live.live_rows(spark, p, folder).collect()]

    come("a", "b", "c", "d", "quiet")
    assert poll() == ["d", "c", "b"]
    come("e", "f")
    come("g")
    assert poll() == ["g", "f", "e", "d", "c", "b"]
    come("late", at=0)
    assert poll() == ["g", "f", "e", "d", "c", "b", "late"]
    assert poll() == ["g", "f", "e", "d", "c", "b", "late"]  # nothing came
    come("h", "i")  # the fourth, fifth and sixth arrival: one too many
    assert poll() == ["i", "h", "g"]
    come(*"jklmnopq")  # more than one poll shows
    assert poll() == ["q", "p", "o"]
    come("r")
    assert poll() == ["r", "q", "p", "o"]
    live._arrive(lake.scan_signal(spark, root, "logs", H0, H0 + DAY).where("body = 'r'"), 6, root, p, folder, 5)  # a batch that runs again
    assert [r["body"] for r in live.live_rows(spark, p, folder).collect()] == ["r", "q", "p", "o"]
