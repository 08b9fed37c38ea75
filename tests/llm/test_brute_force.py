"""Plain versions of vectorised steps, and groups that hold most of the rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import common, mixing, parsing, quality, toxicity, url_reputation
from lumenlake.llm.bytetok import CODE
from tests.llm.test_operators import ODD, documents, junk, prose

M = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_level(names):
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else mix((x + n * 0xD1B54A32D192ED03) & M) for x, n in runs]
    label = [x & 0xFFFFFFFF for x in names]
    for _ in range(parsing.ROUNDS):
        out = []
        for i, x in enumerate(label):
            differ = x ^ (label[i - 1] if i else ~x & 0xFFFFFFFF)
            bit = (differ & -differ).bit_length() - 1 if differ else 0
            out.append(2 * bit + (x >> bit & 1))
        label = out
    blocks = []
    for i, x in enumerate(names):
        if i == 0 or (0 < i < len(names) - 1 and label[i] >= label[i - 1] and label[i] > label[i + 1]):
            blocks.append([])
        blocks[-1].append(x)
    return [mix(sum(mix((x + j * 0x8CB92BA72F3D8DD7) & M) for j, x in enumerate(b)) & M) for b in blocks]


def plain_names(text):
    """All phrase names of the levels that count."""
    names, kept = [int(CODE[b]) for b in text], set()
    for level in range(1, parsing.LEVELS + 1):
        names = plain_level(names)
        if level >= parsing.FIRST_LEVEL:
            kept |= {(x + level * 0x9E3779B97F4A7C15) & M for x in names}
    return sorted(kept)


def test_fingerprints_equal_a_plain_parse():
    r = random.Random(3)
    texts = ["", "a", "aaaaaa", "ab" * 50, prose(1, 60), prose(2, 400), "é" * 30 + prose(3, 20)] + ["".join(r.choice("ab ") for _ in range(r.randint(1, 300))) for _ in range(40)]
    for text, sketch in zip(texts, parsing.fingerprints([t.encode() for t in texts]), strict=True):
        assert sketch.tolist() == plain_names(text.encode())[: parsing.SKETCH], text


def test_likeness_estimates_the_similarity_of_all_names():
    for k in (0, 1, 3, 10, 40):
        base = prose(50, 400).split()
        other = [("other" + str(i) if i % 41 < k else w) for i, w in enumerate(base)]
        a, b = " ".join(base).encode(), " ".join(other).encode()
        x, y = set(plain_names(a)), set(plain_names(b))
        assert parsing.likeness(*parsing.fingerprints([a, b])) == pytest.approx(len(x & y) / len(x | y), abs=0.2)


def test_near_edited_and_near_next_come_from_the_fingerprints(spark):
    rows = [(i, prose(i % 5, 90 + i)) for i in range(12)]
    got = {r["doc_id"]: r for r in parsing.fingerprint_documents(documents(spark, rows), range_bytes=800).collect()}
    for n, (i, t) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        sketch = [parsing.fingerprints([x.encode()])[0] for x in (t, t[: len(t) - half] + following[:half], following)]
        assert got[i]["fingerprint"] == parsing.to_text(sketch[0]) and got[i]["edited_fingerprint"] == parsing.to_text(sketch[1])
        assert got[i]["near_edited"] == pytest.approx(parsing.likeness(sketch[0], sketch[1])) and got[i]["near_next"] == pytest.approx(parsing.likeness(sketch[0], sketch[2]))


def test_ids_that_hold_many_rows_are_cut_into_parts_in_order(spark):
    hot = [(None, prose(i, 60)) for i in range(40)] + [(7, prose(100 + i, 60)) for i in range(40)] + [(7, prose(100, 60))] * 3 + [(2**53 + i, prose(200 + i, 60)) for i in range(10)]
    docs = documents(spark, hot + [(i, prose(300 + i, 60)) for i in range(20) if i != 7])
    dealt = parsing.with_next(docs, range_bytes=2_000)
    sizes = {r["part"]: r["count"] for r in dealt.where("extra = 0").groupBy("part").count().collect()}
    assert sum(sizes.values()) == docs.count() and max(sizes.values()) < 20
    rows = [tuple(r) for r in docs.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).select("doc_id", "text").collect()]
    assert [tuple(r) for r in dealt.where("extra = 0").orderBy("part", F.asc_nulls_first("doc_id"), F.xxhash64("text")).select("doc_id", "text").collect()] == rows
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in parsing.fingerprint_documents(docs, range_bytes=2_000).collect())
    want = Counter((i, hashlib.sha256((t[: len(t) - len(t) // 2] + rows[(n + 1) % len(rows)][1][: len(t) // 2]).encode()).hexdigest()) for n, (i, t) in enumerate(rows))
    assert got == want


def test_quality_features_equal_plain_counts_and_do_not_depend_on_the_batch():
    texts = [t for _, t in ODD if len(t or "") < 1000] + [prose(1, 50), junk(2, 40), "UPPER lower 123 !!! a,b.c\nnew line\nnew line"]
    x = quality.features(pa.array(texts, pa.string()))
    for row, t in zip(x, texts, strict=True):
        assert np.allclose(row, quality.features(pa.array([t], pa.string()))[0])
        raw = (t or "").encode()
        words = "".join(chr(c) if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 else " " for c in raw).split()
        lines = [x for x in (t or "").replace("\r", "\n").split("\n") if x]
        assert row[1] == pytest.approx(sum(48 <= c < 58 for c in raw) / max(len(raw), 1)) and row[4] == pytest.approx(raw.count(b",") / max(len(words), 1))
        assert row[13] == pytest.approx(np.log1p(len(words))) and row[14] == pytest.approx(1 - len({w.lower() for w in words}) / max(len(words), 1) if words else 1 - 0)
        assert row[17] == pytest.approx(np.log1p(len(lines))) and row[21] == (not words)


def test_the_threshold_is_the_score_quantile_of_the_bad_share():
    r = np.random.default_rng(4)
    good = np.arange(400) % 4 != 0
    x = r.normal(size=(400, quality.FEATURES)) + good[:, None] * 0.15
    model = quality.fit(x, good, 0.25, ridge=1e-3)
    assert abs((quality.score(model, x) < quality.CUT).mean() - 0.25) < 0.01
    # the weights solve the pairwise logistic problem: the gradient over its pairs vanishes
    random_, up, down = np.random.default_rng(7), np.flatnonzero(good), np.flatnonzero(~good)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    d = z[random_.choice(up, quality.PAIRS)] - z[random_.choice(down, quality.PAIRS)]
    assert np.abs(d.T @ (1 / (1 + np.exp(d @ model.weight))) / len(d) - 1e-3 * model.weight).max() < 1e-5


def test_enclosed_hits():
    cases = {
        ("", " there"): False, ('he wrote "you ', ' there" today'): True, ('"hello" you ', ' go "away"'): False, ("she said 'you ", "' to him"): True, ("don't you ", " it's late"): False,
        ("„du ", "“ sagte er"): True, ("« toi ", " » dit"): True, ("» toi ", " « dit"): False, ("« non » toi ", " « si »"): False, ("«toi ", "» dit"): True, ('"', '" was said'): True, ('he said "', " and left"): False, ("“you ", "” wrote she"): True, ("the dogs' ", " bone"): False,
    }
    assert {k: toxicity.enclosed(*k) for k in cases} == cases


def test_a_repeated_label_id_sends_a_bounded_sample(spark):
    rows = spark.range(3000).selectExpr("CAST(id % 2 AS INT) AS y", "array(1.0D) AS x", "xxhash64(id % 50) AS h")
    got = common.bounded(rows, {1: 10, 0: 40}).collect()
    assert Counter(r["y"] for r in got) == {1: 10, 0: 25}


def test_scratch_tables_need_a_shared_folder_on_a_cluster():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session)


def test_mix_with_one_document_repeated_very_often(spark):
    rows = [(7, "one two three")] * 900 + [(None, "four five")] * 700 + [(i, prose(i, i % 23)) for i in range(500)]
    df = spark.createDataFrame([(i, t, "ab"[i % 2] if i else "a") for i, t in rows], "doc_id long, text string, source string")
    got = mixing.mix(df, bucket_rows=40).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), bucket_rows=40).collect()), key=str)
    for size in {r["source_size"] for r in got}:
        own = [r for r in got if r["source_size"] == size]
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
        whole = [r["taken"] // r["size"] for r in own if r["size"]]
        assert max(whole) - min(whole) <= 1 and sum(0 < r["taken"] % r["size"] for r in own if r["size"]) <= 1
    mixed = mixing.mixed_documents(df, bucket_rows=40)
    assert mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r["taken"] for r in got)


def test_suffixes_of_two_labels_and_clashing_columns(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.co.uk/p/{i}", "x", "x", "x") for i in range(400)]
    rows += [(1000, "http://new.bad.co.uk/", "x", "x", "x"), (1001, "http://new.good.co.uk/", "x", "x", "x"), (1002, "http://long.net/" + "a" * 200_000, "x", "x", "x")] + [(2000 + i, "http://plain.net/", "x", "x", "x") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, path string, verdict string, n_labelled string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_reputation.judge_urls(pages, labels).collect()}
    assert len(got) == len(rows) and (got[1000]["verdict"], got[1001]["verdict"]) == ("block", "allow") and len(got[1002]["path"]) == 200_001
    assert got[1]["n_labelled"] == 200 and got[2000]["n_labelled"] == 0
    assert {r["verdict"] for r in url_reputation.judge_urls(pages, labels.limit(0)).collect()} == {"allow"}
