"""Each operator on small tables with nulls, empty and long texts, repeated rows, extra columns and no rows at all."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import chosen_path, components, decontaminate, html_text, mixing, parsing, quality, secrets, token_shards, toxicity, url_reputation
from lumenlake.llm.bytetok import shingles, utf8, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgmnorstu") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."


def junk(seed: int, n: int) -> str:
    return " ".join(w + "###" for w in prose(seed, n).split())


ODD = [(900, None), (901, ""), (902, "   \n\t "), (903, "é"), (904, "!!! ???"), (905, "w" * 300_000), (906, prose(906, 60_000)), (None, "no id here at all"), (907, "same row twice here now"), (907, "same row twice here now")]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, None if n % 3 else "en", ("a", "b", None)[n % 3], None if t is None else len(t)) for n, (i, t) in enumerate(rows)], DOCS)
    if extra:  # names that the operators use themselves
        for c in ("score", "predicted", "size", "key", "row", "n_words", "hits", "items", "target", "taken", "part", "slot", "shard", "group", "class_id", "_size", "_key", "_h"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_words_and_shingles_equal_the_pattern():
    texts = [t for _, t in ODD] + ["Ab, c1-é_ü", "a", "x y z"]
    data, offsets = utf8(pa.array(texts, pa.string()))
    w = words(data, offsets)
    assert [[data[s:e].tobytes().decode() for s, e, d in zip(w.start, w.end, w.doc) if d == i] for i in range(len(texts))] == [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") for t in texts]
    doc, value = shingles(w, 5)
    want = Counter(i for i, t in enumerate(texts) if (n := len(word_list(t))) for _ in range(max(1, n - 4)))
    assert Counter(doc.tolist()) == want


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, junk(i, 80) if i % 4 == 0 else prose(i, 80)) for i in range(400)] + ODD
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(900, None, None), (None, 1, 1), (901, 5, 7)], "doc_id long, quality int, toxic int")
    return documents(spark, rows, extra=True), labels


def test_quality(labelled):
    docs, labels = labelled
    out = quality.classify(docs, labels).collect()
    assert len(out) == 410
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("score <> 'mine'").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def test_decontaminate_equals_brute_force(spark):
    items = [(1, prose(1, 30)), (2, prose(2, 12)), (3, "short item here"), (4, None), (5, " ?? "), (2, prose(2, 12)), (10, prose(1, 30)[:90])]
    rows = ODD + [(i, prose(i + 50, 40) + " " + items[i % 3][1].upper() + " " + prose(i + 90, 20)) for i in range(30)] + [(40, items[0][1] * 3), (41, " ".join(items[1][1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows, extra=True)
    windows = defaultdict(set)
    for i, t in items:
        w = word_list(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    for parts in (10**6, 40):  # one part, and several
        got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.decontaminate(docs, bench, part_words=parts).collect())
        want = Counter()
        for i, t in rows:
            w, hit, found = word_list(t), set(), set()
            for n in {len(k) for k in windows}:
                for j in range(len(w) - n + 1):
                    if (k := tuple(w[j : j + n])) in windows:
                        hit.update(range(j, j + n))
                        found |= windows[k]
            want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
        assert got == want
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[5])
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = documents(spark, [(1, "so one two x three four five six y seven eight nine ten so"), (2, "ten nine eight seven six five four three two one"), (3, item), (4, item.replace("five", "z " * 40 + "five")), (5, "one " + item), (6, "one two x x x x " + item)])
    got = {r["doc_id"] for r in decontaminate.proximity(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), slop=4).collect()}
    assert got == {1, 3, 5, 6}


def test_proximity_equals_brute_force(spark):
    r = random.Random(6)
    word = lambda: r.choice("abcdefghijkl")
    items = [(i, " ".join(word() for _ in range(r.choice((3, 4, 6))))) for i in range(12)]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(80)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in rows:
        w, near = t.split(), set()
        for n, x in items:
            x = x.split()
            for j in range(max(1, len(x) - 3)):
                win = x[j : j + 4]
                for s in range(len(w)):
                    rest = iter(w[s : s + len(win) + 2])
                    near |= {n} if all(any(a == b for b in rest) for a in win) else set()
        want[i, len(near)] += 1
    for parts in (10**6, 10):
        assert Counter((r["doc_id"], r["n_near"]) for r in decontaminate.decontaminate(documents(spark, rows), bench, k=4, slop=2, part_words=parts).collect()) == want


def test_one_index_serves_several_benchmarks(spark, tmp_path):
    docs = documents(spark, [(i, prose(i, 40)) for i in range(12)])
    decontaminate.build_index(docs.select(F.struct("doc_id").alias("row"), "text")).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for n in (3, 7):
        bench = spark.createDataFrame([(1, prose(n, 40)[20:150])], "item_id long, text string")
        assert [r["row"]["doc_id"] for r in decontaminate.search_benchmark(index, bench).where("length(hits) > 0").collect()] == [n]


def test_a_long_item_is_cut_into_overlapping_parts(spark):
    item = prose(31, 90)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [(i, " ".join(item.split()[i : i + 10])) for i in range(80)])
    out = decontaminate.decontaminate(docs, bench, part_words=25).collect()
    assert all(r["n_hit"] == 10 and r["n_items"] == 1 for r in out)
    assert all(sum(len(h) for _, h in part) <= 25 for part in decontaminate.benchmark_parts(bench, part_words=25))


def test_url_parts_and_rules(spark):
    rows = [
        (1, "http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), (2, "https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
        (3, "http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"), (4, "http://x.com/fr/a://b", "x.com", "/fr/a://b", "com/fr/", "allow"), (5, "http://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        (6, None, "", "", None, "allow"), (7, "no scheme", "", "", None, "allow"), (8, "http://example.org", "example.org", "", None, "allow"), (9, "http://h?x/y", "h", "", None, "allow"), (10, "", "", "", None, "allow"),
        (10, "http://É.net:80/p#", "É.net:80", "/p", None, "allow"), (None, "://org/", "org", "/", "org/", "allow"),
    ]
    pages = spark.createDataFrame([(a, b, "x", "y") for a, b, *_ in rows], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(pages, labels).collect())
    assert got == Counter((a, *rest) for a, _, *rest in rows)
    assert url_reputation.judge_urls(pages.limit(0), labels).count() == 0


def test_bad_hosts_are_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}{i % 4}.net/x/{i}") for i in range(400)] + [(1000, "http://new.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["host"]: r["verdict"] for r in url_reputation.judge_urls(pages, labels).collect()}
    assert got == {"good0.net": "allow", "good2.net": "allow", "bad1.net": "block", "bad3.net": "block", "new.net": "allow"}


def test_fingerprints(spark):
    rows = sorted(((i, t) for i, t in ODD if i is not None), key=lambda r: r[0]) + [(1000 + i, prose(i % 7, 200)) for i in range(20)]
    docs = documents(spark, [*rows, (None, "no id")], extra=True)
    got = parsing.fingerprint_documents(docs, range_bytes=50_000).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    order = [(None, "no id"), *rows]
    assert len(got) == len(order)
    for n, (i, t) in enumerate(order):
        t, following = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        digest = hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert any(r["edited_sha256"] == digest and r["n_chars"] == len(t) for r in by[i]), i
    texts = {i: t for i, t in order}
    prints = defaultdict(set)
    for r in got:
        prints[texts[r["doc_id"]] or ""].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000]
    assert min(r["near_edited"] for r in long) > max(r["near_next"] for r in long)
    assert parsing.fingerprint_documents(docs.limit(0)).count() == 0
    assert parsing.fingerprint_documents(docs.where("doc_id = 903")).first()["near_next"] == 1.0


def test_equal_substrings_share_interior_phrases():
    body = prose(5, 400).encode()
    a, b = parsing.fingerprints([b"x" + body, prose(9, 30).encode() + body])
    assert parsing.likeness(a, b) > 0.7
    assert parsing.likeness(*parsing.fingerprints([prose(1, 300).encode(), prose(2, 300).encode()])) < 0.1


def test_html(spark):
    model = html_text.Model(*html_text.fit(*map(list, zip(*[(p := html_text.parse(s), html_text.generated_labels(p, k)) for s, k in html_text.generate_pages()], strict=True))))
    exact = [html_text.extract_texts([s], model)[0] == "\n".join(" ".join(t.split()) for t in k) for s, k in html_text.generate_pages(120, seed=5)]
    assert np.mean(exact) > 0.9
    page = '<body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><article><h1>A&amp;B</h1><p><b>One\n  two<br>three &#233;.<p>Four five six, seven.</article><script>var t="</p>";</script><footer>&copy; x</footer>'
    rows = [(1, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<article><p>unclosed text that goes on for a while, here.</p"), (5, "u", "<!-- open"), (1, None, page), (None, "u", "</p></div>")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages, model).collect()]
    assert [g[1] for g in got if g[0] == 1] == ["A&B\nOne two three é.\nFour five six, seven."] * 2
    assert all(len(t) == n for _, t, n in got) and [t for i, t, _ in got if i in (2, 3, 5, None)] == [""] * 4
    assert html_text.extract(pages.limit(0)).count() == 0


def test_sum_product_equals_enumeration():
    page = html_text.parse("<div><p>a</p><div><p>b</p></div></div>")
    r = np.random.default_rng(3)
    weight, couple = r.normal(size=html_text.BUCKETS), r.normal(size=(2, 2))
    f = html_text.forest([page])
    got, _ = html_text.sum_product(f, weight, couple)
    theta, n = np.bincount(f.owner, weight[f.flat], len(f.parent)), len(f.parent)
    total = np.zeros(n)
    mass = 0.0
    for code in range(1 << n):
        y = np.array([code >> i & 1 for i in range(n)])
        p = np.exp((theta * y).sum() + sum(couple[y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0))
        mass += p
        total += p * y
    assert np.allclose(got, total / mass)


def edit_distance(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    terms = {"idiot": False, "pathetic": False, "disgusting": False, "scum": False, "vequ": True}
    automaton, r = toxicity.Automaton(terms), random.Random(2)
    tried = ["vequ", "vequent", "scum", "scam", "idito", "idot", "", "disgustng", "disgstng", "pahtetic"]
    for _ in range(1500):
        w = list(r.choice(list(terms)))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "a", "t", "i"])
        tried.append("".join(w))
    for w in tried:
        near = [t for t, stem in terms.items() if not stem and edit_distance(t, w) <= toxicity.edits_allowed(t)]
        want = 1 if terms.get(w) is False else 2 if w.startswith("vequ") else 3 if near else 0
        assert automaton.match(w) == want, w


def test_toxicity(spark):
    bad = ["grumbold", "snarkel", "fribbish"]
    rows = [(i, prose(i, 40) + (f" you {bad[i % 3]} {bad[(i + 1) % 3]} thing" if i % 4 == 0 else "") + " " + prose(i + 5000, 10)) for i in range(800)] + ODD
    rows += [(2000, prose(1, 20) + " you grumbodl fribish " + prose(2, 10))]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)] + [(900, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows, extra=True)
    model = toxicity.train(docs, labels)
    assert set(bad) <= set(model.lexicon)
    out = toxicity.classify(docs, labels).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 800]
    assert len(out) == len(rows) and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.98
    score = {r["doc_id"]: r["score"] for r in out}
    assert score[2000] > score[901] and score[901] == score[902]
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    assert len({r["score"] for r in toxicity.classify(docs.limit(5), labels.limit(0)).collect()}) == 1


def test_quoted_hits_weigh_less():
    automaton = toxicity.Automaton({"scoundrel": False})
    x = toxicity.hit_features(pa.array(["you scoundrel there", 'he wrote "you scoundrel there" today', "", None]), automaton)
    assert x[0, 0] > 0 and x[0, 1] == 0 and x[1, 0] == 0 and x[1, 1] > 0 and x[1, 6] > 0 and not x[2:].any()


def near_copies():
    rows = []
    for g in range(6):
        base = prose(g, 120).split()
        for k in range(12):
            w = list(base)
            r = random.Random(g * 100 + k)
            for _ in range(k % 5):
                w[r.randrange(len(w))] = "zz" + str(r.randrange(99))
            rows.append((g * 100 + k, " ".join(w)))
    rows += [(800 + i, prose(700 + i, 30)) for i in range(20)] + [(830, prose(0, 120)), (831, "Two words"), (832, "two, WORDS!"), (833, "!!! ???")]
    return rows + ODD


def brute_join(rows):
    """doc -> (class, links) by comparing all."""
    sets = []
    for n, (i, t) in enumerate(rows):
        w = word_list(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else ({t} if t else {("alone", n)}))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    group = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            group[find(n)].append(i)
    return Counter((i, min(group[find(n)], default=None), links[n]) for n, (i, _) in enumerate(rows))


def test_jaccard_join_equals_brute_force(spark, monkeypatch):
    rows = near_copies()
    docs = documents(spark, rows, extra=True)
    for block in (512, 5):  # groups in one block, and dealt out over pairs of blocks
        monkeypatch.setattr(chosen_path, "BLOCK", block)
        monkeypatch.setattr(chosen_path.in_blocks, "__defaults__", (block,))
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(docs).collect())
        assert got == brute_join(rows)
    kept = chosen_path.one_of_each(docs)
    classes = {c for i, c, _ in got if c is not None}
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([*classes, None])
    assert chosen_path.jaccard_join(docs.limit(0)).count() == 0


def test_large_buckets_are_split(spark, monkeypatch):
    """Texts that share a template (half of their shingles) meet in large buckets; some have near copies."""
    template, rows = prose(77, 80), []
    for i in range(160):
        own = prose(5000 + i, 70).split()
        rows.append((i, template + " " + " ".join(own)))
        if i % 8 == 0:
            own[i % 70] = "changed"
            rows.append((1000 + i, template + " " + " ".join(own)))
    docs = documents(spark, rows)
    one = chosen_path.sketches(docs, chosen_path.runs_needed())
    leaves = one.select("key", F.explode(F.array_distinct("leaves")).alias("group"))
    pairs = lambda limit: chosen_path.buckets(leaves, one.select("key", "sketch"), limit).groupBy("group").agg(F.count("*").alias("c"), F.first("n").alias("n")).selectExpr("sum(c * c)", "min(c = n)").first()
    whole, split = pairs(10**6), pairs(12)
    assert whole[1] and split[1] and split[0] < 0.6 * whole[0]
    monkeypatch.setattr(chosen_path, "SPLIT", 12)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(docs).collect()) == brute_join(rows)


def test_pairs_of_blocks_go_to_the_tasks_in_turn(spark):
    rows = spark.range(2000).selectExpr("1L AS `group`", "id AS key", "2000L AS n", "1L AS copies", "CAST('x' AS BINARY) AS payload")
    dealt = chosen_path.in_blocks(rows, 500).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.countDistinct("g").alias("pairs")).collect()
    assert sorted(r["pairs"] for r in dealt) == [2, 2, 3, 3]  # ten pairs of four blocks over four tasks


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = dict((x["node"], x["component"]) for x in components.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    parent = {x: x for p in pairs for x in p}
    for _ in range(len(parent)):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if x != p}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_secrets_base_spans_and_decoding(spark):
    hexa = "0123456789abcdef" * 2
    rows = ODD[:8] + [(i, f"{prose(i, 20)} {['password=' + hexa[:18], 'token: ' + chr(34) + hexa + chr(34), 'AKIA' + 'Q7' * 8, hexa][i % 4]} {prose(i + 40, 15)}") for i in range(60)]
    rows += [(70, "ſecret=abcdefghijklmnop é SECRET = 'ABCDEFGHIJKL' api-key=x apikey:Zz0123456789_"), (71, "secret=token:ABCDEFGHIJKLMNOP"), (71, "secret=token:ABCDEFGHIJKLMNOP")]
    docs = documents(spark, rows, extra=True)
    got = secrets.find_secrets(docs).collect()
    texts = dict(rows)
    for r in got:
        t = texts[r["doc_id"]] or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", low) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[3] == k for b in base) for k in ("assign", "access", "hex"))
    assert len(got) == len(rows) and secrets.find_secrets(docs.limit(0)).count() == 0
    model = secrets.train(docs)
    r = np.random.default_rng(1)
    for _ in range(20):  # pruned decoding against plain Viterbi over the whole text
        toks = r.choice(["plain", "words", "password=9f86d081884c7d65", "AKIAQ7Q7Q7Q7Q7Q7Q7", "x1", "token", "="], 30)
        data, offsets = utf8(pa.array([" ".join(toks)]))
        t = secrets.token_features(data, offsets, model.cues)
        tags = secrets.viterbi(t.x @ model.emission, model.transition, False, False)
        inside = {i for a, b in secrets.crf_spans(model, t) for i in range(a, b + 1)}
        # an inside tag without a begin before it opens no span
        want, on = set(), False
        for i, tag in enumerate(tags):
            on = tag != 0 and (on or tag in (1, 2))
            want |= {i} if on else set()
        assert inside == want


def test_mix_equals_brute_force(spark):
    rows = ODD + [(i, prose(i, i % 37)) for i in range(120)]
    docs = documents(spark, rows, extra=True)
    got = mixing.mix(docs, bucket_rows=7).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {n: ("a", "b", None)[n % 3] for n in range(len(rows))}
    totals = Counter()
    for n, (_, t) in enumerate(rows):
        totals[source[n]] += size(t)
    names = sorted((s for s in totals if s is not None)) + [None]
    weight, caps = {s: k % 3 + 1 for k, s in enumerate(names)}, {s: 3 * totals[s] for s in totals}
    target, open_, left = {}, set(names), sum(totals.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > caps[s]}
        if not full:
            target |= share
            break
        target |= {s: caps[s] for s in full}
        left -= sum(caps[s] for s in full)
        open_ -= full
    by = defaultdict(list)
    for r in got:
        by[r["source_size"]].append(r)
        assert r["taken"] <= 3 * r["size"]
    for s in names:
        own = by[totals[s]]
        assert own[0]["target"] == pytest.approx(target[s]) and sum(r["taken"] for r in own) == round(target[s])
        ratio = [r["taken"] // r["size"] for r in own if r["size"]]
        assert max(ratio) - min(ratio) <= 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3), bucket_rows=1000).collect()), key=str)
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["taken"]
    mixed = mixing.mixed_documents(docs, bucket_rows=7)
    assert mixed.columns == docs.columns
    out = Counter()
    for r in mixed.collect():
        out[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"]) and r["size"] == "mine" and r["_size"] == "mine"
    assert {k: v for k, v in out.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("text IS NULL")).first()["taken"] == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(token_shards.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.feistel(np.arange(1000), 1000, 1).tolist() != token_shards.feistel(np.arange(1000), 1000, 2).tolist()


def brute_slots(spark, rows, n_seq, bucket_rows, key=token_shards.KEY):
    """(slot, doc_id, text, seq) of every sequence, numbered by plain sorting; Spark's hash is taken as given."""
    size = max(bucket_rows, int(len(rows) ** 0.5))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    hashed = [(r["doc_id"], r["text"], r["h"], r["name"]) for r in df.withColumn("name", F.xxhash64("doc_id", "h", F.lit(key))).collect()]
    copies, buckets = Counter((i, h) for i, _, h, _ in hashed), len(rows) // size + 1

    def place(i, h, name):
        return name % buckets if copies[i, h] <= size else buckets + name % (1 << 37) * (1 << 25)

    order = sorted(hashed, key=lambda r: (place(r[0], r[2], r[3]), r[0] is not None, r[0] or 0, r[2]))
    flat = [(i, t, s) for i, t, _, _ in order for s in range(n_seq[t])]
    slots = token_shards.feistel(np.arange(len(flat)), len(flat)).tolist()
    return Counter((slot, *x) for slot, x in zip(slots, flat, strict=True))


def test_token_records_round_trip(spark, tmp_path):
    rows = ODD + [(i, prose(i, 50 + i * 7)) for i in range(40)] + [(None, "one of many copies")] * 70 + [(50, "x" + " " * 3_000_000 + "y" + "\n" * 20_000), (51, "é" * 40_000)]
    docs = documents(spark, rows, extra=True)
    records = token_shards.sequences(docs, length=64, shard=16, bucket_rows=5)
    got = records.collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and all(r["shard"] == r["slot"] // 16 and r["record"] == r["slot"] % 16 and len(r["tokens"]) == 128 for r in got)
    own, parts = token_shards.encoder(token_shards.load_ranks()), defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append((r["seq"], np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"]].tolist()))
    n_seq = {}
    for i, t in rows:
        ids = token_shards.encode(t or "", token_shards.load_ranks())
        assert own.decode(ids) == (t or "")
        n_seq[t] = len(ids) // 64 + 1
        if i not in (907, None):
            assert [x for _, p in sorted(parts[i]) for x in p] == [*ids, token_shards.END_OF_TEXT]
    assert len(parts[907]) == 2 and len(parts[None]) == 71
    text = {i: t for i, t in rows if i is not None}
    decoded = lambda r: text[r["doc_id"]] if r["doc_id"] is not None else own.decode(np.frombuffer(r["tokens"], "<u2")[: r["n_tokens"] - 1].tolist())
    assert Counter((r["slot"], r["doc_id"], decoded(r), r["seq"]) for r in got) == brute_slots(spark, rows, n_seq, 5)
    again = token_shards.sequences(docs.repartition(3), length=64, shard=16, bucket_rows=5).collect()
    assert {(r["slot"], bytes(r["tokens"])) for r in got} == {(r["slot"], bytes(r["tokens"])) for r in again}
    folder = str(tmp_path / "out")
    manifest = token_shards.write_shards(docs, folder, length=64, shard=16, bucket_rows=5)
    listed = manifest.collect()
    assert sum(m["n_records"] for m in listed) == len(got) and all(hashlib.sha256(open(m["path"], "rb").read()).hexdigest() == m["sha256"] for m in listed)
    at = {r["slot"]: bytes(r["tokens"]) for r in got}
    read = token_shards.read_records(folder, 13, 9, length=64, shard=16)
    assert [x.tobytes() for x in read] == [at[s] for s in range(13, 22)]
    assert Counter(map(str, token_shards.read_shards(spark.createDataFrame(listed), folder, length=64, shard=16).collect())) == Counter(map(str, got))
    assert token_shards.sequences(docs.limit(0)).count() == 0 and token_shards.write_shards(docs.limit(0), folder + "-none").count() == 0


def test_records_lie_in_ranges_of_shards(spark):
    docs = documents(spark, [(i, prose(i, 80)) for i in range(60)])
    rows = token_shards.sequences(docs, length=16, shard=8).withColumn("p", F.spark_partition_id()).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["p"]].append(r["slot"])
    bounds = sorted((min(s), max(s)) for s in held.values())
    assert len(held) > 1 and all(s == sorted(s) for s in held.values()) and all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def test_runs_of_white_space_are_encoded_exactly():
    ranks, r = token_shards.load_ranks(), random.Random(8)
    own = token_shards.encoder(ranks)
    for _ in range(300):
        text = "".join(r.choice(["a", "b1", "!", "é", "'s", " ", "\n", "\t", "\u3000", "\x1c"]) * r.choice((1, 1, 2, 5, 9)) for _ in range(r.randint(1, 12)))
        assert token_shards.encode(text, ranks, long_space=3) == own.encode_ordinary(text), repr(text)


def test_toxicity_of_misspelled_stems_and_long_texts(spark):
    r = random.Random(4)
    family = [stem + a + b for stem in ("grumbo", "snarke") for a in "aeiou" for b in ("ld", "nt", "rk", "sh", "ft", "mp", "sk", "lt")]
    rows = [(i, prose(i, 40) + (f" you {r.choice(family)} {r.choice(family)} thing" if i % 4 == 0 else "") + " " + prose(i + 5000, 10)) for i in range(800)]
    # every term misspelled in the letters of its stem
    bad = [w[0] + w[2] + w[1] + w[3:] for w in family]
    long = [w for k in range(60) for w in (*prose(9000 + k, 30).split(), bad[k])]
    rows += [(2000, prose(1, 20) + f" you {bad[3]} {bad[50]} {bad[17]} {bad[61]} " + prose(2, 10)), (2001, " ".join(long)), (2002, prose(9500, 1860))]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(800)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels)
    stems = [t for t, stem in model.lexicon.items() if stem]
    assert {t[:4] for t in stems} >= {"grum", "snar"} and any(not stem and t in family for t, stem in model.lexicon.items())
    automaton = toxicity.Automaton(model.lexicon)
    assert all(automaton.match(w) in (3, 4) for w in bad) and all(automaton.match(w) in (1, 2) for w in family)
    out = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(docs, model).withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int")).collect()}
    assert (out[2000], out[2001], out[2002]) == (1, 1, 0)
    assert np.mean([out[i] == (i % 4 == 0) for i in range(800)]) > 0.98


def test_misspelled_terms_decide_at_a_toxic_share_of_three_percent(spark):
    """Every hit of the held-out toxic texts is misspelled, and clean texts hold words one edit from a term."""
    r = random.Random(9)
    terms = ["scoundrel", "imbecile", "worthless", "grumbolt", "snarkel", "vermish"]
    near = ["scoundrels", "imbeciles", "snarkels", "worthlesse"]  # words of the language, and no terms

    def bad(w):
        i = r.randrange(1, len(w) - 1)
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if w[i] != w[i + 1] else w[:i] + w[i + 1 :]

    def text(i, toxic, twist=lambda w: w):
        own = prose(i, 60).split()
        for w in r.sample(terms, 3) if toxic else [r.choice(near)] if i % 4 == 0 else []:
            own.insert(r.randrange(len(own)), twist(w))
        return " ".join(own)

    rows = [(i, text(i, i % 33 == 0)) for i in range(3000)]
    fresh = [(10_000 + i, text(10_000 + i, True, bad)) for i in range(60)] + [(20_000 + i, text(20_000 + 4 * i, False)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 33 == 0)) for i in range(3000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, rows), labels)
    assert {"scoundrels", "imbeciles"} <= model.innocent
    out = {x["doc_id"]: x["score"] >= toxicity.CUT for x in toxicity.score_toxicity(documents(spark, fresh), model).collect()}
    assert np.mean([out[i] for i, _ in fresh[:60]]) >= 0.8 and np.mean([out[i] for i, _ in fresh[60:]]) <= 0.02


def test_a_labelled_id_with_very_many_rows_sends_a_bounded_sample(spark):
    many = [(4, prose(i, 8) + " scoundrel") for i in range(700)] + [(i, prose(i, 30)) for i in range(1000, 1100)]
    labels = spark.createDataFrame([(4, 1, 1), *((i, 1, 0) for i in range(1000, 1100))], "doc_id long, quality int, toxic int")
    model = toxicity.train(documents(spark, many), labels, n_toxic=50, n_clean=60)
    assert isinstance(model.bias, float) and len(model.weight) == toxicity.KINDS


def test_stems_have_an_edit_budget():
    automaton = toxicity.Automaton({"grumbo": True, "vequ": True, "grumbolt": False})
    assert [automaton.match(w) for w in ("grumbold", "grumbolt", "gurmbolt", "grmbosh", "grumbbosh", "vqeuent", "grum")] == [2, 1, 3, 4, 4, 0, 0]


def test_every_significant_term_is_in_the_lexicon(spark):
    r = random.Random(5)
    terms = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(600)]
    rows = [(" ".join([*r.sample(terms, 60), *prose(i, 20).split()]), 1) for i in range(400)] + [(prose(i, 80), 0) for i in range(1000, 1400)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert sum(t in lexicon for t in terms) > 560


def test_near_copies_with_shared_or_missing_ids(spark):
    texts = {name: prose(seed, 80) for name, seed in (("a", 7001), ("b", 7002), ("c", 7003), ("d", 7004), ("e", 7005), ("f", 7006))}
    near = {name: t.rsplit(" ", 1)[0] + " zzz" for name, t in texts.items()}
    rows = [(1, texts["a"]), (5, near["a"]), (5, texts["b"]), (6, texts["c"]), (6, texts["d"]), (None, texts["e"]), (None, texts["e"]), (None, near["e"]), (None, near["c"]), (8, texts["f"]), (8, texts["f"]), (8, near["f"]), (9, None), (9, None), (None, "")]
    docs = documents(spark, rows)
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.jaccard_join(docs).collect())
    assert got == brute_join(rows)
    kept = Counter((r["doc_id"], r["text"]) for r in chosen_path.one_of_each(docs).collect())
    of_e, of_f = ([k for k in kept if k[1] in (texts[x], near[x])] for x in "ef")
    assert len(of_e) == len(of_f) == 1 and of_e[0][0] is None and of_f[0][0] == 8
    assert kept == Counter([(1, texts["a"]), (5, texts["b"]), (6, texts["c"]), (6, texts["d"]), *of_e, *of_f, (9, None), (9, None), (None, "")])
