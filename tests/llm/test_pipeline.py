"""The pipeline against a plain brute-force version of its stages (the classifier's and the mix's decisions are taken as given)."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lumenlake.llm import mixing, quality, token_shards
from tests.llm.test_operators import brute_join, documents, junk, prose, word_list


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    item = prose(9000, 25)
    rows = [(i, junk(i, 60) if i % 5 == 0 else prose(i, 60)) for i in range(150)]
    for i in range(150, 180):  # near copies
        w = rows[i - 149][1].split()
        w[random.Random(i).randrange(len(w))] = "zzz"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(300 + i, 20) + " " + item + " " + prose(400 + i, 20)) for i in range(6)] + [(210, None), (211, ""), (212, "word")]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages(spark, tables):
    folder, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, [(r["doc_id"], r["text"]) for r in docs.collect()]
    frames = [docs]
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f"{folder}/out-{n}"
        f(spark, frames[-1], folder).write.parquet(out)
        frames.append(spark.read.parquet(out))
    assert all(f.columns == columns for f in frames[:-1])
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames[:-1]]
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids[1] == sorted(r["doc_id"] for r in quality.score_quality(docs, model).where("predicted = 1").select("row.doc_id").collect())
    assert not {i for i in ids[1] if i < 150 and i % 5 == 0} and {i for i in range(150) if i % 5} <= set(ids[1])
    text = dict(rows)
    classes = {c for i, c, _ in brute_join([(i, text[i]) for i in ids[1]])}
    assert ids[2] == sorted(classes)
    windows = {tuple(word_list(item)[j : j + 10]) for j in range(len(word_list(item)) - 9)}
    clean = [i for i in ids[2] if not any(tuple((w := word_list(text[i]))[j : j + 10]) in windows for j in range(len(word_list(text[i])) - 9))]
    assert ids[3] == clean and not {i for i in clean if 200 <= i < 206}
    taken = defaultdict(int)
    for r in mixing.mix(frames[3]).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in frames[4].collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    own, tokens = token_shards.encoder(token_shards.load_ranks()), 0
    for r in frames[4].collect():
        tokens += len(own.encode_ordinary(r["text"] or "")) + 1
    records = frames[5].collect()
    assert sorted(r["slot"] for r in records) == list(range(len(records))) and sum(r["n_tokens"] for r in records) == tokens
    assert all(len(np.frombuffer(r["tokens"], "<u2")) == token_shards.LENGTH for r in records)
    ran = corpus_pipeline.run(spark, folder).collect()
    assert {(r["slot"], bytes(r["tokens"])) for r in ran} == {(r["slot"], bytes(r["tokens"])) for r in records}


def test_an_empty_corpus(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for n, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, folder).write.parquet(f"{folder}/empty-{n}")
        docs = spark.read.parquet(f"{folder}/empty-{n}")
        assert docs.count() == 0
