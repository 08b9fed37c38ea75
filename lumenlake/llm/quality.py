"""Quality classifier: Bradley-Terry pairwise ranking over surface features of the whole text.

Training draws preference pairs (a document labelled 1 is preferred to one labelled 0) from a
bounded sample of labelled rows, and fits the score w.x by logistic loss on feature differences.
The decision threshold is the score quantile at the share of label 0 among all training labels;
scores are mapped to 0..1 so that the threshold sits at 0.3.

Defined cases: null and empty texts have all-zero counts and are scored like any other; a null
doc_id is never held out and never a training row; repeated rows are scored each; labels that are
null or not 0/1 are ignored; with no training pairs every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import U64, mix64, utf8, words
from lumenlake.llm.common import blocks, bounded, held_out

#: Labelled rows of each class that training reads at most (a bounded sample, in hash order).
TRAIN_ROWS_PER_CLASS = 3_000
PAIRS = 60_000
CUT = 0.3
HOLD_OUT = (5, 0)

_CLASS = np.zeros(256, np.uint8)
for _n, _members in enumerate(
    (bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r\x0b\x0c", b",", b".", b"!?", b"'\"()-:;", b"#$%&*@^~", b"|<>{}[]\\/=+_`", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0))), 1
):
    _CLASS[list(_members)] = _n
(LOWER, UPPER, DIGIT, BLANK, BREAK, COMMA, STOP, SHOUT, QUOTE, JUNK, MARKUP, LEAD, TAIL) = range(1, 14)
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False
FEATURES = 26


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float


def _distinct(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of each row."""
    if not len(doc):
        return np.zeros(rows)
    _, first = np.unique(mix64(value ^ mix64(doc.astype(U64) + U64(1))), return_index=True)
    return np.bincount(doc[first], minlength=rows)


def features(column: pa.Array) -> np.ndarray:
    """One row of surface features for each text."""
    data, offsets = utf8(column)
    rows, size = len(column), np.diff(offsets)
    doc = np.repeat(np.arange(rows), size)
    counts = np.bincount(doc * 16 + _CLASS[data], minlength=rows * 16)[: rows * 16].reshape(rows, 16).astype(float)
    w = words(data, offsets)
    n, length = w.count.astype(float), w.end - w.start
    some = np.maximum(n, 1)
    total = np.bincount(w.doc, length, rows)
    spread = np.sqrt(np.maximum(np.bincount(w.doc, length.astype(float) ** 2, rows) / some - (total / some) ** 2, 0))
    same_doc = w.doc[1:] == w.doc[:-1]
    echo = np.bincount(w.doc[1:][same_doc & (w.hash[1:] == w.hash[:-1])], minlength=rows)
    with np.errstate(over="ignore"):
        pair = (w.hash[:-1] * U64(0x9E3779B97F4A7C15) + w.hash[1:])[same_doc]
    pairs = np.bincount(w.doc[1:][same_doc], minlength=rows)
    lines = words(data, offsets, _LINE)
    decorated = np.zeros(rows)
    if len(data):
        after = _CLASS[data[np.minimum(w.end, len(data) - 1)]]
        decorated = np.bincount(w.doc[(w.end < offsets[w.doc + 1]) & ((after == JUNK) | (after == SHOUT))], minlength=rows)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, LEAD], 1)
    chars = np.maximum(size, 1)
    x = [
        counts[:, UPPER] / letters, counts[:, DIGIT] / chars, counts[:, BLANK] / chars, counts[:, BREAK] / some, counts[:, COMMA] / some,
        counts[:, STOP] / some, counts[:, SHOUT] / some, counts[:, QUOTE] / some, counts[:, JUNK] / some, counts[:, MARKUP] / some,
        counts[:, LEAD] / letters, total / some, spread, np.log1p(n), 1 - _distinct(w.doc, w.hash, rows) / some, echo / some,
        1 - _distinct(w.doc[1:][same_doc], pair, rows) / np.maximum(pairs, 1), np.log1p(lines.count),
        1 - _distinct(lines.doc, lines.hash, rows) / np.maximum(lines.count, 1), decorated / some,
        n / np.maximum(lines.count, 1) / 50, n == 0,
    ]
    x += [np.minimum(1, 20 * x[i]) for i in (0, 8, 9, 15)]  # junk styles that saturate
    return np.nan_to_num(np.column_stack(x).astype(float))


def fit(x: np.ndarray, good: np.ndarray, bad_share: float, pairs: int = PAIRS, ridge: float = 1e-3) -> Model:
    """Weights from preference pairs; threshold at the weighted score quantile bad_share."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Model(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    z, random = np.clip((x - mean) / scale, -8, 8), np.random.default_rng(7)
    d = z[random.choice(up, pairs)] - z[random.choice(down, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps of the pairwise logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    weight = np.where(good, (1 - bad_share) / len(up), bad_share / len(down))
    order = np.argsort(s, kind="stable")
    below = np.cumsum(weight[order])
    at = min(int(np.searchsorted(below, bad_share * (1 - 1e-9))), len(s) - 1)
    threshold = float(s[order][at : at + 2].mean())  # between the last score within the quantile and the next
    return Model(mean, scale, w, threshold, 1.0)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    s = np.clip((x - model.mean) / model.scale, -8, 8) @ model.weight
    if not model.weight.any():
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(model.slope * (s - model.threshold) + np.log(CUT / (1 - CUT)), -40, 40)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS_PER_CLASS) -> Model:
    """Fit on at most per_class labelled rows of each class, taken in hash order."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("_y")).where(
        F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("doc_id"), *HOLD_OUT)
    )
    share = known.agg(F.avg(1 - F.col("_y"))).first()[0]
    order = F.xxhash64("doc_id", F.lit("quality"))
    picked = known.where("_y = 0").orderBy(order).limit(per_class).unionByName(known.where("_y = 1").orderBy(order).limit(per_class))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "_y", F.xxhash64("text").alias("_h"))  # at most 2 x per_class label rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(features(part.column(0))), pa.list_(pa.float64())), part.column(2)], ["y", "x", "h"])

    got = bounded(sample.mapInArrow(extract, "y int, x array<double>, h long"), {0: per_class, 1: per_class}).toPandas().sort_values("y", kind="stable")
    if got.empty:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    x = np.stack(got["x"].to_numpy())
    at = np.lexsort((*x.T, got["y"].to_numpy()))  # an order that does not depend on the partitions
    return fit(x[at], got["y"].to_numpy()[at] == 1, float(share))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of docs' columns), score (0 to 1) and predicted (1 where score >= 0.3) of every document."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                s = score(model, features(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["row", "score", "predicted"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_quality(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("row.doc_id", held_out(F.col("row.doc_id"), *HOLD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts good, with all their columns."""
    return score_quality(docs, train(docs, labels)).where("predicted = 1").select("row.*")
