"""Document fingerprints by locally consistent parsing.

The text's UTF-8 bytes are the phrases of level 0. At each level, runs of equal phrases become one
phrase first; deterministic coin tossing then reduces each phrase, against its left neighbour, to a
small label in a few rounds, and the local maxima of the labels cut the sequence into blocks of a
few phrases. A block's name is a hash of its phrases' names, so a level's phrases depend only on a
short stretch of text around them: equal substrings share all phrases but those near their ends,
wherever they stand. The fingerprint is a bottom-k sketch (the k least hashes) of the distinct names
of the levels whose phrases are long enough to tell texts apart, and likeness estimates the
Jaccard similarity of the two name sets.

Neighbours: documents are sorted by (doc_id, hash of text) in ranges of the id; the first row of
each range travels to the range before as well (one row per range), so the next document is always
at hand and texts are shuffled once. An id, or none, that holds many rows is cut further by the hash
of its texts.

Defined cases: null counts as empty; an empty text has an empty fingerprint, which is like another
empty one (1.0) and unlike all others (0.0); a null doc_id sorts first; repeated ids are ordered by
their texts' hashes; the last document's next is the first, a single document is its own next;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import CODE, U64, mix64
from lumenlake.llm.common import BLOCK_BYTES

LEVELS = 6
#: The first level whose names count (phrases of some 25 bytes; a shorter text is one phrase).
FIRST_LEVEL = 3
SKETCH = 64
ROUNDS = 2
MAX_RANGES = 20_000
RANGE_BYTES = 4_000_000
#: Below all ids, and still above twice itself, where rows without an id stand.
NO_ID = -1e299
_BIT = np.array([0, 1, 28, 2, 29, 14, 24, 3, 30, 22, 20, 15, 25, 17, 4, 8, 31, 27, 13, 23, 21, 19, 16, 7, 26, 12, 18, 6, 11, 5, 10, 9], np.uint8)  # fixed values: De Bruijn positions


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of each non-zero 32-bit value."""
    with np.errstate(over="ignore"):
        return _BIT[((x & (~x + np.uint32(1))) * np.uint32(0x077CB531)) >> np.uint32(27)]


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing against the left neighbour (none at the first of a text)."""
    left = np.empty_like(label)
    left[1:] = label[:-1]
    left[first] = ~label[first]
    differ = label ^ left
    bit = _lowest_bit(np.where(differ == 0, np.uint32(1), differ))
    return (bit.astype(np.uint32) << np.uint32(1)) | ((label >> bit.astype(np.uint32)) & np.uint32(1))


def parse_level(name: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and text boundaries (at: n + 1 offsets) of phrases `name`."""
    first = np.zeros(len(name) + 1, bool)
    first[at[:-1]] = True
    first = first[:-1]
    # runs of equal phrases become one
    keep = first.copy()
    keep[1:] |= name[1:] != name[:-1]
    start = np.flatnonzero(keep)
    length = np.diff(np.append(start, len(name)))
    name, first = name[start].copy(), first[start]
    with np.errstate(over="ignore"):
        long = length > 1
        name[long] = mix64(name[long] + length[long].astype(U64) * U64(0xD1B54A32D192ED03))
    label = (name & U64(0xFFFFFFFF)).astype(np.uint32)
    for _ in range(ROUNDS):
        label = _toss(label, first)
    # a block begins at a local maximum inside a text, and at its first phrase
    begin = first.copy()
    if len(label) > 2:
        begin[1:-1] |= (label[1:-1] >= label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    place = np.flatnonzero(begin)
    which = np.cumsum(begin) - 1
    with np.errstate(over="ignore"):
        rel = (np.arange(len(name)) - place[which]).astype(U64)
        joined = mix64(np.add.reduceat(mix64(name + rel * U64(0x8CB92BA72F3D8DD7)), place)) if len(place) else np.zeros(0, U64)
    return joined, np.searchsorted(start[place], at)


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted bottom-k sketch of each text's phrase names."""
    size = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    name = CODE[np.frombuffer(b"".join(texts), np.uint8)]
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(texts))
    with np.errstate(over="ignore"):
        for level in range(1, LEVELS + 1):
            if not len(name):
                break
            name, at = parse_level(name, at)
            if level >= FIRST_LEVEL:
                kept.append((np.repeat(rows, np.diff(at)), name + U64(level) * U64(0x9E3779B97F4A7C15)))
    none = np.zeros(0, U64)
    row = np.concatenate([r for r, _ in kept]) if kept else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in kept]) if kept else none
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    edges = np.searchsorted(row, np.arange(len(texts) + 1))
    return [value[edges[i] : min(edges[i] + SKETCH, edges[i + 1])] for i in range(len(texts))]


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the name sets behind two sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[: max(SKETCH if max(len(a), len(b)) >= SKETCH else len(a) + len(b), 1)]
    return float((np.isin(union, a) & np.isin(union, b)).mean())


def _ranges(docs: DataFrame, range_bytes: int) -> list[tuple[float, int]]:
    """(first id, parts) of ranges of about range_bytes of text, by quantiles of the id. An id that holds several quantiles
    is a range alone, cut into as many parts; so are the rows without an id."""
    total, rows, named = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    n = min(int((total or 0) // range_bytes) + 1, MAX_RANGES)
    if n == 1:
        return []
    bare = math.ceil(n * (rows - named) / rows)
    m = max(n - bare, 1)
    cuts = docs.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / m for i in range(1, m)], 0.2 / m) if named else []
    parts = {-float("inf"): max(bare, 1), NO_ID: 1}
    for cut, times in Counter(float(int(c)) for c in cuts).items():
        alone = times > 1 and abs(cut) < 2**52
        parts[cut] = times if alone else parts.get(cut, 1)
        if alone:
            parts.setdefault(cut + 1, 1)
    return sorted(parts.items())


def with_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs(doc_id, text) in ranges: (part, doc_id, text, extra), sorted, each range followed by an extra copy of the
    next range's first row (the first range's, after the last)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = _ranges(docs, range_bytes)
    ranged = docs.withColumn("part", F.lit(0).cast("long"))
    if ranges:  # a binary search per row; rows without an id are the first range
        split = Bucketizer(splits=[*(start for start, _ in ranges), float("inf")], inputCol="_id", outputCol="_range")
        ranged = split.transform(docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(2 * NO_ID)))).withColumn("part", F.col("_range").cast("long") * 2**32)
        hot = [(i * 2**32, parts) for i, (_, parts) in enumerate(ranges) if parts > 1]
        if hot:  # one row per hot id, fewer than ranges
            hot = spark.createDataFrame(hot, "part long, _parts int")
            share = F.xxhash64("text") / F.lit(2.0**64) + 0.5  # 0 to 1, in the order of the hash
            own = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1)
            ranged = ranged.join(F.broadcast(hot), "part", "left").withColumn("part", F.col("part") + F.coalesce(own, F.lit(0)))
        ranged = ranged.select("doc_id", "text", "part")
    order = F.struct("doc_id", F.xxhash64("text").alias("h"))
    first = {r["part"]: (r["o"]["doc_id"], r["o"]["h"]) for r in ranged.groupBy("part").agg(F.min(order).alias("o")).collect()}  # one row per range
    if not first:
        return ranged.withColumn("extra", F.lit(0)).limit(0)
    present = sorted(first)
    heads = spark.createDataFrame([(p, first[p][0], first[p][1], present[i - 1]) for i, p in enumerate(present)], "hp long, hid long, hh long, before long")
    ranged = ranged.join(F.broadcast(heads), (F.col("part") == F.col("hp")) & F.col("doc_id").eqNullSafe(F.col("hid")) & (F.xxhash64("text") == F.col("hh")), "left")
    copies = F.when(F.col("hp").isNull(), F.array(F.struct(F.col("part"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("part"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("part"), F.lit(1).alias("extra")))
    )
    dealt = ranged.select("doc_id", "text", F.explode(copies).alias("c")).select("c.part", "doc_id", "text", "c.extra")
    return dealt.repartition(len(present), "part").sortWithinPartitions("part", "extra", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, sketch, next text, next sketch)."""
        edited = [_edited(r[1], r[3]).encode() for r in rows]
        sketch = fingerprints(edited)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
             pa.array([to_text(r[2]) for r in rows], pa.string()), pa.array([to_text(s) for s in sketch], pa.string()),
             pa.array([likeness(r[2], s) for r, s in zip(rows, sketch, strict=True)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in rows], pa.float64())],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row that waits for its next one
        for batch in batches:
            part, ids, texts, extra = (batch.column(i).to_pylist() for i in range(4))
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size < BLOCK_BYTES):
                    size += len(texts[stop])
                    stop += 1
                sketch = fingerprints([t.encode() for t in texts[at:stop]])
                ready = []
                for i in range(at, stop):
                    mine = (part[i], ids[i], texts[i], sketch[i - at], extra[i])
                    if held is not None and held[0] == part[i] and not held[4]:
                        ready.append((held[1], held[2], held[3], mine[2], mine[3]))
                    held = mine
                if ready:
                    yield finish(ready)
                at = stop

    dealt = with_next(docs, range_bytes)
    return dealt.select("part", "doc_id", "text", "extra").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
