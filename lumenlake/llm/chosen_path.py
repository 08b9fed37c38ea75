"""N-gram Jaccard join by chosen paths.

Texts with the same words (A-Z folded) are one class: only one representative of each enters the
join. A representative's set is its 5-word shingles. The set is embedded as T min-hashes, and each
run grows a tree of paths over it: at every node the path's own hash samples about 1/lambda of the
coordinates, and the set follows one child for each sampled (coordinate, token), so two sets that
share tokens keep sharing nodes and the critical branching keeps a pair of similarity lambda
together with probability of at least about 1/(depth + 1) a run. Runs repeat until the expected
recall of a pair at the threshold is reached.

Leaves with company are the buckets. A bucket of more than SPLIT rows is split further: its sets walk
SPLIT_STEPS more steps in fresh sub-runs, as many as a recall of SPLIT_RECALL takes, and where that
lessens the bucket's pairs its parts take its place; and so on until buckets are small or their sets
too much alike to part. Buckets are compared by brute force on byte sketches of the min-hashes and
only yield tree edges of likely pairs. The components of those edges are then verified exactly: all
pairs of a component are compared on their full shingle sets. Both brute force steps deal a group out
in blocks of about BLOCK sets, the pairs of blocks in turn over the tasks, so a large group of near
copies is spread evenly and nothing is capped or dropped; the price is that such a group's work grows
with the square of its different texts, as its links do. Links, and the classes that linked texts
form, come from the exact step only.

Defined cases: a text of fewer than five words, but not none, is one shingle of all its words; a
null text or one without words is alone, unless another text is byte-identical to it and not
empty; repeated rows are copies of each other; a null doc_id is never a class's name, and a class
that has no other id gets none; ties are broken by the least key; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import U64, Words, hash_spans, mix64, shingles, utf8, words
from lumenlake.llm.common import blocks, broadcast_if_small, drop_materialized, materialize
from lumenlake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
T = 96
DEPTH = 3
RECALL = 0.999
#: Byte sketches must agree on this share to count as likely; about 5 standard deviations below the threshold.
LIKELY = 0.6
BLOCK = 512
#: Rows of a bucket from which it is split further, steps of a split, its recall, and splits at most.
SPLIT, SPLIT_STEPS, SPLIT_RECALL, MAX_SPLITS = 64 * BLOCK, 6, 0.9999, 8


def runs_needed(similarity: float = SIMILARITY, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Independent runs after which a pair at the threshold has met with probability `recall`.

    One coordinate is sampled with certainty at each node and another with probability
    1/similarity - 1, so a pair that agrees on each coordinate with probability s has on average
    at least one shared child: the chance to lose it by depth d solves q = E[(1 - s + s q')^children].
    """
    lost = 0.0
    for _ in range(depth):
        keep = similarity * (1 - lost)
        lost = (1 - keep) * ((1 - (1 / similarity - 1)) + (1 / similarity - 1) * (1 - keep))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


_SEEDS = mix64(np.arange(1, T + 1, dtype=U64) * U64(0xA24BAED4963EE407))


def min_hashes(doc: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """rows x T 32-bit min-hashes of the shingles (row, hash); rows without shingles get zeros."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    present, first = np.unique(doc, return_index=True)
    out = np.zeros((rows, T), np.uint32)
    with np.errstate(over="ignore"):
        low = (value & U64(0xFFFFFFFF)).astype(np.uint32)
        for j in range(T if len(value) else 0):
            x = (low ^ np.uint32(int(_SEEDS[j]) & 0xFFFFFFFF)) * np.uint32((int(_SEEDS[j]) >> 32) | 1)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            out[present, j] = np.minimum.reduceat(x, first)
    return out


def paths(mins: np.ndarray, run: int, depth: int = DEPTH, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the chosen paths of one run."""
    return walk(mins, np.full(len(mins), int(mix64(np.array([run + 1], U64))[0]), U64), depth, similarity)


def walk(mins: np.ndarray, node: np.ndarray, depth: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the chosen paths that begin at each row's node."""
    row = np.arange(len(mins))
    more = U64(int((1 / similarity - 1) * 2**32))
    with np.errstate(over="ignore"):
        for _ in range(depth):
            pick = mix64(node + U64(0x632BE59BD9B4E019))
            second = (pick >> U64(32)) < more
            c1 = (pick & U64(0xFFFF)) % U64(T)
            c2 = (c1 + U64(1) + ((pick >> U64(16)) & U64(0xFFFF)) % U64(T - 1)) % U64(T)
            child1 = mix64(node ^ mix64(c1 * U64(0x100000001) ^ (mins[row, c1.astype(int)].astype(U64) << U64(8))))
            r2 = row[second]
            child2 = mix64(node[second] ^ mix64(c2[second] * U64(0x100000001) ^ (mins[r2, c2[second].astype(int)].astype(U64) << U64(8))))
            row, node = np.concatenate([row, r2]), np.concatenate([child1, child2])
    return row, node


def _sets(w: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, by row."""
    doc, value = shingles(w, SHINGLE)
    bare = np.flatnonzero((w.count == 0) & (np.diff(offsets) > 0))
    doc = np.concatenate([doc, bare])
    value = np.concatenate([value, hash_spans(data, offsets[:-1][bare], offsets[1:][bare])])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def class_keys(w: Words, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each row's word sequence; of its bytes where it has no words; 0 for empty rows."""
    key, begin = np.zeros(len(w.count), U64), np.cumsum(w.count) - w.count
    some = np.flatnonzero(w.count)
    with np.errstate(over="ignore"):
        value = mix64(w.hash + mix64((np.arange(len(w.hash)) - begin[w.doc]).astype(U64) + U64(11)))
        if len(some):
            key[some] = mix64(np.add.reduceat(value, begin[some]) + w.count[some].astype(U64))
        bare = np.flatnonzero((w.count == 0) & (np.diff(offsets) > 0))
        key[bare] = mix64(hash_spans(data, offsets[:-1][bare], offsets[1:][bare]) + U64(5))
    return key


def sketches(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, key, sketch, leaves) of every document: its class, the low bytes of its min-hashes and the leaves of all runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(1))
                w = words(data, offsets)
                mins = min_hashes(*_sets(w, data, offsets), part.num_rows)
                found = [paths(mins, r) for r in range(runs)]
                row, leaf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                full = np.diff(offsets)[row] > 0
                row, leaf = row[full], leaf[full]
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(leaf[np.argsort(row, kind="stable")].view(np.int64)))
                low = (mins & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(class_keys(w, data, offsets).view(np.int64)), pa.array([r.tobytes() for r in low], pa.binary()), leaves],
                    ["doc_id", "key", "sketch", "leaves"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, sketch binary, leaves array<bigint>")


def with_class_key(docs: DataFrame) -> DataFrame:
    """docs and the key of each text's class as _class_key."""

    @F.arrow_udf("long")
    def keys(text: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for part in blocks(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            data, offsets = utf8(part.column(0))
            out.append(class_keys(words(data, offsets), data, offsets).view(np.int64))
        return pa.array(np.concatenate(out))

    return docs.withColumn("_class_key", keys("text"))


def full_sets(members: DataFrame) -> DataFrame:
    """(group, key, n, copies, payload) with the full shingle set as payload, for members(group, key, n, copies, text)
    whose text has that key: the text of another row with the same id is not taken for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(4))
                w = words(data, offsets)
                own = np.flatnonzero(class_keys(w, data, offsets).view(np.int64) == part.column(1).to_numpy())
                doc, value = _sets(w, data, offsets)
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                sets = pa.array([value[at[i] : at[i + 1]].tobytes() for i in own], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(own)) for c in part.columns[:4]), sets], ["group", "key", "n", "copies", "payload"])

    return members.select("group", "key", "n", "copies", "text").mapInArrow(run, "group long, key long, n long, copies long, payload binary")


def split_rows(rows: DataFrame, level: int) -> DataFrame:
    """(parent, run, group, key): rows(group, key, sketch) a few steps further down, in fresh sub-runs."""
    runs = runs_needed(depth=SPLIT_STEPS, recall=SPLIT_RECALL)
    steps = SPLIT_STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parent, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sketch = np.frombuffer(utf8(batch.column(2))[0].tobytes(), np.uint8).reshape(-1, T)
            for r in range(runs):
                row, leaf = walk(sketch, mix64(parent.view(U64) ^ mix64(np.array([(level + 1) * 1000 + r], U64))), steps)
                pair = np.unique(np.stack([row.astype(np.int64), leaf.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(parent[pair[0]]), pa.array(np.full(pair.shape[1], r, np.int32)), pa.array(pair[1]), pa.array(key[pair[0]])], ["parent", "run", "group", "key"])

    return rows.select("group", "key", "sketch").mapInArrow(run, "parent long, run int, group long, key long")


def buckets(leaves: DataFrame, sketch: DataFrame, limit: int | None = None) -> DataFrame:
    """(group, key, n): the leaves(group, key) with company, large ones split while that lessens their pairs; n is the group's size."""
    limit = limit or SPLIT
    done, now = None, leaves
    for level in range(MAX_SPLITS + 1):
        sizes = materialize(now.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "join-sizes")
        sized = now.join(sizes, "group").select("group", "key", "n")
        large = sizes.where(F.col("n") > limit)
        if level == MAX_SPLITS or not large.limit(1).count():
            return sized if done is None else done.unionByName(sized)
        rows = sized.where(F.col("n") > limit).join(sketch, "key")
        parts = materialize(split_rows(rows, level), "join-split")
        counts = parts.groupBy("parent", "run", "group").agg(F.count("*").cast("double").alias("c"))
        after = counts.where("c > 1").groupBy("parent").agg(F.sum(F.col("c") * F.col("c")).alias("after"))
        pays = large.join(after, F.col("parent") == F.col("group"), "left").where(F.coalesce("after", F.lit(0.0)) < 0.5 * F.col("n") * F.col("n"))
        pays = broadcast_if_small(materialize(pays.select(F.col("group").alias("parent")), "join-pays"))
        kept = materialize(sized.join(pays, sized["group"] == pays["parent"], "left_anti"), "join-kept")
        done = kept if done is None else done.unionByName(kept)
        now = parts.join(pays, "parent", "left_semi").select("group", "key")
    raise AssertionError("unreachable")


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deal rows(group, key, n, copies, payload) out to pairs of blocks of their group: g names the pair, left
    and right say in which of its blocks a row is (both, when a block meets itself). A group's pairs go to the tasks in turn."""
    count = F.ceil(F.col("n") / block).cast("long")
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    turn = F.expr("_low * (2 * _count - _low - 1) div 2") + high
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.withColumn("_count", count)
        .withColumn("_own", F.pmod(F.xxhash64("key", "group"), F.col("_count")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1)))
        .withColumn("_low", low)
        .select(
            F.pmod(F.xxhash64("group") % tasks + turn, F.lit(tasks)).cast("int").alias("task"), F.xxhash64("group", "_low", high).alias("g"), "key", "copies", "payload",
            (F.col("_own") <= F.col("_other")).alias("left"), (F.col("_own") >= F.col("_other")).alias("right"),
        )
        .repartitionById(tasks, "task")
        .drop("task")
        .sortWithinPartitions("g", "key")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal g in sorted batches; each has two blocks of rows at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column(0).to_numpy()
        if not len(g):
            continue
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != g[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row of its component."""
    label = np.arange(len(linked))
    closed = linked | np.eye(len(linked), dtype=bool)
    while True:
        best = np.where(closed, label[None, :], len(label)).min(1)
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _agreement(sketch: list[bytes]) -> np.ndarray:
    """Share of equal bytes of every two sketches."""
    m = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), T)
    return np.stack([(m == row).sum(1) for row in m]) / T


def _jaccard(sets: list[bytes], columns: int = 4096) -> np.ndarray:
    """Jaccard similarity of every two sets: products of 0/1 matrices over the elements that two sets or more share."""
    values = [np.frombuffer(x, np.uint64) for x in sets]
    size = np.array([len(v) for v in values], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    _, element, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    owner, element = owner[shared], (np.cumsum(times > 1) - 1)[element[shared]]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, columns):
        a, b = np.searchsorted(element, [low, low + columns])
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[a:b], element[a:b] - low] = 1
        common += m @ m.T
    return common / np.maximum(size[:, None] + size[None, :] - common, 1)


def _pairs(table: pa.Table, similar: np.ndarray) -> np.ndarray:
    """The similar pairs that this pair of blocks has to answer for."""
    left, right = (table.column(c).to_numpy().astype(bool) for c in ("left", "right"))
    cross = left[:, None] & right[None, :]
    out = similar & (cross | cross.T)
    np.fill_diagonal(out, False)
    return out


def likely_edges(blocks_of_buckets: DataFrame, likely: float = LIKELY) -> DataFrame:
    """(u, v): trees that join the likely pairs of each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for t in _groups(batches):
            root = _roots(_pairs(t, _agreement(t.column("payload").to_pylist()) >= likely))
            key = t.column("key").to_numpy()
            child = np.flatnonzero(root != np.arange(len(root)))
            seen.update(zip(key[child].tolist(), key[root[child]].tolist(), strict=True))
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.int64())], ["u", "v"])
                seen = set()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in seen], pa.int64()), pa.array([b for _, b in seen], pa.int64())], ["u", "v"])

    return blocks_of_buckets.mapInArrow(run, "u long, v long")


def verified_links(blocks_of_components: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, root, links): each set's documents linked to it and the root of its tree, for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            linked = _pairs(t, _jaccard(t.column("payload").to_pylist()) >= similarity - 1e-9)
            key, copies = t.column("key").to_numpy(), t.column("copies").to_numpy()
            links = linked.astype(np.int64) @ copies
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(key[_roots(linked)[some]]), pa.array(links[some])], ["key", "root", "links"])

    return blocks_of_components.mapInArrow(run, "key long, root long, links long")


def keyed_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """jaccard_join with each document's class of equal texts (key) and of linked ones (component; null where key is 0)."""
    rows = materialize(sketches(docs, runs_needed(recall=recall)), "join-sketches")
    named = rows.where("key <> 0").select("doc_id", "key")
    classes = materialize(named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-classes")
    one = materialize(rows.where("key <> 0").select("key", "sketch", "leaves").dropDuplicates(["key"]), "join-sets")
    leaves = one.select("key", F.explode(F.array_distinct("leaves")).alias("group"))
    together = buckets(leaves, one.select("key", "sketch")).join(one.select("key", F.col("sketch").alias("payload")), "key").withColumn("copies", F.lit(1).cast("long"))
    edges = likely_edges(in_blocks(together.select("group", "key", "n", "copies", "payload")))
    groups = components(edges, "join-candidates")
    whole = groups.select(F.col("node").alias("key"), F.col("component").alias("group")).unionByName(groups.select(F.col("component").alias("key"), F.col("component").alias("group")).distinct())
    sizes = whole.groupBy("group").agg(F.count("*").alias("n"))
    members = materialize(whole.join(sizes, "group").join(classes, "key").select("group", "key", "n", "copies", F.col("rep").alias("doc_id")), "join-members")
    drop_materialized(one)
    drop_materialized(groups)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(members), "doc_id")
    nameless = members.where("doc_id IS NULL").drop("doc_id")
    if nameless.limit(1).count():  # their texts are found by class
        bare = with_class_key(docs.where(F.col("doc_id").isNull()).select("text")).withColumnRenamed("_class_key", "key").dropDuplicates(["key"])
        columns = ["group", "key", "n", "copies", "text"]
        texts = texts.select(*columns).unionByName(bare.join(broadcast_if_small(nameless), "key").select(*columns))
    sets = materialize(full_sets(texts).dropDuplicates(["key"]), "join-full-sets")
    drop_materialized(members)
    links = materialize(verified_links(in_blocks(sets)), "join-links")
    drop_materialized(sets)
    degree = links.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(links.where("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")), "join-classes-of-links")
    labelled = classes.join(joined, classes["key"] == joined["node"], "left").select(classes["key"], "rep", "copies", F.coalesce("component", classes["key"]).alias("component"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("class_id"))
    final = labelled.join(least, "component").join(degree, "key", "left").select("key", "component", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "key").join(final, "key", "left").select("doc_id", "key", "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every document: class_id is the least doc_id among the documents joined to it by
    links, n_links the number of other documents with the same words or a similarity of 0.8 or more."""
    return keyed_join(docs, recall).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without their near copies: of each class one row stays, with the least doc_id (an id before none),
    then the least key; of rows with the same id and words any one. Rows without a class stay.

    Rows go by id and text, so another text with the same id is not taken for them. The rows that go are the smaller
    side of the join: broadcast while they are few, shuffled beyond that.
    """
    joined = materialize(keyed_join(docs).where("key <> 0").select("doc_id", "key", "component"), "join-result")
    rows = joined.groupBy("component", "key", "doc_id").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key")).alias("best")
    company = rows.groupBy("component").agg(best, F.sum("n").alias("size")).where("size > 1").select("component", F.col("best.doc_id").alias("best_id"), F.col("best.key").alias("best_key"))
    placed = rows.join(broadcast_if_small(company), "component")
    placed = placed.withColumn("stays", (F.col("key") == F.col("best_key")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    placed = materialize(placed.select(F.col("doc_id").alias("_id"), F.col("key").alias("_of"), "n", "stays"), "join-gone")
    gone, again = placed.where("NOT stays"), placed.where("stays AND n > 1").select("_id", "_of")
    keyed = with_class_key(docs)
    same = (F.col("_class_key") == F.col("_of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    kept = keyed.join(broadcast_if_small(gone.select("_id", "_of")), same, "left_anti")
    if again.limit(1).count():
        again = broadcast_if_small(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_class_key"]))
    return kept.select(*docs.columns)
