"""Prefix trie of conversations in double arrays.

Conversations are first rebuilt: the first h turns of conversation c - c % 5, then c's own turns after its first h, with
h = crc32 of c's decimal digits modulo 9. A node is a distinct sequence of leading turns.

1. A turn becomes a 128-bit name, the front half of the SHA-256 of its role and text, and its text's bytes; texts are not
   shuffled. Ids of five conversations meet by one shuffle on c - c % 5.
2. Equal rebuilt conversations become one sequence with its members' number, least id and hash of ids. The ids are sorted
   in ranges, each range joins them to blocks of text, and the blocks of a sequence are hashed in turn, so a sequence of
   very many members is spread over tasks but for the hash itself.
3. Prefix shards: all sequences with the same first turn, and where these hold more than SHARD_TURNS turns, the first 2, 4,
   8, ... turns. A task takes whole shards, as many as fit, and gives their turns dense ids. The trie's edges are packed
   into two arrays: the child of slot s by turn t is BASE[s] + t, if CHECK there is s. All sequences walk through the
   arrays side by side and leave their members' number and least id at every slot; sums over subtrees go up by CHECK.
4. Shards share the nodes above their roots. Each root's totals are added to all nodes above, for all shards at once.

A shard's trie takes about 100 bytes a turn in its task. A conversation's turn names (24 bytes a turn) are one row, and
so is one that no other shares turns with: a single conversation of 10**7 turns is some hundreds of megabytes.

Defined cases: null roles and texts are empty; null turns come first, and equal turns of one conversation by their names;
ids that are no whole numbers are null, and rows without an id take no part; repeated rows are turns of their own; a
conversation left without turns is a member of the root alone; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import broadcast_if_small, materialize, small_batches

NAME = 16
#: Turns of a shard before it is cut at a longer prefix, and turns that a task packs into one pair of arrays.
SHARD_TURNS = 500_000
#: Bytes of joined ids that travel as one row to the hash of a sequence's members.
ENDS_BYTES = 65_536
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ORACLE = """
WITH convs AS (
  SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), steps AS (
  SELECT c, l, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM convs
), rebuilt AS (
  SELECT a.c, CASE WHEN b.c IS NULL THEN a.l[a.h + 1:] ELSE list_concat(b.l[1:a.h], a.l[a.h + 1:]) END AS l FROM steps a LEFT JOIN convs b ON b.c = a.c - a.c % 5
), prefixes AS (
  SELECT c, len(l) AS n, d, l[1:d] AS p FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * strlen(p[d].t) END AS own
  FROM prefixes GROUP BY p, d
), children AS (
  SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (p)
), sums AS (
  SELECT p[1:k] AS p, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY 1
)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, CAST(a.n_convs AS BIGINT) AS n_convs, CAST(a.n_children AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM full_nodes a JOIN sums s USING (p) LEFT JOIN nodes b ON a.d > 0 AND b.p = a.p[1:a.d - 1]
"""


# ---- double arrays


class DoubleArray:
    """BASE and CHECK of a trie, filled level by level. Slot 0 is the root; turn ids are 1 and more."""

    def __init__(self, turns: int):
        self.base, self.check = np.zeros(turns + 2, np.int64), np.full(turns + 2, -2, np.int64)
        self.check[0], self.top, self.from_ = -1, 1, 1  # slots from top on are free, those before from_ are taken

    def _reserve(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -2, np.int64))

    def add_level(self, parent: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Slots of the edges (slot of the parent, turn), sorted by both; no parent has had children before."""
        if not len(parent):
            return np.zeros(0, np.int64)
        slots = np.zeros(len(parent), np.int64)
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        many = np.diff(np.append(first, len(parent)))
        for at, n in zip(first[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            slots[at : at + n] = self._fit(int(parent[at]), turn[at : at + n])
        alone = first[many == 1]
        slots[alone] = self._free(len(alone))
        self.base[parent[alone]], self.check[slots[alone]] = slots[alone] - turn[alone], parent[alone]
        return slots

    def _free(self, n: int) -> np.ndarray:
        holes = self.from_ + np.flatnonzero(self.check[self.from_ : self.top] == -2)[:n]
        self._reserve(self.top + n)
        taken = np.append(holes, np.arange(self.top, self.top + n - len(holes)))
        if len(holes):
            self.from_ = int(holes[-1]) + 1
        if len(holes) < n:
            self.top += n - len(holes)
            self.from_ = self.top
        return taken

    def _fit(self, parent: int, turns: np.ndarray) -> np.ndarray:
        """The first free place of the children among the next holes, else behind all slots."""
        offset = turns - turns[0]
        self._reserve(self.top + int(offset[-1]) + 1)
        holes = self.from_ + np.flatnonzero(self.check[self.from_ : self.from_ + 256] == -2)
        holes = holes[holes < self.top]
        holes = holes[holes + offset[-1] < len(self.check)]
        fits = np.flatnonzero((self.check[holes[:, None] + offset] == -2).all(axis=1)) if len(holes) * len(offset) <= 1 << 20 else holes[:0]
        slots = (int(holes[fits[0]]) if len(fits) else self.top) + offset
        self.base[parent], self.check[slots] = int(slots[0] - turns[0]), parent
        self.top = max(self.top, int(slots[-1]) + 1)
        return slots

    def step(self, slot: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The child of each slot by its turn, -1 where there is none."""
        to = self.base[slot] + turn
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slot), to, -1)


def dense(names: np.ndarray) -> tuple[np.ndarray, int]:
    """Names (n x 2 words) to ids 1, 2, ..., and how many there are."""
    order = np.lexsort((names[:, 1], names[:, 0]))
    new = np.append(True, (names[order][1:] != names[order][:-1]).any(axis=1))[: len(names)]
    ids = np.zeros(len(names), np.int64)
    ids[order] = np.cumsum(new)
    return ids, int(new.sum())


def packed(ids: np.ndarray, start: np.ndarray, size: np.ndarray, n_ids: int) -> tuple[DoubleArray, np.ndarray]:
    """The double array of the sequences ids[start:start + size], and the ids renumbered in the order in which the trie's
    levels meet them, so that siblings lie close together."""
    levels, state, count = [], np.zeros(len(size), np.int64), 1
    active, depth = np.flatnonzero(size > 0), 0
    while len(active):
        edges, which = np.unique(state[active] * (n_ids + 1) + ids[start[active] + depth], return_inverse=True)
        levels.append(edges)
        state[active] = count + which
        count, depth = count + len(edges), depth + 1
        active = active[size[active] > depth]
    met = np.concatenate([np.zeros(0, np.int64), *(e % (n_ids + 1) for e in levels)])
    first = np.unique(met, return_index=True)
    name = np.zeros(n_ids + 1, np.int64)
    name[first[0][np.argsort(first[1])]] = np.arange(1, len(first[0]) + 1)
    array, slot_of, at = DoubleArray(count), np.zeros(count, np.int64), 1
    for edges in levels:
        parent, turn = slot_of[edges // (n_ids + 1)], name[edges % (n_ids + 1)]
        order = np.lexsort((turn, parent))
        slot_of[at + order] = array.add_level(parent[order], turn[order])
        at += len(edges)
    return array, name[ids]


def nodes_of(names: list[bytes], sizes: np.ndarray, members: np.ndarray, least: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of the sequences' trie, no deeper node before a higher one: depth, cut (the depth of its shard's root), n, conv_id,
    parent (its conv_id), n_children, n_leaves, saved, end (the sequence that ends there, or -1), any (a sequence through it)."""
    size = np.array([len(x) // NAME for x in names], np.int64)
    start = np.cumsum(size) - size
    ids, n_ids = dense(np.frombuffer(b"".join(names), "<u8").reshape(-1, 2))
    array, ids = packed(ids, start, size, n_ids)
    room = len(array.check)
    depth, n, conv, through, bytes_, ends, root = (np.zeros(room, np.int64) for _ in range(7))
    conv[:], ends[:] = np.iinfo(np.int64).max, -1
    state, active, level, order = np.zeros(len(size), np.int64), np.flatnonzero(size > 0), 0, []
    while len(active):
        at = start[active] + level
        slot = array.step(state[active], ids[at])
        if (slot < 0).any():
            raise AssertionError("a sequence has left the trie that was packed from it")
        level += 1
        depth[slot], through[slot], bytes_[slot] = level, active, sizes[at]
        np.add.at(n, slot, members[active])
        np.minimum.at(conv, slot, least[active])
        np.maximum.at(root, slot, cut[active])
        state[active] = slot
        order.append(np.unique(slot))
        last = size[active] == level
        ends[slot[last]] = active[last]
        active = active[~last]
    children = np.zeros(room, np.int64)
    saved = (n - 1) * bytes_
    slots = np.concatenate([np.zeros(0, np.int64), *order])
    np.add.at(children, array.check[slots], 1)
    leaves = (children == 0).astype(np.int64)
    for own in reversed(order[1:]):
        np.add.at(leaves, array.check[own], leaves[own])
        np.add.at(saved, array.check[own], saved[own])
    parent = array.check[slots]
    out = {"depth": depth, "cut": root, "n": n, "conv_id": conv, "n_children": children, "n_leaves": leaves, "saved": saved, "end": ends, "any": through}
    return {k: v[slots] for k, v in out.items()} | {"parent": conv[parent]}


# ---- tables


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, names (NAME bytes a turn) and sizes (bytes of each turn's text) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    conv_id = F.expr("try_cast(conv_id AS bigint)")
    turns = conversations.where(conv_id.isNotNull()).select(conv_id.alias("conv_id"), (conv_id - conv_id % 5).alias("of"), F.struct("turn", name.alias("name"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    # partitioned by `of`, conversations and their heads need no other shuffle
    own = turns.repartition("of").groupBy("of", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("of", "conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["name"]), "")).alias("names"), F.transform("t", lambda t: t["size"]).alias("sizes"))
    heads = own.where(F.col("conv_id") == F.col("of")).select("of", F.expr(f"substring(names, 1, {8 * NAME})").alias("head"), F.slice("sizes", 1, 8).alias("head_sizes"))
    joined = own.join(heads, "of", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    names = F.concat(F.coalesce(F.expr(f"substring(head, 1, {NAME} * h)"), F.unhex(F.lit(""))), F.expr(f"substring(names, {NAME} * h + 1)"))
    sizes = F.concat(F.coalesce(F.expr("slice(head_sizes, 1, h)"), F.array().cast("array<bigint>")), F.expr("slice(sizes, h + 1, size(sizes))"))
    return joined.select("conv_id", names.alias("names"), sizes.alias("sizes"))


def prefix(turns: int | Column) -> Column:
    return F.substring("names", F.lit(1), F.lit(NAME) * turns)


def joined_ids(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (digest, conv_id) sorted by both to blocks of about `most` bytes: digest, first, n, ids (comma-joined)."""
    digest, first, ids, size = None, 0, [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([",".join(ids)])], ["digest", "first", "n", "ids"])

    out = []
    for batch in batches:
        for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (d != digest or size > most):
                out.append(block())
                ids, size = [], 0
            if not ids:
                digest, first = d, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out = []
    if ids:
        yield block()


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by digest and first to one row a digest: digest, members, least, ends (SHA-256 of all ids)."""
    state: list = []

    def row(s: list) -> tuple:
        return s[0], s[1], s[2], s[3].hexdigest()

    for batch in batches:
        out = []
        for digest, first, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state and state[0] == digest:
                state[1] += n
                state[3].update(b"," + ids.encode())
            else:
                if state:
                    out.append(row(state))
                state = [digest, n, first, hashlib.sha256(ids.encode())]
        yield _ends(out)
    if state:
        yield _ends([row(state)])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["digest", "members", "least", "ends"])


def sequences(convs: DataFrame, ends_bytes: int) -> DataFrame:
    """names, sizes, n_turns, members, least and ends of each distinct rebuilt conversation."""
    named = convs.withColumn("digest", F.unhex(F.sha2("names", 256)))
    ranged = named.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    blocks = ranged.mapInArrow(partial(joined_ids, most=ends_bytes), "digest binary, first long, n long, ids string")
    ends = blocks.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed_ids, "digest binary, members long, least long, ends string")
    distinct = named.groupBy("digest").agg(F.first("names").alias("names"), F.first("sizes").alias("sizes"))
    return distinct.join(ends, "digest").select("names", "sizes", (F.length("names") / NAME).cast("int").alias("n_turns"), "members", "least", "ends")


def sharded(seqs: DataFrame, shard_turns: int) -> DataFrame:
    """seqs with cut: how many leading turns name the shard. Shards above shard_turns turns are cut at twice as many."""
    done, todo, cut = [], seqs, 1
    while True:
        todo = todo.withColumn("cut", F.lit(cut))
        shards = todo.where(F.col("n_turns") >= cut).groupBy(F.sha2(prefix(cut), 256).alias("shard")).agg(F.sum("n_turns").alias("turns"), F.count("*").alias("n"))
        large = materialize(shards.where((F.col("turns") > shard_turns) & (F.col("n") > 1)).select("shard"), "trie-large")
        if not large.limit(1).count():
            done.append(todo)
            break
        named = todo.withColumn("shard", F.sha2(prefix(cut), 256)).join(broadcast_if_small(large.withColumn("is_large", F.lit(True))), "shard", "left")
        again = F.coalesce(F.col("is_large") & (F.col("n_turns") >= cut), F.lit(False))
        named = materialize(named.withColumn("again", again).drop("shard", "is_large"), "trie-cuts")
        done.append(named.where(~F.col("again")).drop("again"))
        todo, cut = named.where("again").drop("again"), 2 * cut
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, names binary, sizes array<long>"


def shard_nodes(seqs: DataFrame, chunk: int) -> DataFrame:
    """The nodes of all shards; those at a shard's root come with their names and sizes, and without a parent."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        names, lists, ends = t.column("names").to_pylist(), t.column("sizes").combine_chunks(), t.column("ends").to_pylist()
        sizes = lists.flatten().to_numpy()
        got = nodes_of(names, sizes, t.column("members").to_numpy(), t.column("least").to_numpy(), t.column("cut").to_numpy().astype(np.int64))
        got = {k: v[got["depth"] >= got["cut"]] for k, v in got.items()}
        top = got["depth"] == got["cut"]
        begin = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        path = [(names[r][: NAME * d], sizes[begin[r] : begin[r] + d].tolist()) if is_top else (None, None) for r, d, is_top in zip(got["any"].tolist(), got["depth"].tolist(), top.tolist(), strict=True)]
        columns = [*(pa.array(got[k]) for k in ("conv_id", "depth")), pa.array(got["parent"], mask=top), *(pa.array(got[k]) for k in ("n", "n_children", "n_leaves", "saved"))]
        columns += [pa.array([ends[e] if e >= 0 else None for e in got["end"].tolist()], pa.string()), pa.array([p[0] for p in path], pa.binary()), pa.array([p[1] for p in path], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns, last = [], 0, None
        for batch in batches:
            shard = np.array(batch.column("shard").to_pylist(), object)
            begins = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in pairwise(begins):
                if a == b:
                    continue
                if shard[a] != last and turns >= chunk:
                    yield rows(held)
                    held, turns = [], 0
                held.append(batch.slice(a, b - a))
                turns += int(batch.column("n_turns").slice(a, b - a).to_numpy().sum())
                last = shard[a]
        if held:
            yield rows(held)

    inside = seqs.where(F.col("n_turns") >= F.col("cut")).withColumn("shard", F.unhex(F.sha2(prefix(F.col("cut")), 256)))
    return inside.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, NODES)


def upper_nodes(roots: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes above the shards' roots, from the roots' totals and from the sequences that end above them."""
    below = roots.select("names", "sizes", F.col("n_convs").alias("n"), F.col("conv_id").alias("c"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"), F.expr(f"sequence(0, int(length(names) / {NAME}) - 1)").alias("d"))
    zero = F.lit(0).cast("long")
    here = ended.select("names", "sizes", F.col("members").alias("n"), F.col("least").alias("c"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends", F.expr("sequence(0, n_turns)").alias("d"))
    parts = below.unionByName(here).withColumn("d", F.explode("d")).withColumn("ends", F.when(F.length("names") == F.col("d") * NAME, F.col("ends")))
    size = F.when(F.col("d") > 0, F.expr("try_element_at(sizes, d)")).otherwise(0)
    nodes = parts.groupBy(prefix(F.col("d")).alias("path"), "d").agg(
        F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), F.sum("n_leaves").alias("below_leaves"), F.sum("saved_tokens").alias("below_saved"), F.max(size).alias("size"), F.max("ends").alias("ends_sha256")
    )
    nodes = materialize(nodes, "trie-upper")
    above = lambda c: F.expr(f"substring({c}, 1, length({c}) - {NAME})").alias("path")
    children = nodes.where("d > 0").select(above("path")).unionAll(roots.select(above("names"))).groupBy("path").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "path", "left").fillna(0, ["n_children"])
    own = nodes.select("path", F.explode(F.sequence(F.lit(0), "d")).alias("k"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    sums = own.groupBy(F.expr(f"substring(path, 1, {NAME} * k)").alias("path")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    return nodes.join(sums, "path").select(
        "path", above("path").alias("above"), "conv_id", F.col("d").cast("long").alias("depth"), "n_convs", "n_children", (F.col("below_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("below_saved") + F.col("own")).alias("saved_tokens"), "ends_sha256",
    )


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, ends_bytes: int = ENDS_BYTES) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    convs = materialize(rebuilt(conversations), "trie-conversations")
    seqs = sharded(materialize(sequences(convs, ends_bytes), "trie-sequences"), shard_turns)
    nodes = materialize(shard_nodes(seqs, shard_turns), "trie-nodes")
    roots, ended = nodes.where(F.col("names").isNotNull()), seqs.where(F.col("n_turns") < F.col("cut"))
    upper = materialize(upper_nodes(roots, ended), "trie-merged")
    parents = broadcast_if_small(upper.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id")))
    tops = roots.drop("parent_conv_id").withColumn("above", F.expr(f"substring(names, 1, length(names) - {NAME})")).join(parents, "above")
    higher = upper.where("depth > 0").join(parents, "above").unionByName(upper.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")
    parts = [x.select(*COLUMNS[:-1], ends) for x in (nodes.where(F.col("names").isNull()), tops, higher)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
