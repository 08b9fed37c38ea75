"""The prefix trie against nested dictionaries, on hot prefixes, many copies, long conversations and odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            name = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            turns[c].append(((turn is not None, turn or 0), name, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        path = (*own.get(base, [])[:h], *own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def got(frame, **options):
    rows = prefix_trie.trie(frame, **options).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows)


def conversations(seed, n):
    """Few words, so that prefixes are shared at all depths; one first turn opens half of them, a fifth are equal as a whole."""
    r, rows = random.Random(seed), []
    for c in range(n):
        if c % 5 == 0 and c % 2:
            rows += [(c, t, "user", f"same {t}") for t in range(6)]
            continue
        rows += [(c, t, r.choice(["user", "assistant"]) if t else "system", "hot" if t == 0 and r.random() < 0.5 else r.choice("abcé")) for t in range(r.randint(1, 7))]
    r.shuffle(rows)
    return rows


ODD = [
    (None, 0, "user", "no id"), (1000, None, "user", "null turn"), (1000, 0, None, None), (1000, 0, None, None), (1000, 0, "user", ""), (1000, -3, "user", "before"), (-7, 0, "user", "negative id"), (-5, 0, "user", "its base"),
    (1003, 5, "system", "without a base"), (1011, 0, "user", "x" * 200_000), (1012, 0, "user", "x" * 200_000),
]


@pytest.mark.parametrize("shard_turns", [500_000, 40, 3])
def test_nodes_equal_dictionaries_whatever_the_shards(spark, shard_turns):
    rows = conversations(1, 160) + ODD
    frame = spark.createDataFrame(rows, SCHEMA)
    for c in ("names", "sizes", "size", "depth", "n", "t", "of", "h", "digest", "path", "cut"):  # names that the operator uses itself
        frame = frame.withColumn(c, F.lit("mine"))
    assert got(frame, shard_turns=shard_turns) == plain(rows)


def test_long_conversations_that_share_deep_prefixes(spark):
    rows = [(10 * c, t, "user", f"{t}" if t < 300 + c else f"{c} {t}") for c in range(4) for t in range(400)]
    assert got(spark.createDataFrame(rows, SCHEMA), shard_turns=500) == plain(rows)


def test_a_sequence_of_many_members_is_hashed_in_blocks(spark):
    rows = [(5 * c, t, "user", "same") for c in range(700) for t in range(2)]
    assert got(spark.createDataFrame(rows, SCHEMA), ends_bytes=64) == plain(rows)


def test_no_conversations(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []


def test_conversations_left_without_turns_belong_to_the_root(spark):
    rows = [(c, 0, "user", "short") for c in range(1, 60) if c % 5]  # no bases: the first h turns go
    want = plain(rows)
    assert want[0][3] == 48 and any(r[1] == 0 for r in want)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


@pytest.mark.parametrize("seed", range(8))
def test_double_array_holds_just_its_sequences(seed):
    r = random.Random(seed)
    words = [[r.randint(1, 30 if seed % 2 else 4) for _ in range(r.randint(0, 9))] for _ in range(300)]
    size = np.array([len(w) for w in words])
    array, ids = prefix_trie.packed(np.array([x for w in words for x in w], np.int64), np.cumsum(size) - size, size, 30)
    prefixes, at, slots = {()}, 0, {(): 0}
    for w in words:
        slot, path = 0, ()
        for x in ids[at : at + len(w)].tolist():
            slot, path = int(array.step(np.array([slot]), np.array([x]))[0]), (*path, x)
            assert slot > 0 and slots.setdefault(path, slot) == slot
            prefixes.add(path)
        at += len(w)
    assert len(set(slots.values())) == len(prefixes) == 1 + int((array.check >= 0).sum())
    for path, slot in slots.items():
        for x in range(1, 31):
            assert (int(array.step(np.array([slot]), np.array([x]))[0]) >= 0) == ((*path, x) in prefixes)
