"""Benchmark decontamination: a distributed positional inverted index over training documents.

build_index() stores the postings of all words, for each document its terms (64-bit hashes) in order
with the positions of each. The index knows nothing of any benchmark: it can be written once and
searched for one benchmark after another. It is sharded by document: nothing is shuffled, however
many documents share a passage. Summing it gives each benchmark term's document frequency.

search() intersects offset-adjusted posting lists from the rarest term of each benchmark window
outwards, so a window costs as much as its rarest term, and marks the words inside exact phrase
matches. Around each place of the rarest term it also takes the nearest place of every other term in
the window's order, which gives the tightest span around that place: a span of at most SLOP words
more than the window's is a proximity match.

The benchmark is hashed in tasks and travels to the search in parts of at most PART_WORDS words (a
fixed bound; a longer item is cut into pieces that overlap by a window); a larger benchmark takes one
narrow pass over the index per part, with hits merged in the row itself.

A word is a run of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is `k`
consecutive words of an item; an item of fewer words, but not none, is one window.

Defined cases: null and empty texts have no words and no hits; items without words are never
found; repeated documents are judged each; repeated item_ids count once; a null item_id is written
as an empty string; very long texts and items are taken whole; an empty benchmark hits nothing; an
empty table gives an empty result; extra columns of docs are ignored, or kept (clean_documents).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import U64, utf8, words
from lumenlake.llm.common import blocks, materialize

WINDOW = 10
#: Words by which the span of a proximity match may exceed its window.
SLOP = 4
#: Benchmark words that one part may hold; each part is broadcast.
PART_WORDS = 300_000


def benchmark_words(benchmark: DataFrame, k: int, part_words: int) -> DataFrame:
    """(i, h): item_id as text and the word hashes of each item that has words, long items in pieces that overlap by k - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(1))
                w = words(data, offsets)
                at = np.concatenate([[0], np.cumsum(w.count)])
                rows = [(d, w.hash[at[d] + j : min(at[d] + j + part_words, at[d + 1])]) for d in range(part.num_rows) for j in range(0, max(int(w.count[d]) - k + 1, min(int(w.count[d]), 1)), max(part_words - k + 1, 1))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in rows], pa.int64())), pa.array([h.tobytes() for _, h in rows], pa.binary())], ["i", "h"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").mapInArrow(run, "i string, h binary")


def benchmark_parts(benchmark: DataFrame, k: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """(item_id as text, word hashes) of the items, in parts of about part_words words; the driver holds one part at a time."""
    part, size = [], 0
    for row in materialize(benchmark_words(benchmark, k, part_words), "benchmark-words").toLocalIterator(prefetchPartitions=False):
        h = np.frombuffer(row["h"], U64)
        if part and size + len(h) > part_words:
            yield part
            part, size = [], 0
        part.append((row["i"], h))
        size += len(h)
    if part:
        yield part


class Windows:
    """The distinct windows of a part of the benchmark, as term ids."""

    def __init__(self, items: list[tuple[str, np.ndarray]], k: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        name_of = {n: j for j, n in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, U64)
        self.terms: list[np.ndarray] = []
        self.items: list[list[int]] = []
        at: dict[bytes, int] = {}
        for name, h in items:
            t = np.searchsorted(self.vocabulary, h).astype(np.int32)
            for j in range(max(1, len(t) - k + 1)):
                w = t[j : j + k]
                n = at.setdefault(w.tobytes(), len(at))
                if n == len(self.terms):
                    self.terms.append(w)
                    self.items.append([])
                self.items[n].append(name_of[name])

    def ordered(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each window its offsets and terms from the rarest term outwards (-1 beyond a short window), and its length."""
        k = max([len(w) for w in self.terms], default=1)
        offset, term = np.full((len(self.terms), k), -1, np.int32), np.full((len(self.terms), k), -1, np.int32)
        for i, w in enumerate(self.terms):
            rare = np.argsort(frequency[w], kind="stable")
            offset[i, : len(w)], term[i, : len(w)] = rare, w[rare]
        return offset, term, np.array([len(w) for w in self.terms], np.int64)


def build_index(docs: DataFrame) -> DataFrame:
    """docs(row, text, ...) without the text but with n_words and the row's postings: terms (64-bit hashes in order), how
    often each occurs (int32), and the word positions of each in turn (int32)."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", n_words long, terms binary, counts binary, positions binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_text"):
                data, offsets = utf8(part.column(len(kept)))
                w = words(data, offsets)
                begin = np.cumsum(w.count) - w.count
                by = np.argsort(w.hash, kind="stable")
                order = by[np.argsort(w.doc[by].astype(np.int32), kind="stable")]  # by document, term, position
                h, doc = w.hash[order], w.doc[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                place = np.flatnonzero(first)
                lists = ((h[place], doc[place]), (np.diff(np.append(place, len(h))).astype(np.int32), doc[place]), ((order - begin[doc]).astype(np.int32), doc))
                stored = [_packed(v, np.bincount(d, minlength=part.num_rows)) for v, d in lists]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(w.count), *stored], [*kept, "n_words", "terms", "counts", "positions"])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def _packed(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """A binary array of each row's values."""
    at = np.concatenate([[0], np.cumsum(count)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def document_frequency(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents that hold each term: summed in each task first, so a task sends one row per term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            known, _ = _known(np.frombuffer(utf8(batch.column(0))[0].tobytes(), U64), vocabulary)
            total += np.bincount(known, minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def _known(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the vocabulary, places) of the hashes that it holds."""
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    place = np.flatnonzero(vocabulary[at] == h)
    return at[place], place


def _postings(n: np.ndarray, terms: pa.Array, counts: pa.Array, positions: pa.Array, vocabulary: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position within the batch, term id) of the vocabulary's postings and the documents' first positions, `gap` words apart."""
    t, t_at = utf8(terms)
    h, count, position = np.frombuffer(t.tobytes(), U64), np.frombuffer(utf8(counts)[0].tobytes(), np.int32), np.frombuffer(utf8(positions)[0].tobytes(), np.int32)
    base = np.cumsum(n + gap) - n
    known, place = _known(h, vocabulary)
    doc, own, start = np.repeat(np.arange(len(n)), np.diff(t_at) // 8)[place], count[place], (np.cumsum(count) - count)[place]
    at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start, own)
    return np.repeat(base[doc], own) + position[at], np.repeat(known, own), base


def intersect(position: np.ndarray, term: np.ndarray, size: int, offset: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence: each window's rarest list, thinned by its other terms from rare to common."""
    by_term = np.argsort(term, kind="stable")
    sorted_terms = term[by_term]
    low, high = np.searchsorted(sorted_terms, terms[:, 0], "left"), np.searchsorted(sorted_terms, terms[:, 0], "right")
    count = high - low
    window = np.repeat(np.arange(len(terms)), count)
    rank = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
    start = position[by_term[low[window] + rank]] - offset[window, 0]
    at = np.full(size + 1, -1, np.int32)  # the term at each position; the last place stands for "outside"
    at[position] = term
    for j in range(1, terms.shape[1]):
        want = terms[window, j]
        place = start + offset[window, j]
        keep = (want < 0) | (at[np.where((place >= 0) & (place < size), place, size)] == want)
        window, start = window[keep], start[keep]
    return window, start


def near(position: np.ndarray, term: np.ndarray, size: int, offset: np.ndarray, terms: np.ndarray, length: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place of its rarest term) of the proximity matches: the nearest places of the terms before and after it, in
    the window's order, lie within the window's length and slop."""
    order = np.lexsort((position, term))
    key = term[order].astype(np.int64) * (size + 1) + position[order]
    low, high = (np.searchsorted(key, terms[:, 0].astype(np.int64) * (size + 1) + end) for end in (0, size))
    count = high - low
    window = np.repeat(np.arange(len(terms)), count)
    place = position[order][low[window] + np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)]
    anchor = offset[:, 0].astype(np.int64)  # where in the window the rarest term is
    in_order = np.full_like(terms, -1)
    for j in range(terms.shape[1]):
        some = terms[:, j] >= 0
        in_order[some, offset[some, j]] = terms[some, j]
    first, last, begin, end = place.copy(), place.copy(), place, place
    for step in range(1, terms.shape[1]):
        for way in (-1, 1):
            j = anchor[window] + way * step
            todo = (j >= 0) & (j < length[window])
            want = in_order[window, np.clip(j, 0, terms.shape[1] - 1)].astype(np.int64) * (size + 1)
            at = np.searchsorted(key, want + (last + 1 if way > 0 else first)) - (way < 0)
            inside = np.clip(at, 0, max(len(key) - 1, 0))
            found = key[inside] - want
            ok = (at >= 0) & (at < len(key)) & (found >= 0) & (found < size)
            if way > 0:
                last = np.where(todo, found, last)
            else:
                first = np.where(todo, found, first)
            keep = (~todo | ok) & (last - first < length[window] + slop)
            window, place, first, last = window[keep], place[keep], first[keep], last[keep]
    return window, place


def search(index: DataFrame, windows: Windows, frequency: np.ndarray, slop: int = SLOP) -> DataFrame:
    """The index with hits (packed bits, one per word; empty: none), items and near_items (ids found exactly, and in
    proximity), merged with those of an earlier part."""
    offset, term, length = windows.ordered(frequency)
    names, items, vocabulary = windows.names, windows.items, windows.vocabulary
    merge = "hits" in index.columns
    lists = ["terms", "counts", "positions"]
    kept = [c for c in index.columns if c not in (*lists, "hits", "items", "near_items")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.select(*kept, *lists).schema) + ", hits binary, items array<string>, near_items array<string>"
    gap = int(length.max(initial=1)) + slop

    def ids(base: np.ndarray, place: np.ndarray, window: np.ndarray) -> dict[int, set[str]]:
        found: dict[int, set[str]] = {}
        for d, w in set(zip((np.searchsorted(base, place, "right") - 1).tolist(), window.tolist(), strict=True)):
            found.setdefault(d, set()).update(names[i] for i in items[w])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in blocks(big, "positions"):
                n = batch.column(kept.index("n_words")).to_numpy(zero_copy_only=False)
                k = len(kept)
                position, terms, base = _postings(n, *batch.columns[k : k + 3], vocabulary, gap)
                size = int(base[-1] + n[-1]) + gap
                exact = intersect(position, terms, size, offset, term)
                close = near(position, terms, size, offset, term, length, slop)
                window, start = exact
                edge = np.zeros(size + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                found, about = ids(base, start, window), ids(base, close[1], close[0])
                bits, lists_ = [], ([], [])
                for d in range(batch.num_rows):
                    mine = hit[base[d] : base[d] + n[d]]
                    if merge and (earlier := batch.column(k + 3)[d].as_py()):
                        mine = mine | np.unpackbits(np.frombuffer(earlier, np.uint8), count=int(n[d])).astype(bool)
                    bits.append(np.packbits(mine).tobytes() if mine.any() else b"")
                    for j, new in enumerate((found, about)):
                        own = new.get(d, set())
                        lists_[j].append(sorted(own | set(batch.column(k + 4 + j)[d].as_py()) if merge else own))
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + 3], pa.array(bits, pa.binary()), *(pa.array(x, pa.list_(pa.string())) for x in lists_)], [*kept, *lists, "hits", "items", "near_items"])

    return index.select(*kept, *lists, *(["hits", "items", "near_items"] if merge else [])).mapInArrow(run, schema)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, columns: list[str], k: int = WINDOW, part_words: int = PART_WORDS, slop: int = SLOP) -> DataFrame:
    """row (a struct of the given columns of docs), n_words, hits, items and near_items of every document."""
    index = materialize(build_index(docs.select(F.struct(*columns).alias("row"), F.col("text"))), "positional-index")
    return search_benchmark(index, benchmark, k, part_words, slop)


def search_benchmark(index: DataFrame, benchmark: DataFrame, k: int = WINDOW, part_words: int = PART_WORDS, slop: int = SLOP) -> DataFrame:
    """row, n_words, hits, items and near_items of every document of a stored index."""
    state, none = index, F.array().cast("array<string>")
    for n, items in enumerate(benchmark_parts(benchmark, k, part_words)):
        windows = Windows(items, k)
        state = search(state if n == 0 else materialize(state, "index-hits"), windows, document_frequency(index, windows.vocabulary), slop)
    if state is index:
        state = index.withColumns({"hits": F.lit(b""), "items": none, "near_items": none})
    return state.drop("terms", "counts", "positions")


def _n_hit(hits: Column) -> Column:
    """Set bits: the hexadecimal text's digits, weighed by their bits."""
    digits = F.hex(hits)
    return sum((F.length(digits) - F.length(F.replace(digits, F.lit(f"{d:X}"), F.lit("")))) * d.bit_count() for d in range(1, 16)).cast("long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items with proximity matches, the exact ones
    among them) of every document."""
    found = match_benchmark(docs, benchmark, ["doc_id"], **options)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", _n_hit(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.length("hits") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    found = match_benchmark(docs, benchmark, docs.columns, **options)
    return found.where(F.length("hits") == 0).select("row.*")


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, **options) -> DataFrame:
    """doc_id, item_id of documents that hold all terms of a window, in order, within k + slop words."""
    found = match_benchmark(docs, benchmark, ["doc_id"], slop=slop, **options)
    return found.select(F.col("row.doc_id").alias("doc_id"), F.explode("near_items").alias("item_id")).distinct()


#: Exact, but it lists every window of the corpus: for tests and small inputs.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, len(ws[i:i+9]) AS n, array_to_string(ws[i:i+9], ' ') AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ln AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i+n-1], ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ln WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
bl AS (SELECT DISTINCT item, ws[i:i+9] AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sl AS (SELECT doc_id, ws[i] AS head, ws[i:i+13] AS part FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
nr AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM sl JOIN bl ON head = win[1]
       WHERE list_has_all(part[:len(win) + 4], win) AND regexp_matches(array_to_string(part[:len(win) + 4], ' '), '^' || array_to_string(win, ' (?:[^ ]+ )*?') || '(?: |$)') GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
