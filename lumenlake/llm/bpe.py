"""Byte-level BPE encoding and decoding by speculation and verification.

A text is cut at the strings of added tokens, the pieces at the vocabulary's word pattern. For each word that a worker
has not met lately, the longest match from the left proposes tokens. A sequence of tokens is what merging gives exactly
if each token is what merging gives for its own bytes and no adjacent pair is disturbed: undoing the merges at the seam of
the pair from the last to the first, no two tokens that met there could have merged before one of them was used
otherwise. Tokens that their own bytes do not give are never proposed; the seams of all proposals of a block are walked
together in numpy, all pairs at once. Only the words with a disturbed pair are merged exactly.

The vocabulary file (its path is a parameter) is read once on the driver and its bytes, a fixed size, travel with the
tasks. encode() and decode() are narrow: no shuffle, one pass, and no more than a block of texts and the vocabulary in a
worker; a text longer than a block is a block of its own.

Defined cases: null and empty texts give no ids, null ids an empty text; very long texts and words are encoded whole;
repeated rows stay; ids of any type pass through; an empty table gives no rows; extra columns are ignored; ids that the
vocabulary does not hold are skipped; bytes that are no UTF-8 decode as U+FFFD. A vocabulary with other parts (a
normaliser, dropout, another word pattern, added tokens that strip white space) raises a ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lumenlake.llm.common import blocks, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Letters and numbers of newer Unicode versions that the vocabulary's library takes for neither.
NEWER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F"
)
NEWER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Words that a worker keeps with their ids, and the longest that it keeps.
CACHE_WORDS = 400_000
CACHE_CHARS = 48
#: Bytes from which a word is merged by itself, and the cells of a table of shorter words that are merged together.
LONG_WORD = 64
MERGE_CELLS = 1_000_000
#: Later than every merge.
NEVER = np.int64(1 << 40)


def _spans(text: str) -> set[int]:
    bounds = [[int(x, 16) for x in run.split("-")] for run in text.split()]
    return {c for b in bounds for c in range(b[0], b[-1] + 1)}


def _class(members: set[int]) -> str:
    """The code points as ranges of a character class."""
    runs: list[list[int]] = []
    for c in sorted(members):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{first:08X}-\\U{last:08X}" for first, last in runs)


def word_pattern(end: int = 0x110000) -> re.Pattern:
    """The words of the vocabulary: endings, runs of letters, numbers or other marks behind at most one space, white space.
    For texts of code points before end. The classes are spelled out: the standard module looks those below 0x10000 up
    in a table, and walks through the ranges above."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, end))))
    members = {kind: set(map(ord, regex.findall(kind, every))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    letter, number, space = _class(members[r"\p{L}"] - _spans(NEWER_LETTERS)), _class(members[r"\p{N}"] - _spans(NEWER_NUMBERS)), _class(members[r"\s"])
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_names() -> dict[str, int]:
    """The characters that stand for bytes in a vocabulary file: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in plain}
    return names | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """Tokens, merges in the order of their ranks and the tables that speculation and verification read."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if spec.get(k)]
        if odd or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {odd or before}")
        names = byte_names()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")) or "" in self.added:
            raise ValueError("added tokens that take more or less than their own text are not built")
        size = max([*model["vocab"].values(), *self.added.values(), -1]) + 1
        self.bytes: list[bytes] = [b""] * size
        for name, i in (model["vocab"] | self.added).items():
            self.bytes[i] = bytes(names[c] for c in name) if all(c in names for c in name) else name.encode()
        self.known = np.zeros(size, bool)
        self.known[[*model["vocab"].values(), *self.added.values()]] = True
        id_of = {self.bytes[i]: i for i in model["vocab"].values()}
        self.byte_id = np.array([id_of[bytes([b])] for b in range(256)], np.int64)
        self._load_merges([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], model["vocab"], size)
        usable = self._own_results(size)
        self.tokens = {b: i for b, i in id_of.items() if usable[i]}
        self.longest: dict[bytes, int] = {}  # of the tokens that begin with two bytes
        for b in self.tokens:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 0), len(b))
        self._load_trie()
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words, self.words_below = word_pattern(), word_pattern(0x10000)
        self.cache: dict[str, bytes] = {}

    def _load_merges(self, merges: list[list[str]], vocab: dict[str, int], size: int) -> None:
        left, right = (np.array([vocab[m[side]] for m in merges], np.int64) for side in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.rank = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.left[made], self.right[made], self.rank[made] = left, right, np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[left], self.rank[right]) >= np.arange(len(made))).any():
            raise ValueError("a token is made by two merges, or before its parts")
        self.pair: dict[tuple[int, int], tuple[int, int]] = {(a, b): (k, m) for k, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        self.made = made
        key = left * size + right
        self.order = np.argsort(key)
        self.keys, self.size = key[self.order], size

    def _load_trie(self) -> None:
        """Steps of the trie of all usable tokens, as sorted keys node * 256 + byte; the token that ends at a node, or -1."""
        steps: dict[int, int] = {}
        ends = [-1]
        for token, i in self.tokens.items():
            node = 0
            for byte in token:
                key = node * 256 + byte
                node = steps.setdefault(key, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        key = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(key)
        self.step_keys, self.step_to, self.ends = key[order], np.fromiter(steps.values(), np.int64, len(steps))[order], np.array(ends)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, NEVER where there is none."""
        if not len(self.keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def undisturbed(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """True where merging the bytes of the tokens a and b side by side, up to the merges before limit, leaves just a and b.

        A step undoes the later of the two merges that made the tokens at the seam. Both tokens there were at hand until
        the merge undone last; had they a merge before it, that would have come first. Of equal merges the left one
        comes first, so a pair may be as late as the merge undone last only if that was on the left."""
        a, b = np.asarray(a, np.int64).copy(), np.asarray(b, np.int64).copy()
        fine = np.ones(len(a), bool)
        until = np.full(len(a), 2 * NEVER) if limit is None else 2 * np.asarray(limit, np.int64)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            disturbed = 2 * self.pair_rank(x, y) < until[todo]
            fine[todo[disturbed]] = False
            todo, x, y = todo[~disturbed], x[~disturbed], y[~disturbed]
            made_x, made_y = self.rank[x], self.rank[y]
            on_left, on_right = made_x > made_y, (made_y >= made_x) & (made_y >= 0)
            a[todo[on_left]] = self.right[x[on_left]]
            until[todo[on_left]] = 2 * made_x[on_left]
            b[todo[on_right]] = self.left[y[on_right]]
            until[todo[on_right]] = 2 * made_y[on_right] + 1
            todo = todo[on_left | on_right]
        return fine

    def _own_results(self, size: int) -> np.ndarray:
        """Tokens that merging their own bytes gives: single bytes, and tokens of two such whose merge nothing forestalls."""
        usable = np.zeros(size, bool)
        usable[self.byte_id] = True
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        sound = self.undisturbed(self.left[made], self.right[made], self.rank[made])
        for i, ok in zip(made.tolist(), sound.tolist(), strict=True):
            usable[i] = ok and usable[self.left[i]] and usable[self.right[i]]
        return usable

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest usable token at each place from the left, for all words data[start:end] in step: (word, token), in
        the order of the words and of the tokens in each."""
        words, tokens = [], []
        short = end - start <= LONG_WORD
        for i in np.flatnonzero(~short).tolist():  # a step for all words would be one for each byte of the longest
            found = self.propose_long(data[start[i] : end[i]].tobytes())
            words.append(np.full(len(found), i))
            tokens.append(np.array(found, np.int64))
        todo, begin = np.flatnonzero((end > start) & short), start.copy()
        at, node = start.copy(), np.zeros(len(start), np.int64)
        best, behind = np.full(len(start), -1, np.int64), start.copy()
        while len(todo):
            inside = at[todo] < end[todo]
            key = node[todo] * 256 + data[np.minimum(at[todo], len(data) - 1)]
            found = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            on = inside & (self.step_keys[found] == key)
            go = todo[on]
            node[go] = self.step_to[found[on]]
            at[go] += 1
            ended = self.ends[node[go]]
            best[go[ended >= 0]], behind[go[ended >= 0]] = ended[ended >= 0], at[go[ended >= 0]]
            stop = todo[~on]
            words.append(stop)
            tokens.append(best[stop])
            begin[stop] = at[stop] = behind[stop]
            node[stop], best[stop] = 0, -1
            todo = todo[(begin[todo] < end[todo])]
        word, token = np.concatenate([np.zeros(0, np.int64), *words]), np.concatenate([np.zeros(0, np.int64), *tokens])
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def propose_long(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            size = min(self.longest.get(word[at : at + 2], 1), n - at)
            while size > 1 and word[at : at + size] not in self.tokens:
                size -= 1
            out.append(self.tokens[word[at : at + size]])
            at += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of a long word: always the pair of the lowest rank, of equal ones the leftmost."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(rank, i, made) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pair for rank, made in [self.pair[p]]]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.pair.get((ids[i], ids[j]), (-1, -1)) != (rank, made):
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := self.pair.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1]))
        return [i for i in ids if i >= 0]

    def merge_all(self, data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """Exact merging of many words of one size, a merge in each at a time: their ids, -1 behind the last."""
        ids = self.byte_id[data[start[:, None] + np.arange(size)]]
        rank = self.pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), size - 1)
        rank = np.concatenate([rank, np.full((len(ids), 1), NEVER)], axis=1)
        todo, columns = np.arange(len(ids)), np.arange(size)
        while len(todo):
            first = rank[todo].argmin(axis=1)
            lowest = rank[todo, first]
            todo, first, lowest = todo[lowest < NEVER], first[lowest < NEVER], lowest[lowest < NEVER]
            if not len(todo):
                break
            behind = np.minimum(columns + (columns > first[:, None]), size - 1)
            row, its = ids[todo], rank[todo]
            moved, ranks = np.take_along_axis(row, behind, 1), np.take_along_axis(its, behind, 1)
            moved[:, -1], ranks[:, -1] = -1, NEVER
            line = np.arange(len(todo))
            moved[line, first] = self.made[lowest]
            for left in (first - 1, first):
                right = np.minimum(left + 1, size - 1)
                ok = (left >= 0) & (left < size - 1) & (moved[line, right] >= 0)
                ranks[line[ok], left[ok]] = self.pair_rank(moved[line[ok], left[ok]], moved[line[ok], right[ok]])
                none = (left >= 0) & ~ok
                ranks[line[none], left[none]] = NEVER
            ids[todo], rank[todo] = moved, ranks
        return ids

    def encode_words(self, words: list[str]) -> tuple[list[bytes], int]:
        """The ids of each word as 32-bit integers, and how many words had to be merged exactly."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(size)
        start = end - size
        word, token = self.propose(data, start, end)
        seam = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(token[seam] * self.size + token[seam + 1], return_inverse=True)
        fine = self.undisturbed(pairs // self.size, pairs % self.size)[which]
        failing = np.unique(word[seam[~fine]])
        bounds = np.searchsorted(word, np.arange(len(raw) + 1)).tolist()
        flat = token.astype("<i4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for n in np.unique(size[failing]).tolist():
            own = failing[size[failing] == n]
            if n > LONG_WORD:
                for i in own.tolist():
                    out[i] = np.array(self.merge(raw[i]), "<i4").tobytes()
                continue
            for part in np.array_split(own, -(-len(own) * n // MERGE_CELLS)):
                ids = self.merge_all(data, start[part], n)
                used = (ids >= 0).sum(axis=1).tolist()
                for i, row, k in zip(part.tolist(), ids.astype("<i4"), used, strict=True):
                    out[i] = row[:k].tobytes()
        return out, len(failing)

    def find_words(self, text: str) -> list[str]:
        wide = len(text.encode("utf-16-le")) > 2 * len(text)
        return (self.words if wide else self.words_below).findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.split.split(t or "") if self.split else [t or ""] for t in texts]
        words = [[[p] if i % 2 else self.find_words(p) for i, p in enumerate(pieces)] for pieces in cut]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        unmet = [*set().union(*(set(ws) for pieces in words for ws in pieces[::2])).difference(self.cache)]
        new = dict(zip(unmet, self.encode_words(unmet)[0], strict=True))
        self.cache.update((w, ids) for w, ids in new.items() if len(w) <= CACHE_CHARS)
        long = {w: ids for w, ids in new.items() if len(w) > CACHE_CHARS}
        get = (lambda w: long.get(w) or self.cache[w]) if long else self.cache.__getitem__
        added = {w: np.array([i], "<i4").tobytes() for w, i in self.added.items()}
        return [np.frombuffer(b"".join(b"".join(map(added.__getitem__ if i % 2 else get, ws)) for i, ws in enumerate(pieces)), "<i4") for pieces in words]

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.bytes))]
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def load(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, made once per Python worker."""
    name = hashlib.sha256(raw).hexdigest()
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(raw)
    return _vocabularies[name]


def _id_field(df: DataFrame) -> StructField:
    return StructField("doc_id", df.schema["doc_id"].dataType)


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    small_batches(docs.sparkSession)
    raw = load(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(raw)
        for batch in batches:
            for part in blocks(batch, "text"):
                found = vocab.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([_id_field(docs), StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids and the text that the ids stand for."""
    small_batches(encoded.sparkSession)
    raw = load(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(raw)
        for batch in batches:
            ids = [np.zeros(0, np.int64) if x.values is None else x.values.drop_null().to_numpy(zero_copy_only=False) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vocab.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    ids = StructField("ids", ArrayType(IntegerType()))
    return encoded.select("doc_id", F.col("ids").cast(ids.dataType).alias("ids")).mapInArrow(run, StructType([_id_field(encoded), ids, StructField("text", StringType())]))


def digests(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded, and its ids decoded."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    decoded = decode(encode(docs, tokenizer), tokenizer)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
