"""BPE encoding and decoding against the library and against plain merging, on odd texts and all code points."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenlake.llm import bpe
from tests.llm.test_operators import ODD, documents, prose


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(bpe.load())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


def wanted(library, texts):
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def letters(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("aabcdeeefghiiklmnoooprstttuvwxyz  ETAOIN'0123,.-\n\téü中\U0001f600") for _ in range(n))


TEXTS = [t for _, t in ODD] + [
    "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoft", "I'll we've it's 'S", "a \n\n b  c", " " * 20_000 + "a", "a" * 5_000, "ab" * 5_000, "中文" * 3_000,
    "\x00\x1c\x85​﻿", "é ² Ⅷ ٠", *(letters(i, 300) for i in range(300)),
]


def test_ids_equal_the_library_and_decode_to_the_text(vocab, library):
    got = [x.tolist() for x in vocab.encode(TEXTS)]
    assert got == wanted(library, TEXTS)
    assert [vocab.decode(np.array(x, np.int64)) for x in got] == [library.decode(x, skip_special_tokens=False) for x in got]


def test_every_code_point_falls_into_the_librarys_words(vocab, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} {c}" for c in points[i : i + 8000]) for i in range(0, len(points), 8000)]
    assert [x.tolist() for x in vocab.encode(texts)] == wanted(library, texts)


def test_words_that_fail_verification_are_merged_exactly(vocab, library):
    words = sorted({w for t in TEXTS for w in vocab.find_words(t or "")} - {""})
    ids, failing = vocab.encode_words(words)
    assert 0 < failing < len(words)
    pre = library.pre_tokenizer
    assert all(len(pre.pre_tokenize_str(w)) == 1 for w in words)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == wanted(library, words)
    plain = [vocab.merge(w.encode()) for w in words]  # the way of long words, for all
    assert plain == wanted(library, words)


def small_vocabulary(merges, added=()):
    names = {b: c for c, b in bpe.byte_names().items()}
    vocab = {names[b]: b for b in range(256)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    spec = {
        "added_tokens": [{"id": len(vocab) + i, "content": c} for i, c in enumerate(added)], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
        "decoder": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]},
    }
    return json.dumps(spec).encode()


@pytest.mark.parametrize("seed", range(12))
def test_random_merge_tables_against_plain_merging(seed):
    """Few letters and many merges: pairs that forestall each other, equal merges side by side, unreachable tokens."""
    r = random.Random(seed)
    tokens, merges = ["a", "b", "c"], []
    while len(merges) < 25:
        a, b = r.choice(tokens), r.choice(tokens)
        if a + b not in tokens and len(a + b) < 9:
            tokens.append(a + b)
            merges.append((a, b))
    v = bpe.Vocabulary(small_vocabulary(merges))
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 24))) for _ in range(400)]

    def plain(word):
        parts = list(word)
        for _ in word:
            ranks = [merges.index(p) if p in merges else 99 for p in zip(parts, parts[1:], strict=False)]
            if not ranks or min(ranks) == 99:
                break
            i = ranks.index(min(ranks))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    found, _ = v.encode_words(words)
    assert [[v.bytes[i].decode() for i in np.frombuffer(x, "<i4")] for x in found] == [plain(w) for w in words]
    usable = {b.decode() for b in v.tokens if set(b) <= set(b"abc")}
    assert usable == {t for t in tokens if plain(t) == [t]}


def test_other_kinds_of_vocabularies_are_refused():
    spec = json.loads(small_vocabulary([("a", "b")]))
    spec["normalizer"] = {"type": "NFC"}
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(spec).encode())
    with pytest.raises(ValueError):
        bpe.Vocabulary(small_vocabulary([("ab", "c"), ("a", "b")][::-1] + [("a", "bc"), ("b", "c")][::-1]))


def test_tables(spark, library):
    rows = [*ODD, *((2000 + i, prose(i, 30)) for i in range(50)), (5000, "x<|endoftext|>y")]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(documents(spark, rows, extra=True)).collect()}
    ids = wanted(library, [t for _, t in rows])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for (i, _), x in zip(rows, ids, strict=True)}
    assert bpe.digests(documents(spark, rows)).count() == len(rows)
    assert bpe.digests(documents(spark, [])).count() == 0


def test_decoding_any_ids(spark, library):
    rows = [("a", [464, 50256, 198]), ("b", [-1, 99_999, 220]), ("c", []), ("d", None), ("e", [160, 161, 464]), ("f", [None, 464])]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id string, ids array<long>")).collect()}
    assert got == {i: library.decode([x for x in ids or [] if x is not None and 0 <= x < 50257], skip_special_tokens=False) for i, ids in rows}
