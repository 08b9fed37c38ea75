"""Token-ID output in training order.

Texts become token ids of a public byte-level BPE vocabulary (its path is a parameter; the file is
read once on the driver and its bytes, a fixed size, travel with the tasks). Each document's ids,
closed by an end-of-text id, are cut into sequences of `length` ids; the last is padded. All
sequences are numbered 0..N-1 in an order that only depends on the documents (hash bucket of id and
text, id, hash of the text; bucket offsets come from prefix sums over the table of bucket totals),
and a keyed Feistel permutation with cycle-walking turns a number into the sequence's global slot.
Ranges of `shard` slots are the shards, and range partitions of whole shards are sorted and written:
slot s is record s % shard of shard s // shard, and a reader resumes anywhere by arithmetic.

Rows with the same id and text are copies. A group of more copies than a bucket takes is dealt over
buckets of its own, as many as it needs: which copy gets which number does not matter, as their
records are equal. Buckets hold max(bucket_rows, sqrt(rows)) documents, so neither a bucket nor the
table of bucket totals grows beyond the square root of a corpus (316,000 rows each at 10**11).

sequences() returns the records as rows; write_shards() writes fixed-stride binary files with a
header of 16 bytes a record (doc_id, seq, n_tokens), read_shards() gives their rows, read_records()
any stretch of their ids.

Defined cases: null and empty texts give one sequence that holds only the end-of-text id; very long
texts and runs of white space are encoded whole; a null doc_id is like any other id; repeated rows
give sequences of their own; ids that are no whole numbers become null; an empty table gives no rows
and no shards; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import U64, mix64
from lumenlake.llm.common import blocks, broadcast_if_small, materialize, scratch_dir

#: The vocabulary's word pattern and its free id.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
LENGTH = 512
SHARD = 4096
BUCKET_ROWS = 2_000
KEY = 20_240_229
ROUNDS = 6
RECORD = "slot long, shard long, record int, doc_id long, seq int, n_tokens int, tokens binary"
#: The record header of a shard file, and what stands for a null doc_id there.
HEADER = np.dtype([("doc_id", "<i8"), ("seq", "<i4"), ("n_tokens", "<i4")])
NO_ID = -(1 << 63)
#: Runs of white space (as the pattern sees it) from this length are encoded on their own: the pattern's look-ahead would
#: step back over them beyond the regex engine's limit.
LONG_SPACE = 10_000
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_encoders: dict[str, Any] = {}


def load_ranks(path: str = TOKENIZER) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The vocabulary's encoding with a word pattern, made once per Python worker."""
    import tiktoken

    name = hashlib.sha256(ranks).hexdigest() + pattern
    if name not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


def encode(text: str, ranks: bytes, long_space: int = LONG_SPACE, own: Any = None) -> list[int]:
    """The text's ids (own: the encoder of ranks, where it is at hand). A long run of white space is one word of the pattern but for its last character, which goes with
    the word that follows; the text is cut there and the run encoded as the one word that it is."""
    own, out, at = own or encoder(ranks), [], 0
    if len(text) >= long_space:
        for m in re.finditer(f"{_SPACE}{{{long_space},}}", text):
            stop = m.end() - (m.end() < len(text))
            out += own.encode_ordinary(text[at : m.start()])
            out += encoder(ranks, r"[\s\S]+").encode_ordinary(text[m.start() : stop])
            at = stop
    return out + own.encode_ordinary(text[at:])


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed bijection of 0..n-1: a balanced Feistel network over the next even power of two, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = U64((1 << half) - 1), U64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) ^ U64(key))
    out = np.asarray(x, dtype=U64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & low
            for k in keys:
                left, right = right, left ^ (mix64(right ^ k) & low)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


def tokenized(docs: DataFrame, ranks: bytes) -> DataFrame:
    """docs(bucket, doc_id, h, text) to (bucket, doc_id, h, n_tokens, ids): each text's ids with the end-of-text id as
    16-bit little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = [np.array([*encode(t or "", ranks, own=own), END_OF_TEXT], "<u2") for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary())], ["bucket", "doc_id", "h", "n_tokens", "ids"])

    return docs.select("bucket", "doc_id", "h", "text").mapInArrow(run, "bucket long, doc_id long, h long, n_tokens long, ids binary")


def bucketed(docs: DataFrame, key: int, bucket_rows: int) -> DataFrame:
    """docs(doc_id, h, text) with the bucket of each row: of the hash of id and text; of its own where many copies need more than one."""
    rows = docs.count()
    size = max(bucket_rows, math.isqrt(rows))
    n_buckets = rows // size + 1
    name = F.xxhash64("doc_id", "h", F.lit(key))
    dealt = docs.withColumn("bucket", F.pmod(name, F.lit(n_buckets)).cast("long"))
    copies = docs.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    hot = materialize(copies, "token-copies")
    if not hot.limit(1).count():
        return dealt
    dealt = dealt.join(broadcast_if_small(hot), dealt["doc_id"].eqNullSafe(hot["_id"]) & (dealt["h"] == hot["_h"]), "left")
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("_n") / size))
    own = n_buckets + F.pmod(name, F.lit(1 << 37)).cast("long") * (1 << 25) + chunk.cast("long")
    return dealt.withColumn("bucket", F.when(F.col("_n").isNull(), F.col("bucket")).otherwise(own)).drop("_id", "_h", "_n")


def records(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, shard: int = SHARD, key: int = KEY, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(slot, shard, record, doc_id, seq, n_tokens, tokens) of every sequence, in no order, and their number."""
    named = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    ids = tokenized(bucketed(named, key, bucket_rows), load_ranks(tokenizer))
    ids = ids.withColumn("n_seq", F.expr(f"(n_tokens + {length - 1}) div {length}"))
    order = Window.partitionBy("bucket").orderBy(F.asc_nulls_first("doc_id"), "h", "n_tokens")
    numbered = ids.withColumn("local", F.sum("n_seq").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_seq"))
    numbered = materialize(numbered.select("bucket", "local", "n_seq", "doc_id", "ids"), "token-ids")
    buckets = numbered.groupBy("bucket").agg(F.sum("n_seq").alias("total"))
    # one row per bucket, the square root of all documents at most
    offsets = materialize(buckets.select("bucket", "total", (F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).alias("offset")), "token-offsets")
    n = int(offsets.agg(F.sum("total")).first()[0] or 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "ids"):
                first, count, ids_ = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                row = np.repeat(np.arange(part.num_rows), count)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                slot = feistel(first[row] + seq, n, key)
                payload, used = [], []
                for r, s in zip(row.tolist(), seq.tolist(), strict=True):
                    piece = ids_[r][2 * length * s : 2 * length * (s + 1)]
                    used.append(len(piece) // 2)
                    payload.append(piece if len(piece) == 2 * length else piece + END_OF_TEXT.to_bytes(2, "little") * (length - len(piece) // 2))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(slot // shard), pa.array((slot % shard).astype(np.int32)), part.column(3).take(pa.array(row)), pa.array(seq.astype(np.int32)), pa.array(used, pa.int32()), pa.array(payload, pa.binary())],
                    ["slot", "shard", "record", "doc_id", "seq", "n_tokens", "tokens"],
                )

    placed = numbered.join(broadcast_if_small(offsets), "bucket").select((F.col("offset") + F.col("local")).alias("first"), "n_seq", "ids", "doc_id")
    return placed.mapInArrow(cut, RECORD), n


def in_ranges(rows: DataFrame, n: int, shard: int) -> DataFrame:
    """rows(slot, shard, ...) dealt to ranges of whole shards, sorted by slot. The slots are a permutation of 0..n-1, so the
    bounds of equal ranges are known without a sample."""
    shards = max(1, -(-n // shard))
    ranges = min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own: Column = F.floor(F.col("shard") * ranges / shards).cast("int")
    return rows.repartitionById(ranges, own).sortWithinPartitions("slot")


def sequences(docs: DataFrame, shard: int = SHARD, **options) -> DataFrame:
    """slot, shard, record, doc_id, seq, n_tokens, tokens (length 16-bit ids) of every sequence, in slot order within ranges of shards."""
    rows, n = records(docs, shard=shard, **options)
    return in_ranges(rows, n, shard)


def _store(folder: str):
    """pyarrow's file system and path of a folder's URI."""
    from pyarrow import fs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("file:/", "file:///", 1) if uri.startswith("s3a://") or (uri.startswith("file:/") and not uri.startswith("file://")) else uri)


def write_shards(docs: DataFrame, folder: str, shard: int = SHARD, length: int = LENGTH, **options) -> DataFrame:
    """Write each shard of docs' records as folder/shard-<number>.bin and return shard, path, n_records, n_bytes, sha256.

    folder is a URI that every executor reaches with pyarrow (file: on a shared mount, hdfs:, s3:). A
    shard is written under a name of its own attempt and then moved into place, so a task may run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        state: dict[str, Any] = {}
        done: list[tuple] = []

        def close() -> None:
            if state:
                state["out"].close()
                path = f"{base}/shard-{state['shard']:08d}.bin"
                store.move(state["temp"], path)
                done.append((state["shard"], path, state["n"], state["bytes"], state["sha"].hexdigest()))
                state.clear()

        for batch in batches:
            number, doc, seq, used = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            head = np.zeros(len(number), HEADER)
            head["doc_id"], head["seq"], head["n_tokens"] = doc, seq, used
            tokens = batch.column(4)
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                s = int(number[low])
                if state and state["shard"] != s:
                    close()
                if not state:
                    temp = f"{base}/.{s}-{uuid.uuid4().hex}"
                    state.update(shard=s, temp=temp, out=store.open_output_stream(temp), n=0, bytes=0, sha=hashlib.sha256())
                for at in range(low, high):
                    x = head[at].tobytes() + tokens[at].as_py()
                    state["out"].write(x)
                    state["sha"].update(x)
                    state["n"] += 1
                    state["bytes"] += len(x)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "path", "n_records", "n_bytes", "sha256"])

    rows, n = records(docs, shard=shard, length=length, **options)
    ordered = in_ranges(rows.select("slot", "shard", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "seq", "n_tokens", "tokens"), n, shard)
    return ordered.select("shard", "doc_id", "seq", "n_tokens", "tokens").mapInArrow(run, "shard long, path string, n_records long, n_bytes long, sha256 string")


def _parse(raw: bytes, length: int) -> np.ndarray:
    """Records of a stretch of a shard file."""
    return np.frombuffer(raw, np.dtype([("head", HEADER), ("tokens", "<u2", (length,))]))


def read_shards(manifest: DataFrame, folder: str, shard: int = SHARD, length: int = LENGTH, records_at_once: int = 1024) -> DataFrame:
    """The rows of sequences(), read from the shards of a manifest: each shard sequentially, a stretch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        stride = HEADER.itemsize + 2 * length
        for batch in batches:
            for number, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/shard-{number:08d}.bin") as f:
                    for at in range(0, n, records_at_once):
                        got = _parse(f.read(stride * min(records_at_once, n - at)), length)
                        record = np.arange(at, at + len(got))
                        doc = got["head"]["doc_id"]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(number * shard + record), pa.array(np.full(len(got), number)), pa.array(record.astype(np.int32)), pa.array(doc.copy(), pa.int64(), mask=doc == NO_ID), pa.array(got["head"]["seq"].copy(), pa.int32()),
                             pa.array(got["head"]["n_tokens"].copy(), pa.int32()), pa.array([x.tobytes() for x in got["tokens"]], pa.binary())],
                            ["slot", "shard", "record", "doc_id", "seq", "n_tokens", "tokens"],
                        )

    return manifest.select("shard", "n_records").repartition("shard").mapInArrow(run, RECORD)


def stored_sequences(docs: DataFrame, folder: str | None = None, shard: int = SHARD, length: int = LENGTH, **options) -> DataFrame:
    """Write docs' shards to a folder (a new one below the shared scratch folder by default) and read their rows back."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/lumenlake/token-shards-{uuid.uuid4().hex}"
    manifest = materialize(write_shards(docs, folder, shard, length, **options), "token-manifest")
    return read_shards(manifest, folder, shard, length)


def read_records(folder: str, start: int, count: int, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """The ids of records start .. start + count - 1 of shards written by write_shards(): a resumable sequential read."""
    store, base = _store(folder)
    out, stride = [], HEADER.itemsize + 2 * length
    while count > 0:
        name, at = divmod(start, shard)
        take = min(count, shard - at)
        with store.open_input_file(f"{base}/shard-{name:08d}.bin") as f:
            f.seek(at * stride)
            got = _parse(f.read(take * stride), length)
        out.append(got["tokens"])
        if len(got) < take:
            break
        start, count = start + take, count - take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")
