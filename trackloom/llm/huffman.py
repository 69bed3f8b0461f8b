"""Token ids in canonical length-limited Huffman code, in independent blocks.

Format: a codebook table (token, bits: the canonical code follows from the lengths), a table
of blocks in ascending document order, and a table of the ids before each of its parts. Parts
are ranges of document ids, each a file, and files in order of their names ascend. A block
holds whole documents:

    b"TLHF" | u32 version 1 | u32 interval | u32 documents | u64 ids
    | i64 document ids | u8 document id is null | u64 ids of each document
    | u64 bit offset of every ``interval``-th id | code bits, most significant first

Decoding reads each checkpointed run as a lane of its own: one table look-up a lane and
step, over all lanes of a block at once.

Nulls: null text is the empty text (its end id alone); a null document id sorts first and
is read back as null. Repeated rows are written once each. Empty input: no blocks, no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, materialise, project
from .tokens import encoder

MAGIC = b"TLHF"
_HEAD = struct.Struct("<4sIIIQ")


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(counts.size, np.uint8)
    if used.size < 2:
        out[used] = 1
        return out
    if used.size > 1 << most:
        raise ValueError(f"{used.size} symbols need more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(most):
        weight = np.concatenate([leaves, packages])
        is_leaf = np.arange(weight.size) < leaves.size
        by = np.argsort(weight, kind="stable")
        levels.append(is_leaf[by])
        weight = weight[by]
        even = weight.size // 2 * 2
        packages = weight[0:even:2] + weight[1:even:2]
    take = 2 * used.size - 2
    lengths = np.zeros(used.size, np.uint8)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, token), each one more than the last."""
    codes = np.zeros(lengths.size, np.uint32)
    order = np.lexsort((np.arange(lengths.size), lengths))
    order = order[lengths[order] > 0]
    if order.size:
        top = int(lengths.max())
        step = np.uint64(1) << (top - lengths[order]).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64)
        codes[order] = (at >> (top - lengths[order]).astype(np.uint64)).astype(np.uint32)
    return codes


@dataclass
class Codebook:
    lengths: np.ndarray

    def __post_init__(self):
        self.codes = canonical_codes(self.lengths)
        self.top = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((np.arange(self.lengths.size), self.lengths))
        order = order[self.lengths[order] > 0]
        span = (1 << (self.top - self.lengths[order].astype(np.int64))).astype(np.int64)
        table = np.repeat(order.astype(np.uint32), span)
        self.table = np.zeros(1 << self.top, np.uint32)
        self.table[: table.size] = table

    def encode(self, ids: np.ndarray, interval: int) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of every ``interval``-th id."""
        size = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(size)
        at = ends - size
        shift = (64 - (at & 31) - size).astype(np.uint64)
        value = self.codes[ids].astype(np.uint64) << shift
        word = at >> 5
        n_words = int((ends[-1] + 31) >> 5) + 1 if ids.size else 1
        out = np.zeros(n_words + 1, np.uint32)
        if ids.size:
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both = np.add.reduceat(value, first)
            w = word[first]
            out[w] |= (both >> np.uint64(32)).astype(np.uint32)
            out[w + 1] |= (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bits = int(ends[-1]) if ids.size else 0
        return out.astype(">u4").tobytes()[: (bits + 7) // 8], at[::interval].astype("<u8")

    def decode(self, bits: bytes, n: int, offsets: np.ndarray, interval: int) -> np.ndarray:
        raw = np.frombuffer(bits + b"\0" * 8, np.uint8)
        out = np.zeros((offsets.size, interval), np.uint32)
        at = offsets.astype(np.int64)
        limit = 8 * len(bits)
        for k in range(interval):
            np.minimum(at, limit, out=at)  # the last run may be short; its surplus is cut below
            p = at >> 3
            window = (raw[p].astype(np.uint32) << 24) | (raw[p + 1].astype(np.uint32) << 16) | (raw[p + 2].astype(np.uint32) << 8) | raw[p + 3]
            ids = self.table[(window << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.top)]
            out[:, k] = ids
            at += self.lengths[ids]
        return out.reshape(-1)[:n]


def write_block(book: Codebook, docs: list, sizes: list[int], flat: np.ndarray, interval: int) -> bytes:
    """A block of documents, their numbers of ids and all their ids."""
    bits, offsets = book.encode(flat, interval)
    return b"".join(
        [
            _HEAD.pack(MAGIC, 1, interval, len(docs), flat.size),
            np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is None for d in docs], "u1").tobytes(),
            np.array(sizes, "<u8").tobytes(),
            offsets.tobytes(),
            bits,
        ]
    )


def read_block(book: Codebook, block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Documents of a block, their numbers of ids and all their ids."""
    magic, version, interval, n_docs, n = _HEAD.unpack_from(block)
    if magic != MAGIC or version != 1:
        raise ValueError("not a token block")
    at = _HEAD.size
    docs = np.frombuffer(block, "<i8", n_docs, at)
    null = np.frombuffer(block, "u1", n_docs, at + 8 * n_docs)
    sizes = np.frombuffer(block, "<u8", n_docs, at := at + 9 * n_docs).astype(np.int64)
    runs = -(-n // interval)
    offsets = np.frombuffer(block, "<u8", runs, at := at + 8 * n_docs)
    flat = book.decode(block[at + 8 * runs :], n, offsets, interval)
    return [None if z else d for d, z in zip(docs.tolist(), null.tolist(), strict=True)], sizes, flat


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ``flat`` as rows of a binary column."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def write(docs: DataFrame, tokenizer: str, *, path: str | None = None, end_id: int = 2, most_bits: int = 16, block_ids: int = 1 << 18, interval: int = 256, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode all documents and write the three tables under ``path``; returns the path.

    Without ``path`` they lie in the work folder, which goes with the application. Texts are
    read once: each task writes its documents' ids and its counts of them. The ids, not the
    texts, are then dealt by ranges of document id, sorted and written in blocks, so that no
    block is read again to bring files in order. What reaches the driver is bounded by the
    vocabulary (counts) and by the number of files (ids in each).
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        size = max(enc.vocab_size, end_id + 1)
        narrow = "<u2" if size <= 1 << 16 else "<u4"
        found = np.zeros(size, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                raw = [x + end for x in enc.encode_many([t or "" for t in b.column(1).to_pylist()])]
                flat = np.frombuffer(b"".join(raw), "<u4")
                found += np.bincount(flat, minlength=size)
                n = np.array([len(x) // 4 for x in raw], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), _binary(flat.astype(narrow), n), pa.nulls(len(raw), pa.binary())], names=["doc_id", "n", "ids", "counts"])
        used = np.flatnonzero(found)
        counts = used.astype("<i8").tobytes() + found[used].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=["doc_id", "n", "ids", "counts"])

    source = project(docs, doc_id=id_col, text=text_col)
    tokens = materialise(source.mapInArrow(encode, "doc_id long, n long, ids binary, counts binary"), "token-ids")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                both = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.split(both, 2)], names=["token", "n"])

    counted = tokens.filter("counts is not null").select("counts").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = (counted.column(c).to_numpy() for c in ("token", "n"))
    counts = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    counts[token] = n
    lengths = code_lengths(counts, most_bits)
    shared = spark.sparkContext.broadcast(lengths)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part = Codebook(shared.value), TaskContext.get().partitionId()
        names, sizes, ids, at, size = [], [], [], 0, 0

        def rows():
            flat = np.frombuffer(b"".join(ids), f"<u{sum(map(len, ids)) // size}").astype(np.uint32)
            block = write_block(book, names, sizes, flat, interval)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([size], pa.int64()), pa.array([block], pa.binary())], names=["part", "at", "n_ids", "block"])

        for batch in batches:
            for doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if names and size + n > block_ids:
                    yield rows()
                    names, sizes, ids, at, size = [], [], [], at + size, 0
                names.append(doc)
                sizes.append(n)
                ids.append(raw)
                size += n
        if names:
            yield rows()

    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "token long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    dealt = tokens.filter("counts is null").select("doc_id", "n", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "n", "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(spark, tokens.trackloom_path)
    totals = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row a file
    first = np.concatenate([[0], np.cumsum([r["n"] for r in totals])])[:-1] if totals else []
    spark.createDataFrame([(r["part"], int(f)) for r, f in zip(totals, first, strict=True)], "part int, first long").coalesce(1).write.parquet(f"{path}/parts")
    return path


#: part: which file; at: ids before the block in its file.
BLOCKS = "part int, at long, n_ids long, block binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the blocks under ``path``: doc_id, start (ids before it), ids (uint32, little-endian)."""
    rows = spark.read.schema("token long, bits int").parquet(f"{path}/codebook").toArrow()  # at most the vocabulary
    token, bits = (rows.column(c).to_numpy() for c in ("token", "bits"))
    lengths = np.zeros(int(token.max(initial=0)) + 1, np.uint8)
    lengths[token] = bits
    parts = dict(spark.read.schema("part int, first long").parquet(f"{path}/parts").collect())  # one row a file
    shared = spark.sparkContext.broadcast((lengths, parts))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, parts = shared.value
        book = Codebook(lengths)
        for batch in batches:
            for part, at, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs, sizes, flat = read_block(book, block.as_buffer().to_pybytes())
                starts = parts[part] + at + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), _binary(flat.astype("<u4"), sizes)], names=["doc_id", "start", "ids"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("part", "at", "block").mapInArrow(decode, "doc_id long, start long, ids binary")
