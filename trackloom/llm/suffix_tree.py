"""Language-model scoring with a probabilistic suffix tree over symbols (bytes).

A text is read as its tokens: A-Z in lower case, words parted by ASCII blanks, joined by
single spaces, and one end symbol. The tree keeps contexts of up to ``depth`` symbols (at
most 7: a context and a symbol fill 64 bits). A context is a candidate if it occurs at
least ``least_count`` times in training, and is retained if its next-symbol distribution
diverges from that of its suffix by at least ``least_divergence`` nats; suffixes of
retained contexts are kept with them. So the tree grows with the corpus.
(``least_share`` asks for a share of the training symbols besides, 0 by default.)
Distributions are smoothed towards the suffix's, down to the uniform one, by the number of
kinds of symbols seen (Witten and Bell), ``DRAWN`` times as strongly: contexts that stand in
copied text look surer than they are.
Each symbol is scored in the state of the longest retained suffix of what stands before it.

Only contexts of up to ``TOP`` symbols, bounded by the alphabet, are collected whole. The
longer ones are judged in groups that share their nearest three symbols, on the executors,
and are written as a table; scoring holds them in shards of about ``shard`` entries by
their nearest symbols, each broadcast alone, and reads one after the other.

Beside that score each document gets a unigram base score, from counts of all training
tokens. Tokens meet their counts by chunks: a task names the distinct tokens of some
documents once, those rows are joined with the counts, and the counts come back to the
chunk. Every symbol and token of the training documents is counted.

Nulls: null text is the empty text (the end token alone); a null id counts as text ''.
Repeated rows are learned from and scored once each. Empty input gives no rows. With no
training rows the distributions are uniform. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, discard, materialise, project, release_shuffles

END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _stream(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of some texts, each after ``depth`` spaces, and the place of each text's first symbol."""
    pad = b" " * depth
    parts = [pad + b" ".join(w) + END for w in words]
    sizes = np.array([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes + depth


def _scored(first: np.ndarray, size: int, depth: int) -> np.ndarray:
    """Which places of a stream are symbols of a text, not the spaces before one."""
    live = np.ones(size, bool)
    for k in range(depth):
        live[first - 1 - k] = False
    return live


def _near(k: int) -> int:
    """The bits of a window that hold the nearest k symbols."""
    return (1 << 64) - (1 << 8 * (8 - k))


def windows(symbols: np.ndarray, live: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol with those before it as one number: the symbol in the low byte, the nearest before it in the high one, then the next."""
    code = symbols.astype(np.uint64)
    for k in range(1, depth + 1):
        code[k:] |= symbols[:-k].astype(np.uint64) << np.uint64(8 * (8 - k))
    return code[live]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if codes.size else np.zeros(0, int)
    return codes[first], np.add.reduceat(n, first) if codes.size else n


def _packed(code: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes and their counts: byte planes of the steps, compressed."""
    raw = np.concatenate([np.diff(code, prepend=np.uint64(0)).view(np.int64), n]).view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), codec="zstd", asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return np.cumsum(both[: both.size // 2].view(np.uint64), dtype=np.uint64), both[both.size // 2 :]


#: How strongly a distribution is drawn to its suffix's: as if so many symbols a kind seen had come from there.
DRAWN = 4
#: Contexts up to so many symbols are collected; the nearest two symbols name a shard.
TOP = 2


def count_windows(texts: DataFrame, depth: int, buckets: int, most: int = 4_000_000) -> DataFrame:
    """Windows of all symbols of ``texts`` (column text): code, n of those cut to ``TOP`` symbols, and packed whole ones in buckets by their nearest ``TOP`` + 1."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def out(part) -> Iterator[pa.RecordBatch]:
            code, n = _merged([(part[0] & np.uint64(_near(min(TOP, depth)) | 255), part[1])])
            none = [pa.nulls(code.size, t) for t in schema.types[:2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(code.view(np.int64)), pa.array(n)], schema=schema)
            if depth > TOP:
                at = (part[0] >> np.uint64(8 * (7 - TOP))) * np.uint64(0x9E3779B1) % np.uint64(1 << 32) * np.uint64(buckets) >> np.uint64(32)
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=np.uint64(buckets)))
                blobs = [_packed(part[0][x], part[1][x]) for x in np.split(order, first[1:])]
                none = [pa.nulls(len(blobs), t) for t in schema.types[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(at[order][first], pa.int32()), pa.array(blobs, pa.binary()), *none], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                words = [words_of(t) for t in batch.column(0).slice(a, 250).to_pylist()]
                symbols, first = _stream(words, depth)
                code = windows(symbols, _scored(first, symbols.size, depth), depth)
                for c in range(0, code.size, most):
                    kept.append(np.unique(code[c : c + most], return_counts=True))
                if sum(p[0].size for p in kept) > most:
                    kept = [_merged(kept)]
                    if kept[0][0].size > most // 2:
                        yield from out(kept.pop())
        if kept:
            yield from out(_merged(kept))

    return texts.mapInArrow(run, "bucket int, blob binary, code long, n long")


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of each context begin, and their numbers."""
    ctx = key >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if key.size else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, key.size))


def _judged(code: np.ndarray, n: np.ndarray, lengths: range, above: tuple[np.ndarray, np.ndarray], floor: float, least_divergence: float) -> tuple[list, tuple[np.ndarray, np.ndarray]]:
    """For each length the entries (key, count, retained by its own divergence), and the last length's keys and probabilities.

    An entry's key is a window cut to the context's symbols; above has the keys and
    probabilities of the length before the first.
    """
    out = []
    for k in lengths:
        key, m = _merged([(code & np.uint64(_near(k) | 255), n)])
        first, size = _groups(key)
        total = np.add.reduceat(m, first) if key.size else m
        often = np.repeat((total >= floor) | (k == 0), size)
        key, m = key[often], m[often]
        first, size = _groups(key)
        if not key.size:
            above, told = (key, np.zeros(0)), np.zeros(0, bool)
        else:
            below = above[1][np.searchsorted(above[0], key & np.uint64(_near(k - 1) | 255))] if k else np.full(key.size, 1 / 256)
            total, kinds = np.repeat(np.add.reduceat(m, first), size), np.repeat(DRAWN * (size + 1), size)
            gap = np.add.reduceat(m / total * np.log(m / total / below), first)
            told = np.repeat((gap >= least_divergence) | (k == 0), size)
            above = key, (m + kinds * below) / (total + kinds)
        out.append((key, m, told))
    return out, above


def _closed(levels: list, lengths: range, needed: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, keys, counts) of what is retained with its suffixes; needed: retained contexts one symbol longer than the last length."""
    out = []
    for k, (key, m, told) in reversed(list(zip(lengths, levels, strict=True))):
        ctx = key & np.uint64(_near(k))
        keep = told | np.isin(ctx, np.unique(needed & np.uint64(_near(k))))
        out.append((k, key[keep], m[keep]))
        needed = ctx[keep]
    return out[::-1]


class Levels:
    """Retained contexts by length with their next-symbol counts, as sorted arrays."""

    def __init__(self, k: np.ndarray, key: np.ndarray, n: np.ndarray, lengths: range):
        self.levels = []
        for length in lengths:
            pick = np.flatnonzero(k == length)
            pick = pick[np.argsort(key[pick])]
            self._add(length, key[pick], n[pick])

    def _add(self, length: int, keys: np.ndarray, m: np.ndarray) -> None:
        first, size = _groups(keys)
        self.levels.append((length, keys[first] & np.uint64(_near(length)), np.add.reduceat(m, first) if m.size else m, DRAWN * (size + 1), keys, m))

    def __getstate__(self) -> list[tuple[int, bytes]]:
        return [(x[0], _packed(*x[4:])) for x in self.levels]

    def __setstate__(self, packed: list[tuple[int, bytes]]) -> None:
        self.levels = []
        for length, blob in packed:
            self._add(length, *_unpacked(blob))

    def follow(self, q: np.ndarray, p: np.ndarray, alive: np.ndarray) -> None:
        """Take the probabilities ``p`` of sorted windows ``q`` to the longest contexts here; ``alive``: whose context so far is retained."""
        for length, contexts, total, kinds, keys, m in self.levels:
            at = np.flatnonzero(alive)
            if not contexts.size or not at.size:
                alive[:] = False
                return
            ctx = q[at] & np.uint64(_near(length))
            i = np.minimum(np.searchsorted(contexts, ctx), contexts.size - 1)
            hit = contexts[i] == ctx
            alive[at[~hit]] = False
            at, i = at[hit], i[hit]
            entry = ctx[hit] | (q[at] & np.uint64(255))
            j = np.minimum(np.searchsorted(keys, entry), keys.size - 1)
            p[at] = (np.where(keys[j] == entry, m[j], 0) + kinds[i] * p[at]) / (total[i] + kinds[i])


class Tree:
    """The short contexts, and broadcast shards of the longer ones by ranges of their nearest two symbols."""

    def __init__(self, top: Levels, shards: list[tuple[int, int, Broadcast]], states: int, keep: int = 4):
        self.top, self.shards, self.states, self.keep = top, shards, states, keep

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each window's symbol. Beyond ``keep`` shards none stays in memory."""
        q, at = np.unique(code, return_inverse=True)
        p, alive = np.full(q.size, 1 / 256), np.ones(q.size, bool)
        self.top.follow(q, p, alive)
        lead = q >> np.uint64(8 * (8 - TOP))
        for low, high, shard in self.shards:
            a, b = np.searchsorted(lead, np.uint64(low)), np.searchsorted(lead, np.uint64(high), "right")
            if alive[a:b].any():
                levels = shard.value if len(self.shards) <= self.keep else shard.load_from_path(shard._path)
                levels.follow(q[a:b], p[a:b], alive[a:b])
        return np.log10(p)[at]


def grow(texts: DataFrame, *, depth: int = 5, least_share: float = 0.0, least_count: int = 4, least_divergence: float = 0.005, shard: int = 2_000_000, most: int = 1_000_000) -> Tree:
    """The tree of the training ``texts`` (column text)."""
    if not 0 <= depth <= 7:
        raise ValueError("depth must be 0 to 7")
    spark = texts.sparkSession
    buckets = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    full = materialise(count_windows(texts, depth, buckets), "windows", "uncompressed")
    short, long = range(min(TOP, depth) + 1), range(TOP + 1, depth + 1)
    few = full.filter("code is not null").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # bounded by the alphabet
    column = lambda t, c, kind=np.int64: t.column(c).to_numpy().astype(np.int64, copy=False).view(kind)
    floor = max(float(least_count), least_share * int(column(few, "n").sum()))
    levels, above = _judged(column(few, "code", np.uint64), column(few, "n"), short, (np.zeros(0, np.uint64), np.zeros(0)), floor, least_divergence)
    told = spark.sparkContext.broadcast(above)

    def judge(group: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for blob in group.column("blob"):
            parts.append(_unpacked(blob.as_py()))
            if sum(p[0].size for p in parts) > 2 * max(most, parts[0][0].size):
                parts = [_merged(parts)]
        found, _ = _judged(*_merged(parts), long, told.value, floor, least_divergence)
        kept = _closed(found, long, np.zeros(0, np.uint64))
        key, n = (np.concatenate([x[i] for x in kept]) for i in (1, 2))
        k = np.repeat([x[0] for x in kept], [x[1].size for x in kept])
        return pa.table({"k": pa.array(k, pa.int32()), "lead": pa.array(key >> np.uint64(8 * (8 - TOP)), pa.int32()), "key": pa.array(key.view(np.int64)), "n": pa.array(n)})

    shards, needed, states = [], np.zeros(0, np.uint64), 0
    if long:
        found = full.filter("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(judge, "k int, lead int, key long, n long")
        table = materialise(found, "states")
        leads = table.groupBy("lead").agg(F.count("*").alias("n"), F.count_distinct("k", F.shiftrightunsigned("key", 8)).alias("states")).orderBy("lead").collect()  # at most 2^16
        needed, states = np.array([r["lead"] for r in leads], np.uint64) << np.uint64(8 * (8 - TOP)), sum(r["states"] for r in leads)
        ranges: list[list[int]] = []
        for r in leads:
            if ranges and ranges[-1][2] + r["n"] <= shard:
                ranges[-1][1:] = r["lead"], ranges[-1][2] + r["n"]
            else:
                ranges.append([r["lead"], r["lead"], r["n"]])
        for low, high, _ in ranges:
            part = table.filter(F.col("lead").between(low, high)).select("k", "key", "n").toArrow()
            shards.append((low, high, spark.sparkContext.broadcast(Levels(column(part, "k"), column(part, "key", np.uint64), column(part, "n"), long))))
    discard(spark, full.trackloom_path)
    release_shuffles(spark)
    kept = _closed(levels, short, needed)
    top = Levels(np.repeat([x[0] for x in kept], [x[1].size for x in kept]), *(np.concatenate([x[i] for x in kept]) for i in (1, 2)), short)
    return Tree(top, shards, states + sum(x[1].size for x in top.levels))


def score(docs: DataFrame, train: Column, *, depth: int = 5, least_share: float = 0.0, least_divergence: float = 0.005, chunk_docs: int = 2000, most_symbols: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``train`` says from ``doc_id`` whether a row is learned from. About ``most_symbols``
    are scored together.
    """
    spark: SparkSession = docs.sparkSession
    rows = project(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    tree = grow(rows.filter("train").select("text"), depth=depth, least_share=least_share, least_divergence=least_divergence)
    kinds = pa.schema([("chunk", pa.int64()), ("at", pa.int32()), ("token", pa.binary()), ("n", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("score", pa.list_(pa.float64())), ("size", pa.binary()), ("place", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk a row for each distinct token, and a row with its documents as places in that list."""
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, chunk_docs):
                b = batch.slice(a, chunk_docs)
                words = [words_of(t) for t in b.column(1).to_pylist()]
                learned = b.column(2).to_pylist()
                scores = []
                heap = np.cumsum([sum(map(len, w)) + len(w) + depth for w in words]) // most_symbols
                for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(heap)) + 1):
                    symbols, first = _stream(words[part[0] : part[-1] + 1], depth)
                    sizes = np.append(first[1:] - depth, symbols.size) - first
                    logs = tree.logs(windows(symbols, _scored(first, symbols.size, depth), depth))
                    scores += np.add.reduceat(logs, np.cumsum(sizes) - sizes).tolist()
                names: dict[bytes, int] = {}
                places, sizes = [], []
                for w in words:
                    w.append(b"")  # the end: no word is empty
                    places.append(np.fromiter((names.setdefault(t, len(names)) for t in w), np.uint32, len(w)))
                    sizes.append(len(w))
                n = np.zeros(len(names), np.int64)
                for p, t in zip(places, learned, strict=True):
                    if t:
                        np.add.at(n, p, 1)
                k = len(names)
                empty = {x.name: pa.nulls(k, x.type) for x in kinds}
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * k, pa.int64()), pa.array(np.arange(k, dtype=np.int32)), pa.array(list(names), pa.binary()), pa.array(n), *(empty[x] for x in kinds.names[4:])], schema=kinds)
                one = [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([b.column(0).to_pylist()], kinds.field("doc_id").type), pa.array([learned], kinds.field("train").type), pa.array([scores], kinds.field("score").type), pa.array([np.array(sizes, "<u4").tobytes()], pa.binary()), pa.array([np.concatenate(places).astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, schema=kinds)
                chunk += 1

    schema = "chunk long, at int, token binary, n long, doc_id array<long>, train array<boolean>, score array<double>, size binary, place binary"
    chunks = materialise(rows.mapInArrow(read, schema), "chunks")
    named = chunks.filter("at is not null").select("chunk", "at", "token", "n")
    counts = materialise(named.filter("n > 0").groupBy("token").agg(F.sum("n").alias("c")), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocab = int(whole[0]), int(whole[1])
    back = named.select("chunk", "at", "token").join(counts, "token", "left").select("chunk", "at", F.coalesce("c", F.lit(0)).alias("c"))
    again = spark.read.schema(schema).parquet(chunks.trackloom_path)
    texts = again.filter("at is null").select("chunk", "doc_id", "train", "score", "size", "place")

    def base(key, docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out = []
        c = np.zeros(len(counts), np.int64)
        c[counts["at"].to_numpy()] = counts["c"].to_numpy()
        logs = np.log10((c + 1) / (total + (vocab + 1)))
        for d in docs.itertuples(index=False):
            size = np.frombuffer(d.size_, "<u4").astype(np.int64)
            place = np.frombuffer(d.place, "<u4")
            first = np.cumsum(size) - size
            out.append(pd.DataFrame({"doc_id": pd.array(d.doc_id, "Int64"), "train": d.train, "n_tokens": size, "n_known": np.add.reduceat((c[place] > 0).astype(np.int64), first), "train_tokens": total, "base_score": np.add.reduceat(logs[place], first), "score": d.score}))
        return pd.concat(out) if out else pd.DataFrame({x: [] for x in ("doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    texts = texts.withColumnRenamed("size", "size_")
    return texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(base, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(parts: int = 7, part: int = 2) -> Column:
    return crc_of_id("doc_id") % parts == part
