"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are eight positional bytes. Two that differ in at most d bits
differ in at most d bytes, so they share at least 8 - d (position, byte) postings: the
guaranteed minimum. The posting list of one byte holds 1/256 of all fingerprints, so the
index is cut into blocks first: the positions are parted into d + 2 groups, of which at
least two are shared whole, and a block is a choice of two groups with their bytes. In a
block the shared bytes of the other positions are tallied by pair, pairs that reach the
minimum are retained and verified by Hamming distance. A member that already belongs to a
class is not compared again, so a block gives links that span its classes, not pairs. Blocks
of more than ``MOST`` members are cut by further positions up to the minimum: exact, and a
list then differs in d bytes only, so it has at most 256^d members (65,536 for d = 2) however
often texts repeat, since copies share one fingerprint; there each member's neighbours are
looked up instead.

Classes are joined across lists by alternating large-star and small-star steps (Kiveris
et al. 2014) over links of distinct fingerprints, in written tables.

``representatives`` works at a similarity of five-word shingles, not at a few bits. At 0.8
some 15 % of the bits differ, and nothing is guaranteed for eight bytes, so it widens the
fingerprint to 32 positional bytes and the index to lists of half bytes: five of the 64 half
bytes name a list, in ``tables`` choices. Pairs that meet tally their shared bytes, at least
``least_shared`` of 32, and are verified by Hamming distance; see ``Wide``. Lists are reduced
to one member a class in each task before they are shuffled, and again while they are read
in order, so a list of any length is worked through in bounded memory.

Nulls: null text has no words and the fingerprint zero, linked like any other; null ids
keep their rows and never name a class (a class of null ids only has a null id). Repeated
rows are kept and belong to one class. Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialise, project

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _majority(raw: np.ndarray) -> np.ndarray:
    """Bytes whose bits are set where over half of the rows (n, bytes) have them."""
    n, width = raw.shape
    if n < 256:
        ones = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:  # by the counts of byte values at each position, a part at a time
        counts = np.zeros(width << 8, np.int64)
        for a in range(0, n, 1 << 16):
            counts += np.bincount((raw[a : a + (1 << 16)].astype(np.int32) + (np.arange(width, dtype=np.int32) << 8)).ravel(), minlength=width << 8)
        ones = (counts.reshape(width, 256) @ _BITS).ravel()
    return np.packbits(2 * ones > n)


def fingerprints_of(texts: list[str], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks part words
        if words:
            joined = map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
            hashes = np.array([digest(s, seed) for s in joined], ">u8")
            out[k] = _majority(hashes.view(np.uint8).reshape(-1, 8)).view(">u8")[0]
    return out


def _portions(batch: pa.RecordBatch, most_chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts (column 1) hold about ``most_chars`` bytes."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    cuts = np.flatnonzero(np.diff(size // most_chars)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _portions(batch):
                fp = fingerprints_of([t or "" for t in b.column(1).to_pylist()], shingle, seed)
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return project(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, fp long")


#: Members of a block whose postings are tallied; more are cut by further positions.
MOST = 4096


def _spread(n: int, near) -> np.ndarray:
    """The least member of each member's class; ``near(members, one)`` says which of ``members`` link to ``one``.

    From each class's least member outwards, against those not reached yet: memory for n, not for pairs.
    """
    label, left = np.arange(n), np.arange(n)
    while left.size:
        head, left = left[0], left[1:]
        todo = [head]
        while todo and left.size:
            hit = near(left, todo.pop())
            label[left[hit]] = head
            todo += left[hit].tolist()
            left = left[~hit]
    return label


def tallied(table: np.ndarray, least: int, most: int):
    """Which fingerprints of ``table`` (n, bytes) link to one: those that share at least ``least`` positional bytes and differ in at most ``most`` bits."""
    words = table.view(np.uint64).reshape(len(table), -1)
    postings = np.ascontiguousarray(table.T)  # by position: the byte of each member

    def near(members: np.ndarray, one: int) -> np.ndarray:
        count = np.zeros(members.size, np.uint8)
        for byte in postings:
            count += byte[members] == byte[one]
        enough = np.flatnonzero(count >= least)
        hit = np.zeros(members.size, bool)
        hit[enough[np.bitwise_count(words[members[enough]] ^ words[one]).sum(axis=1) <= most]] = True
        return hit

    return near


def spanning_links(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (member, its class's least member) among one list's distinct fingerprints."""
    members = np.sort(members.view(np.uint64))
    n = members.size
    if n <= MOST:
        label = _spread(n, tallied(members.view(np.uint8).reshape(-1, 8), 8 - bits, bits))
    else:  # the members differ in few places: look up every neighbour
        varying = np.bitwise_or.reduce(members ^ members[0])
        places = [b for b in range(64) if int(varying) >> b & 1]
        label = np.arange(n)
        pairs = []
        for k in range(1, bits + 1):
            for choice in itertools.combinations(places, k):
                flipped = members ^ np.uint64(sum(1 << b for b in choice))
                at = np.minimum(np.searchsorted(members, flipped), n - 1)
                near = np.flatnonzero((members[at] == flipped) & (at > np.arange(n)))
                pairs += [(near, at[near])]
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        while a.size:  # least label over links, with jumps
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(n))
    signed = members.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[label[moved]].tolist(), strict=True))


def _mask(positions) -> int:
    """The bytes at some positions, as a signed long."""
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def links(distinct: DataFrame, bits: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) that join every two distinct fingerprints ``fp`` at ``bits`` (at most 3) differing bits or fewer, directly or through others."""
    if not 0 <= bits <= 3:
        raise ValueError("lists are bounded for at most 3 bits")
    groups = [g.tolist() for g in np.array_split(np.arange(8), bits + 2)]
    choices = [sorted(a + b) for a, b in itertools.combinations(groups, 2)]
    finer = [[sorted(c + list(more)) for more in itertools.combinations([p for p in range(8) if p not in c], max(0, 8 - bits - len(c)))] for c in choices]
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = lambda masks: F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for k, m in enumerate(masks)])
    blocks = distinct.select("fp").repartition(spread).select("fp", F.explode(one([_mask(c) for c in choices])).alias("b")).select("fp", "b.k", "b.bytes")
    sizes = blocks.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1")
    met = blocks.join(sizes, ["k", "bytes"])
    small = met.filter(F.col("n") <= most).select("fp", F.lit(-1).alias("cut"), "k", "bytes")
    cuts = F.array(*[one([_mask(f) for f in fs]) for fs in finer])
    large = met.filter(F.col("n") > most).select("fp", F.col("k").alias("cut"), F.explode(F.element_at(cuts, F.col("k") + 1)).alias("b")).select("fp", "cut", F.col("b.k").alias("k"), F.col("b.bytes").alias("bytes"))
    lists = small.union(large).groupBy("cut", "k", "bytes").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for fps in batch.column(0):
                found.update(spanning_links(fps.values.to_numpy(zero_copy_only=False), bits))
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _rooted(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """of (a distinct fingerprint), root (of its class), and the other columns of ``distinct``, written."""
    roots = components(linked)
    return materialise(distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("root"), *[c for c in distinct.columns if c != "fp"]), "roots")


def near_duplicates(docs: DataFrame, *, bits: int = 2, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the class), one row a document."""
    fps = materialise(fingerprints(docs, shingle=shingle, seed=seed, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    rooted = _rooted(distinct, links(distinct, bits))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("of", "component_id")
    return fps.join(classes, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


class _Words(dict):
    """Hashes of words; those met are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        at = self[word] = xxhash.xxh64_intdigest(word, 42)
        return at


_WORDS = _Words()


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Distinct hashes of the shingles of a text (fewer words: of the whole sequence), sorted."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
    out = np.full(max(1, n - shingle + 1), min(n, shingle), np.uint64)
    for k in range(min(n, shingle)):
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[k : k + out.size]
    return np.unique(out)


@dataclass(frozen=True)
class Wide:
    """Fingerprints of 256 bits and how they are searched.

    Two sets of shingles of similarity s (Jaccard) differ in a bit with chance
    arccos(2s / (1 + s)) / pi: 0.15 at 0.8, so in 39 of 256 bits (standard deviation 6) and
    share 8.6 of 32 bytes; unrelated ones differ in 128 and share 0.1. ``most_bits`` lets
    nearly all pairs of 0.8 pass, and some of 0.7. A list of five half bytes is shared with
    chance 0.037, so ``tables`` = 84 miss about one pair of 0.8 in twenty.
    """

    shingle: int = 5
    tables: int = 84
    halves: int = 5
    least_shared: int = 3
    most_bits: int = 48
    seed: int = 9

    def of(self, texts: list[str]) -> np.ndarray:
        """Fingerprints (texts, 32) as bytes; zero without words."""
        out = np.zeros((len(texts), 32), np.uint8)
        for k, text in enumerate(texts):
            h = shingle_set(text, self.shingle)
            if h.size:
                z = h[:, None] + np.arange(1, 5, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                out[k] = _majority((z ^ z >> np.uint64(31)).view(np.uint8).reshape(-1, 32))
        return out

    def keys(self, table: np.ndarray) -> np.ndarray:
        """The lists (tables, fingerprints) of each fingerprint of ``table`` (n, 32): the choice and its half bytes as one number."""
        half = np.stack([table >> 4, table & 15], axis=2).reshape(len(table), 64).T.astype(np.int64)
        rng, out = np.random.default_rng(self.seed), np.zeros((self.tables, len(table)), np.int64)
        deck = np.concatenate([rng.permutation(64)[: 64 // self.halves * self.halves] for _ in range(-(-self.tables * self.halves // (64 // self.halves * self.halves)))])
        for t, at in enumerate(deck[: self.tables * self.halves].reshape(self.tables, self.halves)):
            out[t] = t
            for p in at:
                out[t] = out[t] << 4 | half[p]
        return out

    def heads(self, table: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For each fingerprint of ``table`` (n, 32), in order of its list ``key``, the first one of its class in that list."""
        n = len(key)
        label = np.arange(n)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        words = np.ascontiguousarray(table).view(np.uint64)
        two = first[size == 2]
        met = ((table[two] == table[two + 1]).sum(axis=1) >= self.least_shared) & (np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1) <= self.most_bits)
        label[two[met] + 1] = two[met]
        for a, m in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            label[a : a + m] = a + _spread(m, tallied(np.ascontiguousarray(table[a : a + m]), self.least_shared, self.most_bits))
        return label


_LISTED = pa.schema([("key", pa.int64()), ("fp", pa.binary(32)), ("head", pa.binary(32))])


def _column(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, 32)


def _fixed(table: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(table), [None, pa.py_buffer(np.ascontiguousarray(table).tobytes())]).cast(pa.binary())


def wide_links(distinct: DataFrame, wide: Wide = Wide(), most: int = MOST, held: int = 1 << 15) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` (binary) that meet in a list and pass tally and verification."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of ``held`` fingerprints at a time: one member a class goes on, the others link to it."""

        def out(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            for key in wide.keys(table):
                order = np.argsort(key, kind="stable")
                rows, k = table[order], key[order]
                label = wide.heads(rows, k)
                on = label == np.arange(len(k))
                yield pa.RecordBatch.from_arrays([pa.array(k[on]), _fixed(rows[on]), pa.nulls(int(on.sum()), pa.binary())], names=_LISTED.names)
                if not on.all():  # links pass through the shuffle beside the lists, spread by their bits
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - (rows[~on].view(np.int64)[:, 0] & 0xFFFFFF)), _fixed(rows[~on]), _fixed(rows[label[~on]])], names=_LISTED.names)

        parts, n = [], 0
        for batch in batches:
            parts.append(_column(batch.column(0)))
            n += batch.num_rows
            if n >= held:
                yield from out(np.concatenate(parts))
                parts, n = [], 0
        if n:
            yield from out(np.concatenate(parts))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their lists; a list that goes on is carried by one member a class."""
        key, table = np.zeros(0, np.int64), np.zeros((0, 32), np.uint8)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal key, table
            if not key.size:
                return
            label = wide.heads(table, key)
            on = label == np.arange(key.size)
            if not on.all():
                yield pa.RecordBatch.from_arrays([_fixed(table[~on]), _fixed(table[label[~on]])], names=["a", "b"])
            open_ = on & (key == key[-1]) & (not last)
            key, table = key[open_], table[open_]

        for batch in batches:
            linked = pc.is_valid(batch.column(2))
            passed = batch.filter(linked)
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column(1), passed.column(2)], names=["a", "b"])
            rest = batch.filter(pc.invert(linked))
            for a in range(0, rest.num_rows, most):
                b = rest.slice(a, most)
                key, table = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([table, _column(b.column(1))])
                yield from out(False)
        yield from out(True)

    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").repartition(spread).mapInArrow(deal, "key long, fp binary, head binary")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a binary, b binary")


def forest(linked: DataFrame, held: int = 500_000) -> DataFrame:
    """Fewer links (a, b) with the same components: a member met in many lists keeps one link a task.

    ``held`` links are joined at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        def out() -> pa.RecordBatch:
            rows = [(x, r) for x in list(up) if (r := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = sorted((find(a), find(b)))
                up[b] = a
            if len(up) > held:
                yield out()
                up.clear()
        yield out()

    return linked.repartition("a").mapInArrow(run, "a binary, b binary")


def representatives(docs: DataFrame, *, wide: Wide = Wide(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class of near copies the one with the least id (null ids last), once."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a row is known by its id and two hashes of all its columns
    known = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *columns).alias("h2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _portions(batch):
                fp = _fixed(wide.of([t or "" for t in b.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column(0), fp, b.column(2), b.column(3)], names=["doc_id", "fp", "h1", "h2"])

    texts = docs.select(known[0], F.col(f"`{text_col}`").cast("string").alias("text"), *known[1:])
    fps = materialise(texts.mapInArrow(run, "doc_id long, fp binary, h1 long, h2 long"), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h1", "h2")).alias("first")), "distinct")
    rooted = _rooted(distinct, forest(wide_links(distinct, wide)))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{c}").alias(f"_k{i}") for i, c in enumerate(("doc_id", "h1", "h2"))])
    keyed = docs.select(F.struct(*columns).alias("row"), *[c.alias(f"_r{i}") for i, c in enumerate(known)])
    same = keyed.join(kept, F.col("_r0").eqNullSafe(F.col("_k0")) & (F.col("_r1") == F.col("_k1")) & (F.col("_r2") == F.col("_k2")), "left_semi")
    return same.dropDuplicates(["_r0", "_r1", "_r2"]).select("row.*")
