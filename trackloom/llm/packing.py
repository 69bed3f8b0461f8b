"""Sum-of-squares packing of documents into fixed windows of token ids.

A level array counts the partly filled windows at each fill. A document's full windows
leave at once; what remains is put at the fill where the sum of squared counts after the
move is smallest (Csirik et al.). Windows that are still partly filled when a partition
ends are not closed there: their pieces are placed once more by the same rule, longest
first, together with those of other partitions in tasks of about ``pooled`` ids, and what is
then still open again, until a round closes less than a tenth of it. Only those last pieces
of such a task are cut: full windows, and a tail cut at powers of two, which need no padding.
Pieces are written once between the two passes; no document is shuffled, only open pieces.

A task holds the ids of its open windows: at most those of its split, or ``pooled``.

Nulls: null text is the empty text (its end id alone); null ids are carried. Repeated
rows are packed once each. Empty input gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, project
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packer; ``emit`` gets (window id, [(document, start, ids, document's ids)])."""

    def __init__(self, window: int = 2048, first_id: int = 0):
        self.window, self.next_id = window, first_id
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.ready: list[tuple[int, list]] = []

    def _close(self, pieces: list) -> None:
        self.ready.append((self.next_id, pieces))
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        full = ids.size // self.window * self.window
        for a in range(0, full, self.window):
            self._close([(doc, a, ids[a : a + self.window], ids.size)])
        if full < ids.size:
            self._place((doc, full, ids[full:].copy(), ids.size))

    def level_for(self, size: int) -> int:
        """Fill (0: a new window) whose choice leaves the least sum of squared counts; ties: the fullest."""
        n, w = self.levels, self.window
        top = w - size
        cost = 2 * (n[size : w + 1] - n[: top + 1]) + 2  # from fill h to h + size
        cost[top] = 1 - 2 * n[top]  # filled up: it leaves the array
        cost[0] = 2 * n[size] + 1 if size < w else 0
        here = n[: top + 1] > 0
        here[0] = True
        cost[~here] = np.iinfo(np.int64).max
        return int(top - np.argmin(cost[::-1]))

    def _place(self, piece) -> None:
        size = piece[2].size
        h = self.level_for(size)
        pieces = [] if h == 0 else self.open[h].pop()
        if h:
            self.levels[h] -= 1
        pieces.append(piece)
        if h + size == self.window:
            self._close(pieces)
        else:
            self.levels[h + size] += 1
            self.open.setdefault(h + size, []).append(pieces)

    def left(self) -> list[tuple]:
        """The pieces of all open windows, which are given up."""
        pieces = [p for h in sorted(self.open, reverse=True) for w in self.open[h] for p in w]
        self.open, self.levels[:] = {}, 0
        return pieces

    def again(self) -> None:
        """Place the pieces of the open windows once more, longest first, while that closes a tenth of them."""
        size = lambda: sum(h * len(w) for h, w in self.open.items())
        while before := size():
            for piece in sorted(self.left(), key=lambda p: -p[2].size):
                self._place(piece)
            if size() > 0.9 * before:
                break

    def drain(self) -> None:
        """Cut the open windows' pieces into full windows and the tail at powers of two."""
        pieces = self.left()
        left = sum(p[2].size for p in pieces)
        room, now = 0, []
        for doc, start, ids, total in pieces:
            while ids.size:
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                take = min(room, ids.size)
                now.append((doc, start, ids[:take], total))
                ids, start, room, left = ids[take:], start + take, room - take, left - take
                if not room:
                    self._close(now)
                    now = []

    def take(self) -> list[tuple[int, list]]:
        done, self.ready = self.ready, []
        return done


_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def _rows(done: list[tuple[int | None, list]]) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(7)]
    for seq, pieces in done:
        at = 0
        for doc, start, ids, total in pieces:
            for c, v in zip(cols, (doc, start, ids.size, ids.tobytes(), total, seq, at if seq is not None else None), strict=True):
                c.append(v)
            at += ids.size
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)


def pack(docs: DataFrame, tokenizer: str, *, window: int = 2048, end_id: int = 1, pooled: int = 1 << 23, keep_memo: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in their windows: one row a piece, ``ids`` as little-endian uint32.

    ``pooled`` ids of open windows meet in a task of the second pass, about. ``keep_memo``
    leaves a worker's remembered pieces to its next task; without it their memory is free for
    other work after each task.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, raw in zip(part.column(0).to_pylist(), enc.encode_many(texts), strict=True):
                    packer.add(doc, np.frombuffer(raw + end, "<u4"))
                yield _rows(packer.take())
        yield _rows([(None, packer.left())])
        if not keep_memo:
            enc.memo.clear()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SumOfSquares(window, 1 << 60 | TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, start, raw, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
                packer._place((doc, start, np.frombuffer(raw, "<u4"), total))
            yield _rows(packer.take())
        packer.again()
        packer.drain()
        yield _rows(packer.take())

    placed = materialise(project(docs, doc_id=id_col, text=text_col).mapInArrow(first, SCHEMA), "pieces")
    open_ = placed.filter("sequence_id is null")
    tasks = max(1, -(-(open_.agg(F.sum("length")).first()[0] or 0) // pooled))
    longest = open_.repartition(tasks).sortWithinPartitions(F.col("length").desc(), "doc_id", "start")
    return placed.filter("sequence_id is not null").unionByName(longest.mapInArrow(second, SCHEMA))
