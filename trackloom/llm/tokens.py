"""Tokenising whole texts with a public tokenizer file, by pieces that are remembered.

Both public tokenizers cut a text before a space that follows a non-blank and precedes
a non-blank, whatever stands around, so a text's ids are the ids of its pieces. A worker
keeps the ids of short pieces it has met; the tokenizer itself sees only new ones.
"""

from __future__ import annotations

import functools
import gc
import itertools
import os
import re

import numpy as np

#: Pieces that a worker remembers, the longest piece worth remembering, and places of the table that says which have been met before. None changes results.
MEMO_PIECES, MEMO_CHARS, MET = 1_000_000, 64, 1 << 24
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class PieceEncoder:
    """Texts to little-endian unsigned 32-bit ids (as bytes), equal to encoding whole texts.

    ``drops_space``: the tokenizer drops white space (word ends mark words); otherwise a
    piece after the first carries the space before it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: Added tokens stand for themselves wherever their strings occur; texts that hold one are encoded whole.
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        probe = self.tok.encode_batch_fast(["a b", "a", "b", " b", " \x01 "], add_special_tokens=False)
        ids = [e.ids for e in probe]
        self.drops_space = ids[2] == ids[3] and ids[0] == ids[1] + ids[2]
        self.mark = ids[4][0] if self.drops_space and len(ids[4]) == 1 else None
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.starts_space = np.zeros(size, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.starts_space[i] = token.startswith("Ġ")
        self.vocab_size = size
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.met, self.n_met = np.zeros(MET, bool), 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode_new(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of pieces without blanks at their ends, many to a call; cut apart by the ids that start one."""
        out: dict[str, bytes] = {}
        odd: list[str] = []
        if self.drops_space:
            odd = [p for p in pieces if "\x01" in p or self.mark is None]
            pieces = [p for p in pieces if "\x01" not in p and self.mark is not None]
        else:
            odd = [p for p in pieces if " " in p]
            pieces = [p for p in pieces if " " not in p]
        groups = [pieces[i : i + 500] for i in range(0, len(pieces), 500)]
        joined = [" \x01 ".join(g) if self.drops_space else "".join([lead + p for p in g]) for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False) if groups else [], strict=True):
            ids = np.asarray(e.ids, "<u4")
            if self.drops_space:
                at = np.flatnonzero(ids == self.mark)
                first, last = np.concatenate([[0], at + 1]), np.concatenate([at, [ids.size]])
            else:
                first = np.flatnonzero(self.starts_space[ids])
                last = np.concatenate([first[1:], [ids.size]])
            if first.size != len(g):
                odd += g
                continue
            raw = ids.tobytes()
            out.update(zip(g, [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], strict=True))
        out.update(zip(odd, self._direct([lead + p for p in odd]), strict=True))
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces that neither begin nor end with a blank.

        A run of letters and the full stops or commas after it are always cut apart, so
        such a piece needs only its letters encoded, which other pieces share.
        """
        cores, whole = {}, []
        for p in pieces:
            core = p.rstrip(".,")
            if len(core) < len(p) and core.isalpha():
                cores[p] = core
            else:
                whole.append(p)
        need = set(whole)
        need.update(c for c in cores.values() if c not in self.memo)
        done = self._encode_new(list(need), "" if self.drops_space else " ")
        for p, core in cores.items():
            ids = done.get(core) or self.memo[core]
            tail = p[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._direct([tail])[0]
            done[p] = ids + self.tails[tail]
        return done

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Nothing here refers to itself, so cycles are not looked for meanwhile."""
        was = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        open_: list[tuple[int, list[bytes | None], list[int], list[str]]] = []  # text, ids, places and pieces still wanted
        new: set[str] = set()
        odd: list[int] = []
        get, total = self.memo.get, 0
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        for i, ids in zip(marked, self._direct([texts[i] for i in marked]), strict=True):
            out[i] = ids
        for i, text in enumerate(texts):
            if out[i] is not None:
                continue
            parts = text.split(" ")
            total += len(parts)
            ids = list(map(get, parts))
            if not self.drops_space:
                ids[0] = b""  # the piece with no space before it is encoded with its like below
            if None in ids:
                holes, k = [], -1
                for _ in range(ids.count(None)):
                    holes.append(k := ids.index(None, k + 1))
                missing = [parts[k] for k in holes]
                new.update(missing)
                open_.append((i, ids, holes, missing))
            else:
                out[i] = b"".join(ids)
        bad = {p for p in new if not p or len(p) > MEMO_CHARS or p[0].isspace() or p[-1].isspace()}
        if bad:
            odd = [x[0] for x in open_ if not bad.isdisjoint(x[3])]
            left = set(odd)
            open_ = [x for x in open_ if x[0] not in left]
            new = set().union(*(x[3] for x in open_))
        for i in odd:
            # empty pieces, long ones, or blanks at an end: cut only where that is safe
            parts = texts[i].split(" ") if self.drops_space else _SAFE_CUT.split(texts[i])
            ids = list(map(get, parts)) if self.drops_space or len(parts) > 1 else [None]
            late = [k for k, v in enumerate(ids) if v is None or k == 0]
            for k, v in zip(late, self._direct([parts[k] if k == 0 or self.drops_space else " " + parts[k] for k in late]), strict=True):
                ids[k] = v
            out[i] = b"".join(ids)
        done = self._learn(new)
        for i, ids, holes, missing in open_:
            for k, p in zip(holes, missing, strict=True):
                ids[k] = done[p]
            out[i] = b"".join(ids)
        if not self.drops_space:
            plain = sorted(set(range(len(texts))).difference(odd, marked))
            for i, head in zip(plain, self._direct([texts[i].partition(" ")[0] for i in plain]), strict=True):
                out[i] = head + out[i]
        if len(done) > 0.5 * max(1, total) and len(self.memo) >= MEMO_PIECES:
            self.memo.clear()  # other kinds of text than before
        self._remember(done)
        return out

    def _remember(self, done: dict[str, bytes]) -> None:
        """Keep the pieces met for the second time: most are met once only."""
        at = np.fromiter(map(hash, done), np.int64, len(done)) & (MET - 1)
        again = self.met[at]
        if self.n_met > MET // 4:
            self.met[:], self.n_met = False, 0
        self.met[at] = True
        self.n_met += at.size - int(again.sum())
        self.memo.update(itertools.islice(itertools.compress(done.items(), again.tolist()), max(0, MEMO_PIECES - len(self.memo))))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
