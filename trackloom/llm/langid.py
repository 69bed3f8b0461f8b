"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Training is by backpropagation through time (Adam) on the driver, on a bounded sample of
labelled documents: ``per_lang`` documents of each language, those with the least hash of
id and text, and ``cuts`` windows of ``window`` bytes from each, at hashed places of the whole
text. Every label is a language. Everything else covers whole texts: every
byte position of every text gets a probability of each language, in windows that overlap
by ``warm`` bytes on either side so that each position has context, and a document's
probability is the mean over its positions.

Nulls: a text that is null, empty or without a letter is ``und`` with score 0; rows with
null labels are not learned from; null ids are carried. With no labelled row everything
is ``und``. Repeated rows are labelled alike. Empty input gives no rows. Ties between
languages go to the first in order. Other columns are not read, and neither label nor
source nor id is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import project

_LETTER = regex.compile(r"\p{L}")


def _squash(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place; exp is far cheaper than tanh here."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Cell:
    """One direction: inputs are bytes, so their products are rows of ``x`` (256, 3h): update, reset, new."""

    x: np.ndarray
    zr: np.ndarray
    n: np.ndarray

    def forward(self, seq: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (steps, lanes, h) over byte lanes (steps, lanes)."""
        h = self.n.shape[0]
        state = np.zeros((seq.shape[1], h), np.float32)
        out = np.empty((*seq.shape, h), np.float32)
        kept = []
        gate_x, new_x = np.ascontiguousarray(self.x[:, : 2 * h]), np.ascontiguousarray(self.x[:, 2 * h :])
        for t, byte in enumerate(seq):
            gates = state @ self.zr
            gates += gate_x.take(byte, axis=0)
            _squash(gates)
            z, r = gates[:, :h], gates[:, h:]
            new = (r * state) @ self.n
            new += new_x.take(byte, axis=0)
            new *= 2  # tanh by the logistic function
            _squash(new)
            new *= 2
            new -= 1
            if keep:
                kept.append((state, z, r, new))
            state = state - new
            state *= z
            state += new
            out[t] = state
        return out, kept

    def backward(self, seq: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self.n.shape[0]
        gx, gzr, gn = np.zeros_like(self.x), np.zeros_like(self.zr), np.zeros_like(self.n)
        d = np.zeros_like(kept[0][0])
        for t in range(len(seq) - 1, -1, -1):
            state, z, r, new = kept[t]
            d = d + grad[t]
            dnew = d * (1 - z) * (1 - new * new)
            dz = d * (state - new) * z * (1 - z)
            back = dnew @ self.n.T
            dr = back * state * r * (1 - r)
            both = np.concatenate([dz, dr], axis=1)
            gn += (r * state).T @ dnew
            gzr += state.T @ both
            np.add.at(gx, seq[t], np.concatenate([both, dnew], axis=1))
            d = d * z + back * r + both @ self.zr.T
        return gx, gzr, gn


class BiGRU:
    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)

        def cell() -> Cell:
            return Cell(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (256, 3 * hidden)), (0.3, (hidden, 2 * hidden)), (0.3, (hidden, hidden)))))

        self.langs, self.hidden = langs, hidden
        self.ahead, self.back = cell(), cell()
        self.out = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def scores(self, seq: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        """Unnormalised probabilities (steps, lanes, languages) of byte lanes (steps, lanes)."""
        f = self.ahead.forward(seq)[0][at]
        b = self.back.forward(seq[::-1])[0][::-1][at]
        p = f @ self.out[: self.hidden]
        p += b @ self.out[self.hidden :]
        p += self.bias
        return np.exp(np.clip(p, -40, 40, out=p), out=p)

    def labels(self, seq: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at every position."""
        p = self.scores(seq)
        return p / p.sum(axis=2, keepdims=True)

    def _pass(self, seq: np.ndarray):
        f, kf = self.ahead.forward(seq, True)
        b, kb = self.back.forward(seq[::-1], True)
        both = np.concatenate([f, b[::-1]], axis=2)
        p = both @ self.out + self.bias
        p = np.exp(p - p.max(axis=2, keepdims=True))
        return p / p.sum(axis=2, keepdims=True), both, kf, kb

    def fit(self, seq: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 6) -> None:
        """seq (windows, bytes), y their languages."""
        rng = np.random.default_rng(seed)
        params = [self.ahead.x, self.ahead.zr, self.ahead.n, self.back.x, self.back.zr, self.back.n, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            at = rng.integers(0, len(seq), batch)
            s = np.ascontiguousarray(seq[at].T)
            p, both, kf, kb = self._pass(s)
            p[:, np.arange(batch), y[at]] -= 1
            p /= p.shape[0] * batch
            d = p @ self.out.T
            h = self.hidden
            flat, dp = both.reshape(-1, 2 * h), p.reshape(-1, p.shape[2])
            grads = [*self.ahead.backward(s, kf, d[:, :, :h]), *self.back.backward(s[::-1], kb, d[::-1, :, h:]), flat.T @ dp, dp.sum(axis=0)]
            size = np.sqrt(sum(float((g * g).sum()) for g in grads))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for w, g, a, b in zip(params, grads, m, v, strict=True):
                g = g / max(1.0, size)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)

    def pooled(self, texts: list[bytes], window: int, warm: int, lanes: int = 2048) -> np.ndarray:
        """Mean probabilities over all byte positions of each (non-empty) text.

        A lane holds ``warm`` bytes of context, ``window`` labelled ones and ``warm`` more; past
        a text's ends stand line feeds.
        """
        sums = np.zeros((len(texts), len(self.langs)))
        pad = b"\n" * warm
        flat = np.frombuffer(b"".join([pad + t + pad + b"\n" * (-len(t) % window) for t in texts]), np.uint8)
        sizes = np.array([len(t) for t in texts])
        n_lanes = -(-sizes // window)
        first = np.cumsum(n_lanes * window + 2 * warm) - (n_lanes * window + 2 * warm)
        owner = np.repeat(np.arange(len(texts)), n_lanes)
        k = np.arange(owner.size) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        start, valid = first[owner] + k * window, np.minimum(window, sizes[owner] - k * window)
        ones = np.ones(len(self.langs), np.float32)
        for a in range(0, owner.size, lanes):
            s = start[a : a + lanes]
            seq = flat[s + np.arange(window + 2 * warm)[:, None]]
            p = self.scores(seq, slice(warm, warm + window))
            share = (np.arange(window)[:, None] < valid[a : a + lanes]) / (p @ ones)
            np.add.at(sums, owner[a : a + lanes], np.einsum("tl,tlk->lk", share, p))
        return sums / np.maximum(1, sizes)[:, None]


def train(labelled: DataFrame, *, per_lang: int = 300, cuts: int = 4, window: int = 48, hidden: int = 8, steps: int = 220, batch: int = 96, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGRU | None:
    """A network fitted on at most ``per_lang`` documents of each language: ``cuts`` windows of each reach the driver, not texts.

    None if there is no labelled row with text.
    """
    rows = project(labelled, doc_id=id_col, text=text_col, lang=lang_col).filter("lang is not null and length(text) > 0")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return None
    deal = F.xxhash64("doc_id", "text")
    # a share of each language that holds about four times what is wanted, then the least hashes of that
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 4 * per_lang / counts[k]))]), F.col("lang"))
    some = rows.select("lang", deal.alias("deal")).filter(F.pmod("deal", F.lit(1 << 31)) < share * (1 << 31)).distinct()
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("deal"))).filter(F.col("rank") <= per_lang)
    chosen = {(r["lang"], r["deal"]) for r in top.select("lang", "deal").collect()}
    wanted = sorted({d for _, d in chosen})
    place = lambda k: F.pmod(F.xxhash64("deal", F.lit(k)), F.greatest(F.lit(1), F.length("text") - window)).cast("int") + 1
    windows = F.array(*[F.substring(F.col("text"), place(k), F.lit(window)) for k in range(cuts)])
    got = rows.withColumn("deal", deal).filter(F.col("deal").isin(wanted)).select("lang", "deal", windows.alias("windows")).distinct().collect()
    seq, y = [], []
    for lang, parts in sorted((r["lang"], tuple(r["windows"])) for r in got if (r["lang"], r["deal"]) in chosen):
        for part in parts:
            seq.append(np.frombuffer((part.encode() + b"\n" * window)[:window], np.uint8))
            y.append(langs.index(lang))
    model = BiGRU(langs, hidden)
    y = np.array(y)
    # every language alike often
    order = np.concatenate([np.resize(np.flatnonzero(y == k), per_lang * cuts) for k in range(len(langs)) if (y == k).any()])
    if len(langs) > 1:
        model.fit(np.array(seq)[order], y[order], steps, batch)
    return model


def predict(docs: DataFrame, model: BiGRU | None, *, window: int = 240, warm: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score (the pooled probability of the likeliest language), and the columns kept."""
    carried = {f"k{i}": name for i, name in enumerate(keep or [])}
    rows = project(docs, doc_id=id_col, text=text_col, **carried).withColumn("doc_id", F.col("doc_id").cast("long"))
    named = [F.col(k).alias(name) for k, name in carried.items()]
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *named)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                texts = b.column(1).to_pylist()
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
                live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                if live:
                    p = model.pooled([texts[i].encode() for i in live], window, warm)
                    for i, row in zip(live, p, strict=True):
                        k = int(row.argmax())
                        lang[i], score[i] = model.langs[k], min(1.0, float(row[k]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), *(b.column(k) for k in carried)], names=["doc_id", "lang_pred", "score", *carried])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, ", ".join(["doc_id long", "lang_pred string", "score double", *(f"{k} {kinds[k]}" for k in carried)])).select("doc_id", "lang_pred", "score", *named)


def held_out(column: Column, parts: int = 5, part: int = 0) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % parts == part
