"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic class. A target of a dimension is
either the wanted shares of tokens by value, or a temperature t: shares as the observed ones
to the power t, which lowers the largest classes and raises the small ones (``*`` keeps its share). With shares, a
value that is named is its own class; with a temperature, one that holds at least ``least``
of all tokens. All others (and null) share the class ``*``, which gets what the named shares
leave, or its observed share of the tokens where they leave nothing (the named shares are
scaled to the rest), so that no class is removed. So the cells are bounded by the targets and
by ``least``, not by the data: they and the values of at least that share are the only thing
that reaches the driver.

Topics are fitted: a document is the shapes of its words (runs of letters, runs of digits and
what stands around them, so alike in every language), counted in ``SHAPES`` buckets; their
square roots, scaled to length 1, are clustered by spherical k-means over all documents
(``fit_topics``); the counts are written once, so texts are read once. Every whole text is
then assigned to the nearest centre.

Token weights of the cells are raked to each marginal in turn until all hold, which keeps the
odds ratios of the corpus. Each cell's weight (raked over observed share) times one constant
is the probability of its documents. The constant is ``budget``, or the largest one that
takes no probability past 1 where that is less, so expected shares equal the raked ones;
``report`` gives wanted and drawn shares by class. Marginals that the empty cells make
unreachable raise a warning.

A document is drawn if a hash of seed, id and text falls below its cell's probability: the
draw needs no shuffle and repeats on a retry.

Targets of a class without tokens are dropped and the rest of that marginal scaled up.
Nulls: null text has no tokens; null source, language or id counts as ``*`` or as any id; a
text without words has the topic ``*``. Repeated rows share one draw. Empty input gives no
rows. A corpus without tokens keeps every document. A missing source or language column
counts as null. Extra columns are carried in ``row``, whatever their names.
"""

from __future__ import annotations

import re
import warnings
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

OTHER = "*"
TARGETS: dict[str, dict[str, float] | float] = {
    "source": 0.7,
    "lang": {"en": 0.50, "fr": 0.20, "de": 0.18, "es": 0.12},
    "topic": 0.9,
}
#: Buckets of word shapes.
SHAPES = 256
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


class _Buckets(dict):
    """Bucket of a word's shape; words met are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = _DIGITS.sub("9", _LETTERS.sub("a", word.decode()))
        at = self[word] = zlib.crc32(shape.encode()) % SHAPES
        return at


_BUCKETS = _Buckets()


def shape_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text by bucket of their shape (texts, SHAPES), and their numbers."""
    out = np.zeros((len(texts), SHAPES))
    for k, text in enumerate(texts):
        words = text.encode().split() if text else []  # only ASCII blanks part words
        if words:
            out[k] = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), minlength=SHAPES)
    return out, out.sum(axis=1).astype(np.int64)


def _unit(counts: np.ndarray) -> np.ndarray:
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))


def packed(counts: np.ndarray) -> list[bytes]:
    """Each row's filled buckets as bytes: 2 of the bucket and 4 of the square root of its share, in 2^-24."""
    shares = np.rint(_unit(counts) * (1 << 24)).astype("<i4")
    out = []
    for row in shares:
        at = np.flatnonzero(row)
        got = np.empty(len(at), _ENTRY)
        got["at"], got["x"] = at, row[at]
        out.append(got.tobytes())
    return out


_ENTRY = np.dtype([("at", "<u2"), ("x", "<i4")])


def unpacked(shapes: list[bytes]) -> np.ndarray:
    """The rows of ``packed`` (rows, SHAPES), whole numbers."""
    flat = np.frombuffer(b"".join(shapes), _ENTRY)
    out = np.zeros((len(shapes), SHAPES), np.int64)
    out[np.repeat(np.arange(len(shapes)), [len(s) // _ENTRY.itemsize for s in shapes]), flat["at"]] = flat["x"]
    return out


def fit_topics(rows: DataFrame, *, topics: int = 6, rounds: int = 30) -> np.ndarray:
    """Centres (topics, SHAPES) fitted on all ``rows`` (shapes, u) with words; none if there is no such row.

    Spherical k-means. Every pass reads all rows; a task returns whole-number sums by centre,
    so centres depend neither on the partitions nor on their order. The first centre is the
    mean; each next one is a document drawn from all (by its hash) in proportion to how far
    it lies from those before.
    """
    rows = rows.filter(F.octet_length("shapes") > 0).select("shapes", "u")
    schema = pa.schema([("k", pa.int32()), ("key", pa.float64()), ("sum", pa.binary())])

    def one_pass(centres: np.ndarray, draw: bool):
        def sums(batches):
            total, best = np.zeros((max(1, len(centres)), SHAPES), np.int64), None
            for batch in batches:
                shapes, u = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for a in range(0, len(shapes), 2000):
                    part = shapes[a : a + 2000]
                    x = unpacked(part)
                    like = x.astype(np.float64) / (1 << 24) @ centres.T if len(centres) else np.zeros((len(x), 1))
                    near = np.argmax(like, axis=1)
                    if not draw:
                        for k in range(len(total)):
                            total[k] += x[near == k].sum(axis=0)
                        continue
                    far = np.maximum(1e-12, 1 - like.max(axis=1))
                    key = -np.log(np.maximum(u[a : a + 2000], 1e-18)) / far  # least of exponentials: a draw in proportion to far
                    for k in np.flatnonzero(key == key.min()):
                        best = min(best or (np.inf, b""), (float(key[k]), part[k]))
            if draw:
                key, shape = best or (np.inf, b"")
                yield pa.RecordBatch.from_pydict({"k": [0], "key": [key], "sum": [shape]}, schema)
            else:
                yield pa.RecordBatch.from_pydict({"k": list(range(len(total))), "key": [0.0] * len(total), "sum": [t.tobytes() for t in total]}, schema)

        return rows.mapInArrow(sums, "k int, key double, sum binary")

    def moved(centres: np.ndarray) -> np.ndarray:
        total = np.zeros((max(1, len(centres)), SHAPES), np.int64)
        for r in one_pass(centres, False).collect():  # a few rows a partition
            total[r["k"]] += np.frombuffer(r["sum"], np.int64)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        return np.where(length > 0, total / np.maximum(length, 1), centres if len(centres) else 0.0)

    centres = moved(np.zeros((0, SHAPES)))
    if not centres.any():
        return np.zeros((0, SHAPES))
    while len(centres) < topics:
        r = one_pass(centres, True).filter(F.octet_length("sum") > 0).orderBy("key", "sum").first()  # one row a partition
        x = unpacked([bytes(r["sum"])])[0] / (1 << 24)
        if 1 - (centres @ x).max() < 1e-9:  # fewer kinds of documents than topics
            break
        centres = np.vstack([centres, x])
    for _ in range(rounds):
        old, centres = centres, moved(centres)
        if np.allclose(old, centres):
            break
    return centres


def shapes_and_tokens(text: Column) -> Column:
    """Struct of the shapes of a text's words (``packed``, empty without words) and their number."""

    @F.pandas_udf("shapes binary, tokens long")
    def told(text: pd.Series) -> pd.DataFrame:
        shapes, tokens = [], []
        for a in range(0, len(text), 500):
            counts, n = shape_counts(text.iloc[a : a + 500].tolist())
            shapes += packed(counts)
            tokens += n.tolist()
        return pd.DataFrame({"shapes": pd.Series(shapes, dtype=object), "tokens": pd.Series(tokens, dtype="int64")})

    return told(text)


def topic_of(centres: np.ndarray):
    """A function of a column of ``packed`` shapes: the nearest centre's topic (null without words)."""

    @F.pandas_udf("string")
    def told(shapes: pd.Series) -> pd.Series:
        names = []
        for a in range(0, len(shapes), 2000):
            part = [bytes(s) for s in shapes.iloc[a : a + 2000]]
            near = np.argmax(unpacked(part) / (1 << 24) @ centres.T, axis=1) if len(centres) else np.zeros(len(part), int)
            names += [f"topic{k}" if s else None for k, s in zip(near.tolist(), part, strict=True)]
        return pd.Series(names, dtype=object)

    return told


def rake(tokens: np.ndarray, margins: list[np.ndarray], rounds: int = 500, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Cell shares with the odds of ``tokens`` and the given marginal shares, and the largest miss of a marginal.

    tokens: an array with one axis for each marginal. If the empty cells make the marginals
    unreachable, the shares of the last round.
    """
    share = tokens / tokens.sum()
    axes = range(share.ndim)
    goals = []
    for axis, goal in zip(axes, margins, strict=True):
        there = share.sum(axis=tuple(a for a in axes if a != axis)) > 0
        goal = np.where(there, goal, 0.0)
        goals.append(goal / goal.sum() if goal.sum() else there / there.sum())
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for axis, goal in zip(axes, goals, strict=True):
            now = share.sum(axis=tuple(a for a in axes if a != axis))
            worst = max(worst, float(np.abs(now - goal).max()))
            factor = np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
            share = share * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst < tolerance:
            break
    return share, worst


def probabilities(weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to the cells' weights, the largest at most 1, expecting at most ``budget`` of all tokens."""
    return weight * min(budget, 1 / weight.max()) if weight.size and weight.max() > 0 else weight


def with_other(named: list[float], observed: float) -> np.ndarray:
    """The named shares and that of ``*``: what they leave, or the observed share if they leave nothing."""
    left = 1 - sum(named)
    if left > 1e-9 or not observed:
        return np.array([*named, max(0.0, left)])
    return np.array([*(np.array(named) / sum(named) * (1 - observed)), observed])


def tempered(observed: np.ndarray, temperature: float) -> np.ndarray:
    """Shares of the named classes as the observed ones to the power ``temperature``; the last, ``*``, keeps its own."""
    raised = np.power(observed[:-1], temperature, out=np.zeros_like(observed[:-1]), where=observed[:-1] > 0)
    return np.append(raised / raised.sum() * (1 - observed[-1]) if raised.sum() else raised, observed[-1])


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float] | float] = TARGETS, *, budget: float = 0.6, least: float = 0.01, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    classes: dict[str, Column] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """Columns of ``docs`` (``keep``, or all) in ``row``; class and target share of each dimension, tokens, weight, probability and sampled."""
    spark = docs.sparkSession
    dims = list(targets)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    column = lambda c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), text), F.lit(1 << 53)).cast("double") / float(1 << 53)
    told = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row"), shapes_and_tokens(text).alias("told"), u.alias("u"), *((classes or {}).get(d, column(d) if d != "topic" else F.lit(None).cast("string")).alias(f"v_{d}") for d in dims))
    rows = materialise(told.select("row", F.col("told.tokens").alias("tokens"), F.col("told.shapes").alias("shapes"), "u", *(f"v_{d}" for d in dims)), "classed")
    if "topic" in dims and not (classes or {}).get("topic"):
        rows = rows.withColumn("v_topic", topic_of(fit_topics(rows))("shapes"))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    names = []
    for d in dims:
        if isinstance(targets[d], dict):
            named = list(targets[d])
        else:  # at most 1 / least values
            held = rows.filter(F.col(f"v_{d}").isNotNull()).groupBy(f"v_{d}").agg(F.sum("tokens").alias("n")).filter(F.col("n") >= least * max(1, total))
            named = sorted(r[0] for r in held.collect() if r[0] != OTHER)
        names.append([*named, OTHER])
    keys = [f"{d}_class" for d in dims]
    classed = rows.select("row", "tokens", "u", *(F.when(F.col(f"v_{d}").isin(n[:-1]), F.col(f"v_{d}")).otherwise(OTHER).alias(k) for d, n, k in zip(dims, names, keys, strict=True)))
    tokens = np.zeros([len(n) for n in names])
    for r in classed.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).collect():  # at most the cells
        tokens[tuple(n.index(r[k]) for n, k in zip(names, keys, strict=True))] = r["tokens"]
    goals = [np.zeros(len(n)) for n in names]
    if tokens.sum():
        observed = [tokens.sum(axis=tuple(a for a in range(len(dims)) if a != i)) / tokens.sum() for i in range(len(dims))]
        goals = [with_other(list(targets[d].values()), o[-1]) if isinstance(targets[d], dict) else tempered(o, targets[d]) for d, o in zip(dims, observed, strict=True)]
        goals = [np.where(o > 0, g, 0) / np.where(o > 0, g, 0).sum() for g, o in zip(goals, observed, strict=True)]
        share, worst = rake(tokens, goals)
        if worst > 1e-3:
            warnings.warn(f"the targets cannot all be met: a marginal misses by {worst:.4f}", stacklevel=2)
        weight = np.divide(share, tokens / tokens.sum(), out=np.zeros_like(share), where=tokens > 0)
        p = probabilities(weight, budget)
    else:
        p = weight = np.ones_like(tokens)
    cells = [
        (*(n[i] for n, i in zip(names, at, strict=True)), *(float(g[i]) for g, i in zip(goals, at, strict=True)), float(weight[at]), float(p[at]))
        for at in np.ndindex(*tokens.shape) if tokens[at] or not tokens.sum() or OTHER in [n[i] for n, i in zip(names, at, strict=True)]
    ]
    table = spark.createDataFrame(cells, ", ".join([*(f"{k} string" for k in keys), *(f"{d}_target double" for d in dims), "weight double", "probability double"]))
    out = classed.join(F.broadcast(table), keys, "left")  # a cell without tokens has no row there
    out = out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    # a document without tokens moves no share: it is drawn at the budget
    p = F.when(F.col("tokens") > 0, F.col("probability")).otherwise(F.lit(float(budget)) if tokens.sum() else F.col("probability"))
    return out.withColumn("probability", p).select("row", *keys, *(f"{d}_target" for d in dims), "tokens", "weight", "probability", ((F.col("u") < F.col("probability")) | (F.col("probability") >= 1)).alias("sampled"))


def report(mixed: DataFrame) -> DataFrame:
    """dimension, class, target, drawn: wanted and drawn shares of tokens."""
    dims = [c.removesuffix("_class") for c in mixed.columns if c.endswith("_class")]
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"{d}_class").alias("class"), F.col(f"{d}_target").alias("target")) for d in dims])).alias("x")
    sums = mixed.select(one, F.when(F.col("sampled"), F.col("tokens")).otherwise(0).alias("n")).groupBy("x.dimension", "x.class").agg(F.max("x.target").alias("target"), F.sum("n").alias("n"))
    whole = sums.groupBy("dimension").agg(F.sum("n").alias("all"))
    return sums.join(whole, "dimension").select("dimension", "class", "target", (F.col("n") / F.col("all")).alias("drawn"))
