"""Nearest neighbours by a forest of hash-prefix trees.

Each tree orders vectors by a long string of bits, one bit a random hyperplane, in a sorted
array; a node is the range of strings that share a prefix. A query goes down each tree to
its longest prefix that some vector has, then all trees go up one bit at a time together,
each step adding the vectors whose strings share the shorter prefix.

Nearness is the inner product, hashes see angles: so each vector x of a block gets one more
component, sqrt(m^2 - |x|^2) with m the greatest length in the block, and queries a zero.
All raised vectors have length m, the products stay, and order by product is order by angle.

When to stop: at prefix length x a vector at angle t from the query has been missed with
probability (1 - (1 - t/pi)^x)^trees. The climb ends once there are enough candidates and
that probability, for the k-th best found so far, is at most ``miss``. Products are computed
for candidates only. No cap on candidates: where vectors are spread evenly the climb goes on
to short prefixes, at worst to the root, which is the exact search.

The stated queries meet all rows in blocks: the rows are dealt to blocks of a bounded
number of rows, each an index of its own, the queries to chunks, and each pair of block
and chunk is searched by one task; the k best of each block are merged by window. The hash
planes come from a seed; nothing is fitted.

Vectors that are null, zero, of another length than ``dim``, or hold null or non-finite
components take no part. Scores are inner products in double precision, summed component by
component, so equal vectors have equal scores; ties go to the smaller id. Null ids take no
part. A repeated id is asked once, with its least vector, and rows of its id are its own;
repeated rows of other ids are candidates each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, project


class Forest:
    """Sorted arrays of hash strings over one block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        squares = np.einsum("ij,ij->i", vectors, vectors)
        self.length = float(np.sqrt(squares.max()))
        raised = np.column_stack([vectors, np.sqrt(np.maximum(0, squares.max() - squares))])
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1] + 1, bits))
        self.scaled = (vectors / self.length).astype(np.float32)
        order, self.keys = [], []
        for t in range(trees):
            keys = self.strings(raised, t)
            order.append(np.argsort(keys, kind="stable"))
            self.keys.append(keys[order[-1]])
        self.order = np.concatenate(order).astype(np.int32)  # one tree after the other

    def strings(self, raised: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings of up to 64 bits, the first bit most significant."""
        up = raised @ self.planes[tree] > 0
        weights = np.uint64(1) << np.arange(63, 63 - self.bits, -1, dtype=np.uint64)
        return (up * weights).sum(axis=1, dtype=np.uint64)

    def search(self, queries: np.ndarray, k: int, enough: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its candidates, as row numbers, and their rough products with it at length 1 (errors under ``ROUGH``)."""
        raised = np.column_stack([queries, np.zeros(len(queries))])
        strings = [self.strings(raised, t) for t in range(self.trees)]
        n, full = len(self.vectors), np.uint64(0xFFFFFFFFFFFFFFFF)
        # descend: the longest prefix shared with a neighbour in the sorted array
        deepest = np.zeros((self.trees, len(queries)), np.int64)
        for t in range(self.trees):
            at = np.searchsorted(self.keys[t], strings[t])
            for side in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                differ = self.keys[t][side] ^ strings[t]
                shared = np.where(differ == 0, self.bits, 63 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64))
                deepest[t] = np.maximum(deepest[t], np.minimum(shared, self.bits))
        bounds = {}

        def ranges(x: int):
            """Each tree's range of rows under each query's prefix of x bits."""
            if x not in bounds:
                keep = full << np.uint64(64 - x) if x else np.uint64(0)
                low = np.stack([np.searchsorted(self.keys[t], strings[t] & keep, "left") for t in range(self.trees)])
                high = np.stack([np.searchsorted(self.keys[t], strings[t] | ~keep, "right") for t in range(self.trees)])
                bounds[x] = low, high
            return bounds[x]

        units = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
        first = np.arange(self.trees) * n
        for q in range(len(queries)):
            found, x = np.zeros(n, bool), int(deepest[:, q].max())
            begin, end, begun = np.zeros(self.trees, np.int64), np.zeros(self.trees, np.int64), np.zeros(self.trees, bool)
            rows, products, top = [], [], np.zeros(0, np.float32)
            count = 0
            while True:
                low, high = (r[:, q] for r in ranges(x))
                on = deepest[:, q] >= x
                # what the shorter prefix adds on either side; all of it where a tree joins in
                left, right = np.where(begun, begin, low), np.where(begun, end, low)
                start, stop = np.concatenate([(low + first)[on], (right + first)[on]]), np.concatenate([(left + first)[on], (high + first)[on]])
                size = stop - start
                at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                before = found.copy()
                found[self.order[at]] = True
                fresh = np.flatnonzero(found ^ before)
                begin, end, begun = np.where(on, low, begin), np.where(on, high, end), begun | on
                count += fresh.size
                rows.append(fresh)
                products.append(self.scaled[fresh] @ units[q])
                if x == 0 or count == n:
                    break
                top = np.concatenate([top, products[-1]])
                if top.size > k:
                    top = np.partition(top, top.size - k)[top.size - k :]
                if count >= max(enough, k):
                    near = 1 - np.arccos(np.clip(float(top.min()), -1, 1)) / np.pi
                    if (1 - near**x) ** self.trees <= miss:
                        break
                x -= 1
            yield np.concatenate(rows), np.concatenate(products)


#: No rough product of vectors of at most length 1, in single precision, is wrong by more.
ROUGH = 1e-4


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, one component after the other."""
    out = np.zeros(len(vectors))
    for d in range(query.size):
        out += vectors[:, d] * query[d]
    return out


def best(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, rough: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``rows`` by (score falling, id rising); rows whose rough product (of vectors scaled to lengths of at most 1) can't reach the k-th are left out first."""
    if ids.size > k:
        floor = np.partition(rough, ids.size - k)[ids.size - k]
        keep = rough >= floor - 2 * ROUGH
        ids, rows = ids[keep], rows[keep]
    score = exact_scores(vectors[rows], query)
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def nearest(
    rows: DataFrame, *, every: int = 20, k: int = 20, dim: int = 64, trees: int = 64, bits: int = 32, miss: float = 0.08, enough: int = 400,
    block_rows: int = 16384, chunk_queries: int = 4096, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``every`` its k nearest other rows."""
    v = project(rows, id=id_col, v=vector_col).filter("id is not null and v is not null")
    fit = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = materialise(v.filter(fit).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), "vectors")
    asked = v.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, n_asked = v.count(), asked.count()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-n_asked // chunk_queries))
    # dealt by a hash of the id: no block holds much more than its share
    data = v.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = asked.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(block):
            ids, vectors = block["id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float64)
            asked, wanted = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(np.float64)
            forest = Forest(vectors, trees, bits, seed)
            for q, (rows, rough) in enumerate(forest.search(wanted, min(k + 1, len(ids)), min(enough, len(ids)), miss)):
                other = ids[rows] != asked[q]
                got, score = best(ids[rows[other]], vectors, wanted[q], k, rough[other], rows[other])
                out["query_id"].append(np.full(got.size, asked[q]))
                out["vec_id"].append(got)
                out["score"].append(score)
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pd.DataFrame({c: np.concatenate(x).astype(kinds[c]) if x else np.zeros(0, kinds[c]) for c, x in out.items()})

    found = asks.groupBy("block", "chunk").cogroup(data.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
