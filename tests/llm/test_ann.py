import numpy as np

from trackloom.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, id string, v string, score double"


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    ids, m = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for q, v in ok:
        if q % every == 0:
            s = ann.exact_scores(m, v)
            other = ids != q
            order = np.lexsort((ids[other], -s[other]))[:k]
            out[q] = list(zip(ids[other][order].tolist(), s[other][order].tolist(), strict=True))
    return out


def read(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, got = brute(rows), read(queries.op2_hash_prefix_forest(spark, "/root/testdata/sf0.001"))
    assert want.keys() == got.keys()
    exact = {i: np.array(v, np.float64) for i, v in rows}
    hit = 0
    for q, found in got.items():
        assert len(found) == len(want[q]) and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float(exact[q] @ exact[i])) < 1e-12 for i, s in found)
        hit += len({i for i, _ in found} & {i for i, _ in want[q]})
    assert hit >= 0.9 * sum(map(len, want.values()))


def measured(v, queries, miss=0.08):
    """Recall at 20, the least of a query, and the mean share of vectors that were scored."""
    forest, ids, hits, seen = ann.Forest(v, 64, 32, 11), np.arange(len(v)), [], 0
    for k, (rows, rough) in enumerate(forest.search(queries, 20, 400, miss)):
        got, _ = ann.best(ids[rows], v, queries[k], 20, rough, rows)
        want = np.lexsort((ids, -(v @ queries[k])))[:20]
        hits.append(len(set(got) & set(want)) / 20)
        seen += rows.size
    return np.mean(hits), min(hits), seen / len(queries) / len(v)


def clustered(n, unequal, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, 64))
    v = centres[rng.integers(0, 60, n)] + 0.3 * rng.standard_normal((n, 64))
    return v * rng.uniform(0.5, 1.5, (n, 1)) if unequal else v / np.linalg.norm(v, axis=1, keepdims=True)


def test_forest_prunes_and_recalls():
    v = clustered(6000, unequal=False)
    recall, _, share = measured(v, v[:40])
    assert recall >= 0.9 and share < 0.2


def test_forest_on_unequal_lengths():
    v = clustered(6000, unequal=True)
    recall, least, share = measured(v, v[:40])
    assert recall >= 0.9 and share < 0.6


def test_several_blocks_recall(spark):
    v = clustered(3000, unequal=True, seed=4).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want, got = brute(rows), read(ann.nearest(df, block_rows=700, chunk_queries=64))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert got.keys() == want.keys() and hit >= 0.9 * sum(map(len, want.values()))


def test_repeated_ids_are_asked_once(spark):
    v = clustered(300, unequal=False).tolist()
    rows = [(i, x) for i, x in enumerate(v)]
    df = spark.createDataFrame([*rows, (20, v[20]), (20, v[20]), (40, v[41])], "vec_id long, embedding array<double>")
    got = read(ann.nearest(df))
    plain = brute(rows)
    assert len(got[20]) == 20 and len({i for i, _ in got[20]}) == 20 and 20 not in {i for i, _ in got[20]}
    assert {i for i, _ in got[20]} <= {i for i, _ in plain[20]} | {40}


def test_odd_vectors_ties_and_blocks(spark):
    one, two = [1.0] + [0.0] * 63, [0.5] + [0.5] * 63
    rows = [(0, one), (1, one), (2, two), (20, one), (3, None), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [1.0]), (7, [None] + [1.0] * 63), (8, [float("inf")] + [0.0] * 63), (None, one), (9, one)]
    df = spark.createDataFrame([(i, v, "a", "b", 1.0) for i, v in rows], SCHEMA)
    want = brute(rows, k=3)
    assert read(ann.nearest(df, k=3)) == want
    assert read(ann.nearest(df, k=3, block_rows=2, chunk_queries=1)) == want
    assert [i for i, _ in want[0]] == [1, 9, 20]
    assert ann.nearest(df.limit(0)).count() == 0
