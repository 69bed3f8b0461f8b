import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from trackloom.llm import queries, suffix_tree


def words(t):
    return suffix_tree.words_of(t) + [b""]


def check(rows, got):
    train = [words(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for d in train for w in d)
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        w = words(t)
        want[i, held, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want


def test_whole_query(spark, sf_rows):
    got = queries.op3_suffix_tree(spark, "/root/testdata/sf0.001").collect()
    check([(r["doc_id"], r["text"]) for r in sf_rows], got)
    assert all(r["score"] < 0 for r in got)


def brute_score(texts, text, depth, floor, gap):
    """The tree over strings of bytes, context by context."""
    n = Counter()
    for t in texts:
        s = b" " * depth + b" ".join(suffix_tree.words_of(t)) + b"\n"
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                n[s[i - k : i], s[i]] += 1
    total = Counter()
    kinds = Counter()
    for (ctx, _), k in n.items():
        total[ctx] += k
        kinds[ctx] += 1
    seen = {s for ctx, s in n if ctx == b""} | {32, 10}

    def p(sym, ctx):
        below = (1 / 256 if sym in seen else 1 / 256) if ctx == b"" else p(sym, ctx[1:])
        drawn = suffix_tree.DRAWN * (kinds[ctx] + 1)
        return (n[ctx, sym] + drawn * below) / (total[ctx] + drawn)

    kept = {b""}
    for ctx in total:
        if ctx and total[ctx] >= floor:
            d = sum(n[ctx, s] / total[ctx] * math.log(n[ctx, s] / total[ctx] / p(s, ctx[1:])) for s in range(256) if n[ctx, s])
            if d >= gap:
                kept |= {ctx[k:] for k in range(len(ctx))}
    s = b" " * depth + b" ".join(suffix_tree.words_of(text)) + b"\n"
    return sum(math.log10(p(s[i], next(s[i - k : i] for k in range(depth, -1, -1) if s[i - k : i] in kept))) for i in range(depth, len(s)))


def test_scores_equal_a_tree_built_by_hand(spark):
    texts = ["abracadabra abra", "ABRACA dabra cad", "the cat the hat", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "abra the zebra é")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("doc_id") < 5, depth=3, least_share=0.0, least_divergence=0.05).collect()}
    for i, t in [*enumerate(texts), (9, "abra the zebra é")]:
        assert abs(got[i] - brute_score(texts, t, 3, 4, 0.05)) < 1e-3, (i, t)


def test_odd_rows(spark, odd, none):
    out = suffix_tree.score(odd, ~suffix_tree.held_out()).withColumn("held_out", ~F.col("train")).collect()
    check([(r["doc_id"], r["text"]) for r in odd.collect()], out)
    assert suffix_tree.score(none, ~suffix_tree.held_out()).count() == 0
    untrained = suffix_tree.score(odd, F.lit(False)).filter("doc_id = 4").first()
    assert abs(untrained["score"] - 2 * math.log10(1 / 256)) < 1e-3 and untrained["base_score"] == 0.0


def logs_of(tree, text, depth):
    symbols, first = suffix_tree._stream([suffix_tree.words_of(text)], depth)
    return tree.logs(suffix_tree.windows(symbols, suffix_tree._scored(first, symbols.size, depth), depth))


def test_long_contexts_in_shards(spark):
    texts = ["abracadabra abra", "ABRACA dabra cad abracadabra", "the cat the hat é中é中 the cat", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for shard, keep in ((10**6, 4), (1, 100), (1, 0)):
        tree = suffix_tree.grow(df, depth=7, least_divergence=0.05, shard=shard)
        tree.keep = keep
        assert (len(tree.shards) > 1) == (shard == 1)
        for t in [*texts, "abracadabra the zebra é中"]:
            assert abs(logs_of(tree, t, 7).sum() - brute_score(texts, t, 7, 4, 0.05)) < 1e-6, (shard, t)


def test_a_rare_context_counts_however_large_the_corpus(spark):
    common = spark.range(1000).select(F.repeat(F.lit("a b "), 700).alias("text"))  # 2.8 million symbols
    rare = spark.createDataFrame([("wqzjxk",)] * 4, "text string")
    tree = suffix_tree.grow(common.union(rare), depth=5)
    assert logs_of(tree, "wqzjxk", 5)[-2] > -0.5  # k after wqzjx, seen four times of four
    assert tree.states > suffix_tree.grow(common, depth=5).states


def test_held_out_text_scores_better_than_the_base(spark):
    """On sf0.1; on the 900 learned documents of sf0.01 the tree stays a little behind the base (README)."""
    out = queries.op3_suffix_tree(spark, "/root/testdata/sf0.1").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1]
    small = queries.op3_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (small[1] - small[0]) / small[2] < 0.1
