import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import mixing, queries


def test_raking_meets_the_marginals_and_keeps_odds():
    rng = np.random.default_rng(1)
    t = rng.integers(1, 1000, (3, 4, 2)).astype(float)
    margins = [np.array([0.2, 0.3, 0.5]), np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.6, 0.4])]
    s, worst = mixing.rake(t, margins)
    assert worst < 1e-8
    for a, m in enumerate(margins):
        assert np.allclose(s.sum(axis=tuple(b for b in range(3) if b != a)), m, atol=1e-8)
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert np.isclose(odds(s), odds(t))


def test_probabilities_are_never_cut():
    w = np.array([[2.5, 0.5], [1.0, 0.0]])
    assert np.allclose(mixing.probabilities(w, 0.3), 0.3 * w)
    assert np.allclose(mixing.probabilities(w, 0.9), w / 2.5)


def test_unreachable_targets_are_told(spark):
    df = spark.createDataFrame([(i, "w w", "ab"[i % 2], "xy"[i % 2]) for i in range(100)], "doc_id long, text string, source string, lang string")
    with pytest.warns(UserWarning, match="cannot all be met"):
        mixing.mix(df, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}).collect()


def test_query_meets_its_targets_and_equals_a_plain_version(spark):
    """The registered query on the whole table: drawn shares, and every row against plain numpy."""
    rows = {r["doc_id"]: r for r in queries.op8_rake_sources(spark, "/root/testdata/sf0.1").collect()}
    drawn = sum(r["tokens"] for r in rows.values() if r["sampled"])
    for d in mixing.TARGETS:
        names = {r[f"{d}_class"] for r in rows.values() if r["tokens"]}
        goals = {n: {r[f"{d}_target"] for r in rows.values() if r[f"{d}_class"] == n and r["tokens"]} for n in names}
        assert abs(sum(x for g in goals.values() for x in g) - 1) < 1e-9
        for n, (goal,) in goals.items():
            got = sum(r["tokens"] for r in rows.values() if r["sampled"] and r[f"{d}_class"] == n) / drawn
            assert abs(got - goal) < 0.01, (d, n, goal, got)
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    assert docs.keys() == rows.keys()
    key = lambda r: tuple(r[f"{d}_class"] for d in mixing.TARGETS)
    tokens, share = {}, {}
    for i, r in rows.items():
        assert r["tokens"] == len((docs[i]["text"] or "").encode().split())
        assert r["source_class"] == docs[i]["source"] and r["lang_class"] == docs[i]["lang"]
        tokens[key(r)] = tokens.get(key(r), 0) + r["tokens"]
    total = sum(tokens.values())
    goals = []
    for a, d in enumerate(mixing.TARGETS):
        seen = {}
        for k, n in tokens.items():
            seen[k[a]] = seen.get(k[a], 0) + n / total
        rest = seen.get("*", 0)
        want = {v: n**mixing.TARGETS[d] for v, n in seen.items() if v != "*"} if isinstance(mixing.TARGETS[d], float) else dict(mixing.TARGETS[d])
        goals.append({v: x / sum(want.values()) * (1 - rest) for v, x in want.items()} | ({"*": rest} if rest else {}))
    share = {k: n / total for k, n in tokens.items()}
    for _ in range(200):
        for a, goal in enumerate(goals):
            now = {}
            for k, x in share.items():
                now[k[a]] = now.get(k[a], 0) + x
            share = {k: x * goal[k[a]] / now[k[a]] for k, x in share.items()}
    weight = {k: share[k] / (n / total) for k, n in tokens.items() if n}
    c = min(0.6, 1 / max(weight.values()))
    for r in rows.values():
        if r["tokens"]:
            assert np.isclose(r["weight"], weight[key(r)], rtol=1e-6) and np.isclose(r["probability"], c * weight[key(r)], rtol=1e-6)


def test_topics_follow_the_shape_of_texts():
    texts = ["plain words in a row " * 20, "mots simples dans une ligne " * 20, "a | b | 1 | 22 | " * 30, "id 12345 99 1234567 " * 30, "", None]
    counts, n = mixing.shape_counts(texts)
    assert n.tolist() == [100, 100, 240, 120, 0, 0]
    near = mixing._unit(counts) @ mixing._unit(counts).T
    assert near[0, 1] > 0.99 and near[0, 2] < 0.9 and near[0, 3] < 0.9


def test_rows_ties_and_clashing_names(spark):
    """Rows without source and lang, with clashing names, repeated, long, and with a class named like the rest."""
    long = "word 123 " * 300_000
    data = [(1, "a b", "x", 1, 2.0, "p"), (1, "a b", "x", 1, 2.0, "p"), (2, long, "*", 1, 2.0, "p"), (None, "c d", None, 1, 2.0, "p"), (3, None, "y", 1, 2.0, "p")]
    df = spark.createDataFrame(data, "doc_id long, text string, topic_class string, tokens int, u double, row string")
    out = mixing.mix(df).collect()
    assert len(out) == 5 and {r["source_class"] for r in out} == {"*"} and out[0]["row"]["u"] == 2.0
    assert {r["tokens"] for r in out if r["row"]["doc_id"] == 2} == {600_000}
    assert len({(r["sampled"], r["probability"]) for r in out if r["row"]["doc_id"] == 1}) == 1


def test_sampled_tokens_follow_the_targets(spark):
    n = 20000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") % 3 == 0, "src0").otherwise("x").alias("source"), F.when(F.col("id") % 10 < 7, "en").otherwise("fr").alias("lang"), F.lit("k").alias("row"), F.lit(1).alias("tokens"))
    targets = {"source": {"src0": 0.5}, "lang": {"en": 0.4, "fr": 0.6}}
    out = mixing.mix(df, targets, budget=0.3, classes={"source": F.col("source"), "lang": F.col("lang")})
    assert out.count() == n and out.select("row.row").first()[0] == "k"
    kept = out.filter("sampled")
    got = {(r[0], r[1]): r[2] for r in kept.groupBy("source_class", "lang_class").agg(F.sum("tokens")).collect()}
    total = sum(got.values())
    assert abs(total / (4 * n) - 0.3) < 0.02
    assert abs(sum(v for (s, _), v in got.items() if s == "src0") / total - 0.5) < 0.03
    assert abs(sum(v for (_, g), v in got.items() if g == "fr") / total - 0.6) < 0.03
    assert sorted(r[0] for r in kept.select("row.doc_id").collect()) == sorted(r[0] for r in out.repartition(7).filter("sampled").select("row.doc_id").collect())


def test_odd_rows(odd, none):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    assert {r["tokens"] for r in out if not (r["row"]["text"] or "").strip()} == {0}
    assert all(r["source_class"] == "*" and r["lang_class"] == "*" for r in out)
    assert all((r["topic_class"] == "*") == (r["tokens"] == 0) for r in out if r["topic_class"] == "*" or r["tokens"] == 0)
    assert mixing.mix(none).count() == 0
    assert all(r["sampled"] for r in mixing.mix(odd.filter("doc_id < 4")).collect())  # no tokens at all


def test_other_languages_and_null_are_drawn_too(spark):
    lang = F.element_at(F.array(*map(F.lit, ["en", "en", "fr", "de", "es", "it"]), F.lit(None).cast("string"), F.lit("en")), (F.col("id") % 8 + 1).cast("int"))
    df = spark.range(16000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.concat(F.lit("src"), F.col("id") % 3).alias("source"), lang.alias("lang"))
    out = mixing.mix(df)
    kept = {r[0]: r[1] for r in out.filter("sampled").groupBy("row.lang").count().collect()}
    assert kept["it"] > 100 and kept[None] > 100
    total = sum(kept.values())
    assert abs((kept["it"] + kept[None]) / total - 0.25) < 0.02  # as observed
    assert abs(kept["fr"] / (total - kept["it"] - kept[None]) - 0.2) < 0.02  # among the named as targeted
    assert {r["probability"] > 0 for r in out.select("probability").distinct().collect()} == {True}


def test_without_others_the_targets_hold():
    assert np.allclose(mixing.with_other([0.5, 0.2, 0.3], 0.0), [0.5, 0.2, 0.3, 0])
    assert np.allclose(mixing.with_other([0.2], 0.9), [0.2, 0.8])
    assert np.allclose(mixing.with_other([0.6, 0.4], 0.5), [0.3, 0.2, 0.5])

def test_topics_are_fitted_on_every_document(spark):
    """A kind of text outside any sample of 2,000 moves the centres; partitions and order do not."""
    text = F.when(F.col("id") % 50 == 0, "id 12345 99 1234567").when(F.col("id") % 2 == 0, "a | b | 1 | 22 |").otherwise("plain words in a row")
    df = spark.range(6000).select(text.alias("text"), ((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 1) / float(1 << 30)).alias("u"))
    rows = df.select(mixing.shapes_and_tokens(F.col("text"))["shapes"].alias("shapes"), "text", "u")
    centres = mixing.fit_topics(rows)
    assert np.allclose(centres, mixing.fit_topics(rows.repartition(7)), rtol=0, atol=0)
    told = rows.select("text", mixing.topic_of(centres)("shapes").alias("t")).distinct().collect()
    assert len(told) == 3 and len({r["t"] for r in told}) == 3
    x, n = mixing.shape_counts([r["text"] for r in told])
    assert np.allclose(mixing.unpacked(mixing.packed(x)) / (1 << 24), mixing._unit(x), atol=1e-7)
