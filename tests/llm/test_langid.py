import numpy as np
import regex

from trackloom.llm import langid, queries


def test_held_out_accuracy(spark, sf_rows):
    got = {r["doc_id"]: r for r in queries.op5_bigru_language(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(sf_rows)
    held = [(got[r["doc_id"]]["lang_pred"], r["lang"]) for r in sf_rows if got[r["doc_id"]]["held_out"] and regex.search(r"\p{L}", r["text"] or "")]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def small(langs=("aa", "bb")):
    return langid.BiGRU(list(langs), 4)


def test_gradients():
    m = small()
    rng = np.random.default_rng(0)
    seq, y = rng.integers(97, 100, (5, 3)).astype(np.uint8), np.array([0, 1, 1])
    for c in (m.ahead, m.back):
        c.x, c.zr, c.n = (w.astype(np.float64) for w in (c.x, c.zr, c.n))

    def loss():
        return -np.log(m._pass(seq)[0][:, np.arange(3), y]).mean()

    p, both, kf, kb = m._pass(seq)
    p[:, np.arange(3), y] -= 1
    d = (p / 15) @ m.out.T
    grads = m.ahead.backward(seq, kf, d[:, :, :4])
    for w, g in zip((m.ahead.x, m.ahead.zr, m.ahead.n), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - g[at]) < 2e-3 + 0.05 * abs(g[at])
        w[at] += 1e-3


def test_every_position_counts_once():
    m, texts = small(), [b"abc", b"x" * 100, bytes(range(65, 91)) * 30]
    got = m.pooled(texts, window=16, warm=4, lanes=3)
    for t, p in zip(texts, got, strict=True):
        want = np.zeros(2)
        for a in range(0, len(t), 16):
            seq = np.frombuffer((b"\n" * 4 + t + b"\n" * 40)[a : a + 24], np.uint8)[:, None]
            want += m.labels(seq)[4 : 4 + min(16, len(t) - a), 0].sum(axis=0)
        assert np.allclose(p, want / len(t), atol=1e-5)


def test_odd_rows(spark, odd, none):
    got = langid.predict(odd, small()).collect()
    rows = {(r["doc_id"], r["text"]) for r in odd.collect()}
    und = {i for i, t in rows if not t or not regex.search(r"\p{L}", t)}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == und
    assert len(got) == odd.count()
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(odd, None).collect()} == {("und", 0.0)}
    assert langid.predict(none, small()).count() == 0
    assert langid.train(none) is None and langid.train(odd) is None  # no labels


def test_one_language(spark):
    df = spark.createDataFrame([(1, "only one", "xx"), (2, None, "xx"), (3, "other", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in langid.predict(df, langid.train(df, steps=2)).collect()}
    assert got == {1: ("xx", 1.0), 2: ("und", 0.0), 3: ("xx", 1.0)}


def test_very_long_text_and_many_labels(spark):
    """More than 64 labels are learned, and a text of megabytes is labelled whole."""
    rows = [(i, f"{chr(97 + i % 26)}{i % 70} " * 40, f"l{i % 70}") for i in range(140)]
    df = spark.createDataFrame([*rows, (999, "only one long text " * 150_000, None)], "doc_id long, text string, lang string")
    model = langid.train(df, steps=2, per_lang=2)
    assert len(model.langs) == 70
    assert langid.predict(df.filter("doc_id = 999"), model).first()["score"] > 0
