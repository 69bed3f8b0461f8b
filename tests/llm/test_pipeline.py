import corpus_pipeline
from trackloom.llm import sanitise, simhash

from .test_simhash import similarity


def test_stages(spark, sf_docs, sf_rows):
    docs, seen = sf_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = {name: [r.asDict() for r in df.collect()] for name, df in seen.items()}
    text = {r["doc_id"]: r["text"] for r in sf_rows}
    first = rows["language"]
    assert {r["doc_id"] for r in first} >= {i for i, t in text.items() if t and len(t) > 100 and sum(c.isalpha() for c in t) > 0.6 * len(t)}
    classes = {r["doc_id"] for r in rows["near_duplicates"]}
    similar = {(a["doc_id"], b["doc_id"]) for i, a in enumerate(first) for b in first[:i] if similarity(a["text"], b["text"]) >= 0.8}
    linked = {(a["doc_id"], b["doc_id"]) for i, a in enumerate(first) for b in first[:i] if similarity(a["text"], b["text"]) >= 0.5}
    assert len(similar) > 10 and sum(a in classes and b in classes for a, b in similar) <= 0.1 * len(similar)
    assert {r["doc_id"] for r in first} - classes <= {i for pair in linked for i in pair}  # clean documents stay
    assert {r["doc_id"] for r in rows["personal_data"]} == classes
    for r in rows["personal_data"]:
        assert not sanitise.base_spans(r["text"]) or sanitise.base_spans(text[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
        if not sanitise.base_spans(text[r["doc_id"]]):
            assert r["text"] == text[r["doc_id"]]
    kept = {r["doc_id"] for r in rows["mixing"]}
    assert kept < classes and len(kept) > 0.1 * len(classes)
    assert {r["doc_id"] for r in rows["packing"]} == kept
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["doc_tokens"]) for r in df.collect())
    assert sum(x[2] for x in key(again)) == sum(x[2] for x in key(seen["packing"]))


def test_odd_rows(spark, odd, none):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for df in (docs, none.select(*corpus_pipeline.COLUMNS)):
        assert corpus_pipeline.personal_data(spark, df, "").count() == df.count()
        assert corpus_pipeline.mixture(spark, df, "").columns == corpus_pipeline.COLUMNS
        corpus_pipeline.language(spark, df, "").collect()
        corpus_pipeline.sequences(spark, df, "").collect()
    assert simhash.representatives(none).count() == 0
