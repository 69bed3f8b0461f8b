import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trackloom.llm import huffman, packing, queries
from trackloom.llm.tokens import PieceEncoder

BITS = [" ", "  ", "\n", " \n", "\t", "a", "B.", "'s", "é", "́", "1", "<|endoftext|>", "\x01", "\x1c", "　", "!", "中", "Σ", " word,", "\x85", "​", "😀", "..."]


def direct(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name, sf_rows):
    rnd = random.Random(1)
    texts = [r["text"] or "" for r in sf_rows] + ["".join(rnd.choices(BITS, k=rnd.randint(0, 30))) for _ in range(2000)] + ["", " ", "x" * 3000]
    enc = PieceEncoder(public_tokenizers.path(name))
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode_many(texts)] == direct(name, texts)


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark, sf_rows, odd, none):
    want, at = {}, 0
    for r, ids in sorted(zip(sf_rows, direct("byte_bpe_50k.json", [r["text"] or "" for r in sf_rows]), strict=True), key=lambda x: x[0]["doc_id"]):
        want[r["doc_id"]] = (at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1
    got = queries.op4_huffman_tokens(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got} == want
    rows = odd.collect()
    path = huffman.write(odd, public_tokenizers.path("byte_bpe_50k.json"), block_ids=8, interval=4)
    back = huffman.read(spark, path).collect()
    ids = direct("byte_bpe_50k.json", [r["text"] or "" for r in rows])
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in back), key=key) == sorted(((r["doc_id"], [*i, 2]) for r, i in zip(rows, ids, strict=True)), key=key)
    order = sorted(back, key=lambda r: r["start"])
    assert order[0]["doc_id"] is None and [r["doc_id"] for r in order[1:]] == sorted(r["doc_id"] for r in order[1:])
    assert [r["start"] for r in order] == np.cumsum([0, *(len(r["ids"]) // 4 for r in order)])[:-1].tolist()
    assert huffman.read(spark, huffman.write(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_files_ascend(spark, tmp_path):
    """Blocks in order of file names have rising places, whatever the order of the rows."""
    from pathlib import Path

    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(7, "lang", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = huffman.write(docs, public_tokenizers.path("byte_bpe_50k.json"), path=f"file://{tmp_path}/out", block_ids=5000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(tmp_path, "out", "blocks").glob("part-*.parquet"))
    first = dict(spark.read.parquet(f"{path}/parts").collect())
    book = {r["token"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}
    lengths = np.zeros(max(book) + 1, np.uint8)
    lengths[list(book)] = list(book.values())
    book, at, ids, blocks = huffman.Codebook(lengths), 0, [], 0
    for f in files:
        for r in pq.read_table(f).to_pylist():
            assert first[r["part"]] + r["at"] == at
            ids += huffman.read_block(book, r["block"])[0]
            at, blocks = at + r["n_ids"], blocks + 1
    assert len(files) > 1 and blocks > 2 * len(files)
    assert ids == sorted(r[0] for r in docs.select("doc_id").collect())


def test_long_and_repeated_documents(spark):
    text = "some words 123 and <|endoftext|> more, " * 30_000
    df = spark.createDataFrame([(3, text), (3, text), (1, None), (2, "")], "doc_id long, text string")
    want = direct("byte_bpe_50k.json", [text])[0]
    back = huffman.read(spark, huffman.write(df, public_tokenizers.path("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], len(r["ids"]) // 4) for r in back] == [(1, 0, 1), (2, 1, 1), (3, 2, len(want) + 1), (3, 3 + len(want), len(want) + 1)]
    assert np.frombuffer(back[3]["ids"], "<u4").tolist() == [*want, 2]


def test_code_lengths():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 300, 5000):
        counts = rng.integers(1, 50, n) ** 4
        lengths = huffman.code_lengths(counts, 14)
        assert lengths.max(initial=0) <= 14
        if n > 1:
            assert abs(sum(2.0 ** -lengths.astype(float)) - 1) < 1e-12
            entropy = -(counts / counts.sum() * np.log2(counts / counts.sum())).sum()
            assert entropy <= (counts * lengths).sum() / counts.sum() < entropy + 1.1
        book = huffman.Codebook(lengths)
        ids = rng.integers(0, n, 1000) if n else np.zeros(0, int)
        bits, offsets = book.encode(ids, 64)
        assert book.decode(bits, ids.size, offsets, 64).tolist() == ids.tolist()


def test_best_limited_lengths_by_hand():
    assert huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16]), 3).tolist() in ([3, 3, 3, 3, 2, 2], [3, 3, 3, 3, 2, 2])
    assert huffman.code_lengths(np.array([0, 5, 0, 5])).tolist() == [0, 1, 0, 1]


def packed(rows, out, window=2048):
    ids = dict(enumerate(direct("word_bpe_49k.json", [r["text"] or "" for r in rows])))
    seqs, docs = {}, {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    for doc, pieces in docs.items():
        wanted = [[*ids[k], 1] for k, r in enumerate(rows) if r["doc_id"] == doc]
        got = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(pieces, key=lambda p: p["start"])])
        if len(wanted) == 1:
            assert got.tolist() == wanted[0]
            assert [p["start"] for p in sorted(pieces, key=lambda p: p["start"])] == np.cumsum([0, *(p["length"] for p in sorted(pieces, key=lambda p: p["start"]))])[:-1].tolist()
        assert sorted(got.tolist()) == sorted(x for w in wanted for x in w)
        assert {p["doc_tokens"] for p in pieces} == {len(w) for w in wanted}
    assert set(docs) == {r["doc_id"] for r in rows}
    return padding


def test_packing(spark, sf_docs, sf_rows, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packed(sf_rows, packing.pack(sf_docs, path).collect()) == 0
    assert packed(odd.collect(), packing.pack(odd, path, window=16, pooled=64).collect(), 16) == 0
    assert packing.pack(none, path).count() == 0


def test_nearly_all_is_placed_by_level(spark, monkeypatch):
    """In 32 partitions of sf0.1 over 95 % of the ids beyond full windows are closed by choice of level, none padded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    out = packing.pack(docs.repartition(32), path).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    fill, pieces = {}, {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill.values())
    rest = sum(p[0]["doc_tokens"] % 2048 for p in pieces.values())
    # a remainder placed by level is one piece, from a multiple of 2048 to the document's end
    whole = sum(r["length"] for r in out if r["length"] < 2048 and r["start"] % 2048 == 0 and r["start"] + r["length"] == r["doc_tokens"] and fill[r["sequence_id"]] == 2048)
    assert len(pieces) == 10_000 and whole > 0.95 * rest


def test_very_long_and_repeated_documents_are_packed(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame([(1, "some words 12 " * 100_000), (2, "tie"), (2, "tie"), (3, None)], "doc_id long, text string")
    assert packed(df.collect(), packing.pack(df, path).collect()) == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(32)
    for size in rng.integers(1, 32, 500).tolist():
        best = {}
        for h in range(33 - size):
            if h and not p.levels[h]:
                continue
            after = p.levels.copy()
            after[h] -= h > 0
            if h + size < 32:
                after[h + size] += 1
            best[h] = int((after**2).sum())
        h = p.level_for(size)
        assert best[h] == min(best.values()) and h == max(k for k, v in best.items() if v == best[h])
        p._place((0, 0, np.zeros(size, np.uint32), size))
    p.again()
    p.drain()
    assert sum(x[2].size for _, pieces in p.take() for x in pieces) > 0
