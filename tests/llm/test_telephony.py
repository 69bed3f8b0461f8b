import hashlib
import zlib

import numpy as np

from trackloom.llm import queries, telephony


def test_tables():
    # ITU-T G.711: the quietest and loudest codes
    assert telephony.MULAW[[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert telephony.ALAW[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(telephony.ALAW.tolist())) == 256 and len(set(telephony.MULAW.tolist())) == 255


def adpcm_by_hand(block):
    now = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(88, block[2]), [int.from_bytes(block[:2], "little", signed=True)]
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            d = step >> 3
            d += step if n & 4 else 0
            d += step >> 1 if n & 2 else 0
            d += step >> 2 if n & 1 else 0
            now = max(-32768, min(32767, now - d if n & 8 else now + d))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][n & 7]))
            out.append(now)
    return out


def test_adpcm_blocks():
    blocks = np.random.default_rng(0).integers(0, 256, (7, 64)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm_by_hand(bytes(b)) for b in blocks]


def test_resample():
    x = np.array([0, 100, -100, 32767, -32768], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768, -32768]
    assert telephony.resample(x, 8000, 4000).tolist() == [0, -100]
    assert telephony.resample(x, 8000, 8000).tolist() == x.tolist()


def expect(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
    return raw, payload


def test_query(spark, sf_rows):
    got = {r["doc_id"]: r for r in queries.op9_telephony(spark, "/root/testdata/sf0.001").collect()}
    for r in sf_rows:
        raw, payload = expect(r["text"])
        codec = telephony.DEALT[zlib.crc32(payload) % 3]
        g, media = got[r["doc_id"]], telephony.riff(payload, codec, 8000, 576 if codec == "adpcm" else 1)
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_odd_rows_and_codecs(odd, none):
    rows = sorted(((r["doc_id"] or 0), r["text"] or "") for r in odd.collect())
    for codec in ("mulaw", "alaw", "adpcm"):
        out = telephony.decode(telephony.store(odd, codec=codec), most_bytes=1000).collect()
        assert sorted(((r["doc_id"] or 0), bytes(r["payload"][: r["n_bytes"]]).decode()) for r in out) == rows
        for r in out:
            kind, rate, block, raw = telephony.parse(bytes(r["media"]))
            assert (kind, rate, raw) == (codec, 8000, bytes(r["payload"])) and r["features"].startswith(codec)
            x = telephony.samples_of(kind, raw, block)
            assert telephony.unlift(bytes(r["pcm"])).tolist() == telephony.resample(x, 8000, 16000).tolist()
    same = [r["features"] for r in telephony.decode(telephony.store(odd)).collect() if r["doc_id"] == 5]
    assert len(same) == 2 and len(set(same)) == 1
    assert telephony.decode(telephony.store(none)).count() == 0
    assert telephony.read_pcm(telephony.store_pcm(telephony.decode(telephony.store(none)))).count() == 0


def test_very_long_text(spark):
    text = "one long line 0123456789 " * 200_000
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    a, b = telephony.read_pcm(telephony.store_pcm(telephony.decode(telephony.store(df)))).orderBy("doc_id").collect()
    assert bytes(a["payload"][: a["n_bytes"]]).decode() == text and a["pcm"] == b["pcm"]


def test_lifting_is_lossless():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 1000, 1001):
        x = rng.integers(-32768, 32768, n).astype(np.int16)
        assert telephony.unlift(telephony.lift(x)).tolist() == x.tolist()
        assert len(telephony.lift(x)) == 2 * n


def test_resampled_pcm_is_stored(spark, sf_rows):
    from pathlib import Path

    from trackloom.work import work_dir

    top = Path(work_dir(spark).removeprefix("file://"))
    before = set(top.glob("pcm-*"))
    got = {r["doc_id"]: r["feature"] for r in queries.op9_telephony(spark, "/root/testdata/sf0.001").collect()}
    (path,) = set(top.glob("pcm-*")) - before
    stored = {r["doc_id"]: r["pcm"] for r in spark.read.parquet(str(path)).collect()}
    assert stored.keys() == got.keys() == {r["doc_id"] for r in sf_rows}
    for r in sf_rows:
        raw = (r["text"] or "").encode()
        raw += b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        codec = telephony.DEALT[zlib.crc32(raw) % 3]
        want = telephony.resample(telephony.samples_of(codec, raw, 576), 8000, 16000).astype("<i2").tobytes()
        assert telephony.unlift(bytes(stored[r["doc_id"]])).astype("<i2").tobytes() == want
        assert got[r["doc_id"]].endswith(f";pcm={zlib.crc32(stored[r['doc_id']]):08x}")
