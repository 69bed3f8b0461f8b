"""Telephony audio columns: G.711 by look-up tables, IMA ADPCM by blocks, resampled PCM.

``store`` writes each row's bytes as the data of a RIFF file, kept as a binary column of a
written table: mu-law or A-law samples, or ADPCM blocks, as a checksum of the bytes deals
them (or all in one codec). ``decode`` reads the files back: mu-law and A-law samples expand
through 256-entry tables, ADPCM runs nibble by nibble over all blocks of a batch at once;
the signal is resampled. ``store_pcm`` writes that PCM as a column of its own and
``read_pcm`` reads it back. In that column samples stand as a lossless lifting step (as in
reversible wavelets): those at even places, then by how much each odd one misses the mean
of its neighbours. All arithmetic is on integers, so equal bytes give equal values wherever
they are decoded.

Bytes are padded with 255 to a positive multiple of ``unit``; 255 is no UTF-8 byte, so the
unpadded length is read back from the samples. Nulls: null text is the empty text (one
unit of padding); null ids are carried. Repeated rows give a file each. Empty input gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialise, project

#: Compression of the written tables.
STORED = {"level": 12, "page": 1 << 22}
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17}
# Fixed values of the IMA ADPCM standard.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 0x84) << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    e, m = a >> 4 & 7, (a & 15) << 4
    size = np.where(e == 0, m + 8, (m + 0x108) << np.maximum(e - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the prediction, and next step index times 16, by step index times 16 plus nibble."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = STEPS[index]
    size = (step >> 3) + (nibble >> 2 & 1) * step + (nibble >> 1 & 1) * (step >> 1) + (nibble & 1) * (step >> 2)
    return np.where(nibble & 8, -size, size).astype(np.int32), (np.clip(index + MOVES[nibble & 7], 0, 88) * 16).astype(np.int32)


CHANGE, NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (size - 4)) of mono IMA ADPCM blocks (blocks, size) of bytes."""
    n, size = blocks.shape
    now = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = now
    for j, byte in enumerate(data):
        for half in (0, 1):
            key = at + (byte >> 4 if half else byte & 15)
            now += CHANGE[key]
            np.clip(now, -32768, 32767, out=now)
            at = NEXT[key]
            out[1 + 2 * j + half] = now
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers, rounded down; the last sample holds."""
    if rate == to or not pcm.size:
        return pcm
    at = np.arange(pcm.size * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    x = pcm.astype(np.int64)
    after = x[np.minimum(i + 1, x.size - 1)]
    return (x[i] + (after - x[i]) * part // to).astype(np.int16)


def lift(pcm: np.ndarray) -> bytes:
    """16-bit samples as a lifting step: even places, then the odd ones less the mean of their neighbours."""
    even, odd = pcm[::2].astype(np.int32), pcm[1::2].astype(np.int32)
    after = np.append(even[1:], even[-1:])[: odd.size]
    return even.astype("<i2").tobytes() + (odd - (even[: odd.size] + after >> 1)).astype("<i2").tobytes()


def unlift(raw: bytes) -> np.ndarray:
    """The samples of ``lift``."""
    both = np.frombuffer(raw, "<i2")
    even, miss = both[: (both.size + 1) // 2].astype(np.int32), both[(both.size + 1) // 2 :]
    out = np.empty(both.size, np.int16)
    out[::2] = even
    out[1::2] = (miss + (even[: miss.size] + np.append(even[1:], even[-1:])[: miss.size] >> 1)).astype(np.int16)
    return out


def riff(samples: bytes, codec: str, rate: int, block: int = 1) -> bytes:
    """A RIFF/WAVE file of one channel."""
    bits = {"pcm": 16, "adpcm": 4}.get(codec, 8)
    per_block = 1 + 2 * (block - 4) if codec == "adpcm" else 1
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * block // per_block, block, bits) + extra
    fact = struct.pack("<I", len(samples) // block * per_block)
    body = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in ((b"fmt ", head), (b"fact", fact), (b"data", samples)))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and stored sample bytes of a file by ``riff``."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        n = struct.unpack_from("<I", media, at + 4)[0]
        chunks[media[at : at + 4]] = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", chunks[b"fmt "])
    return {v: k for k, v in TAGS.items()}[tag], rate, block, chunks[b"data"]


def samples_of(codec: str, raw: bytes, block: int) -> np.ndarray:
    if codec == "adpcm":
        return decode_adpcm(np.frombuffer(raw, np.uint8).reshape(-1, block)).ravel()
    x = np.frombuffer(raw, np.uint8)
    return MULAW[x] if codec == "mulaw" else ALAW[x] if codec == "alaw" else np.frombuffer(raw, "<i2")


#: The codecs that a checksum deals payloads to.
DEALT = ("mulaw", "alaw", "adpcm")


def store(docs: DataFrame, *, codec: str | None = None, rate: int = 8000, unit: int = 576, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: a written table of files that hold each text's padded UTF-8 bytes as samples.

    ``codec`` is that of every file; None deals each payload by its checksum, equal ones alike.
    """

    def file(raw: bytes) -> bytes:
        payload = raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))
        kind = codec or DEALT[zlib.crc32(payload) % len(DEALT)]
        return riff(payload, kind, rate, unit if kind == "adpcm" else 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                b = batch.slice(a, 200)
                media = [file((t or "").encode()) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return materialise(project(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, media binary"), "media", **STORED)


def decode(media: DataFrame, *, to: int = 16000, most_bytes: int = 1 << 21) -> DataFrame:
    """doc_id, media, payload (stored samples), n_bytes (unpadded), pcm (16-bit at ``to`` Hz, lifted) and features.

    Features: the codec, and mean size and sign changes of its signal. ``most_bytes`` of
    samples are decoded together (a longer file alone), the ADPCM blocks of all files at once.
    """

    def digest(ids: list, files: list[bytes]) -> pa.RecordBatch:
        parsed = [parse(m) for m in files]
        signal: dict[int, np.ndarray] = {}
        for size in sorted({block for codec, _, block, _ in parsed if codec == "adpcm"}):
            at = [k for k, p in enumerate(parsed) if p[0] == "adpcm" and p[2] == size]
            blocks = np.frombuffer(b"".join([parsed[k][3] for k in at]), np.uint8).reshape(-1, size)
            ends = np.cumsum([len(parsed[k][3]) // size for k in at])[:-1]
            signal.update(zip(at, (x.ravel() for x in np.split(decode_adpcm(blocks), ends)), strict=True))
        pcm, said = [], []
        for k, (codec, rate, block, raw) in enumerate(parsed):
            x = signal.pop(k) if k in signal else samples_of(codec, raw, block)
            turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            said.append(f"{codec}={int(np.abs(x.astype(np.int64)).sum()) // max(1, x.size)},{turns}")
            pcm.append(lift(resample(x, rate, to)))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(files, pa.binary()), pa.array([p[3] for p in parsed], pa.binary()), pa.array([len(p[3].rstrip(b"\xff")) for p in parsed], pa.int64()), pa.array(pcm, pa.binary()), pa.array(said, pa.string())],
            names=["doc_id", "media", "payload", "n_bytes", "pcm", "features"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, size = [], [], 0
            for doc, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if files and size + len(m.as_buffer()) > most_bytes:
                    yield digest(ids, files)
                    ids, files, size = [], [], 0
                ids.append(doc)
                files.append(m.as_py())
                size += len(files[-1])
            if files:
                yield digest(ids, files)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, payload binary, n_bytes long, pcm binary, features string")


def store_pcm(decoded: DataFrame) -> DataFrame:
    """The rows of ``decode`` (or some of its columns with pcm) as a written table; ``read_pcm`` gives the samples."""
    return materialise(decoded, "pcm", **STORED)


def read_pcm(stored: DataFrame) -> DataFrame:
    """The rows of ``store_pcm`` with ``pcm`` as plain little-endian 16-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("pcm")
            for a in range(0, batch.num_rows, 200):
                b = batch.slice(a, 200)
                plain = [unlift(x.as_buffer()).astype("<i2").tobytes() for x in b.column(at)]
                yield b.set_column(at, "pcm", pa.array(plain, pa.binary()))

    return stored.mapInArrow(run, stored.schema)
