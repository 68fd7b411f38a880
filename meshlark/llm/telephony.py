"""Media columns, telephony audio: mu-law and A-law by lookup tables, ADPCM blocks, resampled PCM.

A payload of bytes is stored as a RIFF/WAVE file of 8-bit mu-law samples (8 kHz, one channel): bytes of the container
after its header are the payload, so storing loses nothing.  Reading parses the container again.  The same bytes are
expanded to 16-bit PCM as mu-law and as A-law by 256-entry tables made from the codec's rule, and decoded as IMA ADPCM
in blocks of 64 bytes (header: predictor, index; then 120 nibbles), all blocks of a chunk at once: numpy steps along a
block, across blocks.  The mu-law PCM is resampled to 16 kHz and kept as 16-bit little-endian bytes.

A row's payload is decoded in chunks of whole blocks.  Texts are taken in portions of bounded bytes; beyond that a row
holds its payload and stored file, and its PCM, of four times the payload, only where the stored files are kept.

Cases: a null text is an empty one, whose payload is 64 zero bytes.  Equal texts give equal values.  Repeated rows are
kept.  Output columns replace others of their names in the query; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meshlark.llm._common import portions, table

BLOCK = 64
RATE = 8000
CHUNK = 1 << 18
#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, high = (code & 15) << 4, code >> 4 & 7
    size = np.where(high == 0, low + 8, low + 264 << np.maximum(high - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


# The step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
# How a nibble moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + nibble: the change of the predictor and the next index times 16."""
    nibble = np.arange(16)
    step = STEPS[:, None]
    change = step // 8 + np.where(nibble & 1, step // 4, 0) + np.where(nibble & 2, step // 2, 0) + np.where(nibble & 4, step, 0)
    change = np.where(nibble & 8, -change, change)
    after = np.clip(np.arange(len(STEPS))[:, None] + MOVES[nibble & 7], 0, len(STEPS) - 1) * 16
    return change.reshape(-1).astype(np.int32), after.reshape(-1).astype(np.int32)


CHANGE, AFTER = _adpcm_tables()


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """16-bit samples of whole blocks, a row a block: the header's predictor, then 120 decoded nibbles."""
    blocks = data.reshape(-1, BLOCK)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1) * 16
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for j, byte in enumerate(codes):
        for k, nibble in enumerate((byte & 15, byte >> 4)):
            code = at + nibble
            value += CHANGE[code]
            np.clip(value, -32768, 32767, out=value)
            at = AFTER[code]
            out[1 + 2 * j + k] = value
    return out.T


def resample_double(pcm: np.ndarray, before: int = 0) -> np.ndarray:
    """Twice the samples: each after the midpoint to the one before it (before: the sample ahead of the first)."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[1::2] = pcm
    out[2::2] = (wide[:-1] + wide[1:]) >> 1
    if len(pcm):
        out[0] = (before + int(wide[0])) >> 1
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with zeros up to a positive multiple of a block, and their number without."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK), len(raw)


def store_wav(samples: bytes, tag: int = MULAW, rate: int = RATE, bits: int = 8) -> bytes:
    align = bits // 8
    head = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    pad = b"\0" * (len(samples) % 2)
    size = 4 + 8 + len(head) + 8 + len(samples) + len(pad)
    return b"".join((b"RIFF", struct.pack("<I", size), b"WAVEfmt ", struct.pack("<I", len(head)), head, b"data", struct.pack("<I", len(samples)), samples, pad))


def read_wav(stored: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and sample bytes of a stored file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            if tag is None or at + 8 + size > len(stored):
                raise ValueError("broken WAVE file")
            return tag, rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in WAVE file")


def _digest(n: int, mulaw: int, alaw: int, adpcm: int, peak: int, crossings: int, crc: int, pcm_crc: int, pcm: bytes | None) -> tuple[str, bytes | None]:
    digest = (
        f"samples={n};mulaw_power={mulaw // n};alaw_power={alaw // n};adpcm_power={adpcm // (121 * (n // BLOCK))};"
        f"peak={peak};crossings={crossings};adpcm_crc32={crc:08x};pcm16k_crc32={pcm_crc:08x}"
    )
    return digest, None if pcm is None else store_wav(pcm, PCM, 2 * RATE, 16)


def features(payload: bytes, keep: bool = True) -> tuple[str, bytes | None]:
    """A digest of all decodings, and, if kept, the resampled PCM (16 kHz, 16 bits) as a stored file, chunk by chunk."""
    data = np.frombuffer(payload, np.uint8)
    power, crossings, peak, crc, pcm_crc, before, pcm = np.zeros(3, np.int64), 0, 0, 0, 0, 0, []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        mu, ad = MULAW_PCM[part], decode_adpcm(part)
        power += [_power(x.ravel()) for x in (mu, ALAW_PCM[part], ad)]
        sign = mu < 0
        crossings += int(np.count_nonzero(sign[1:] != sign[:-1])) + bool(at and (before < 0) != sign[0])
        peak = max(peak, int(np.abs(mu.astype(np.int32)).max()))
        crc = zlib.crc32(ad.astype("<i2").tobytes(), crc)
        part_pcm = resample_double(mu, before).astype("<i2").tobytes()
        pcm_crc = zlib.crc32(part_pcm, pcm_crc)
        if keep:
            pcm.append(part_pcm)
        before = int(mu[-1])
    return _digest(len(data), *map(int, power), peak, crossings, crc, pcm_crc, b"".join(pcm) if keep else None)


def _power(x: np.ndarray) -> int:
    return int(np.square(x.astype(np.int64)).sum())


def features_together(payloads: list[bytes], keep: bool = True) -> list[tuple[str, bytes | None]]:
    """features of each payload, decoded on end: their blocks and samples don't depend on each other."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(x) for x in payloads])
    starts = ends - [len(x) for x in payloads]
    mu, al = MULAW_PCM[data], ALAW_PCM[data]
    ad = np.ascontiguousarray(decode_adpcm(data).astype("<i2"))
    squares = lambda x: np.square(x.astype(np.int64))
    power = [np.add.reduceat(squares(mu), starts), np.add.reduceat(squares(al), starts), np.add.reduceat(squares(ad).sum(axis=1), starts // BLOCK)]
    changes = np.zeros(len(data), np.int64)
    changes[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    changes[starts] = 0
    crossings = np.add.reduceat(changes, starts)
    peak = np.maximum.reduceat(np.abs(mu.astype(np.int32)), starts)
    pcm = resample_double(mu)
    pcm[2 * starts] = mu[starts] >> 1
    pcm = pcm.astype("<i2").tobytes()
    return [
        _digest(e - s, *(int(x[i]) for x in power), int(peak[i]), int(crossings[i]), zlib.crc32(ad[s // BLOCK : e // BLOCK]), zlib.crc32(pcm[4 * s : 4 * e]), pcm[4 * s : 4 * e] if keep else None)
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))
    ]


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = COLUMNS + ", media binary, pcm binary"


def media_rows(texts: list[str | None], keep: bool = True) -> list[tuple]:
    """The columns of MEDIA of each text; without keep the stored files are left out (null)."""
    held = []
    for text in texts:
        payload, n = payload_of(text)
        stored = store_wav(payload)
        tag, rate, back = read_wav(stored)
        if tag != MULAW or rate != RATE:
            raise ValueError("a stored file changed its format")
        held.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), stored if keep else None, back))
    found: list = []
    group: list[bytes] = []
    for *_, back in [*held, (b"",)]:
        if group and (not back or sum(map(len, group)) + len(back) > CHUNK):
            found += features_together(group, keep)
            group = []
        if len(back) > CHUNK:
            found.append(features(back, keep))
        elif back:
            group.append(back)
    return [(*x[:6], digest, x[6], pcm) for x, (digest, pcm) in zip(held, found, strict=True)]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """(key, the columns of MEDIA), or of COLUMNS if the stored files aren't to be kept."""
    width = 9 if keep_media else 7
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1, 128):
                rows = [x[:width] for x in media_rows(part.column(1).to_pylist(), keep_media)]
                names = [c.split()[0] for c in MEDIA.split(", ")[:width]]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(x)) for x in zip(*rows, strict=True)]], [key, *names])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {MEDIA if keep_media else COLUMNS}")


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_media=False)


QUERIES = {"op5_telephony_audio": op5_telephony_audio}
ORACLES: dict[str, str] = {}
