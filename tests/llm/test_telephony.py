import hashlib
import zlib

import numpy as np

from meshlark.llm import telephony as T


def mulaw(b):
    b = ~b & 255
    x = ((b & 15) * 2 + 33 << (b >> 4 & 7)) - 33
    return -4 * x if b & 128 else 4 * x


def adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(T.STEPS[index])
            d = step // 8 + (step // 4 if nibble & 1 else 0) + (step // 2 if nibble & 2 else 0) + (step if nibble & 4 else 0)
            value = max(-32768, min(32767, value - d if nibble & 8 else value + d))
            index = max(0, min(88, index + int(T.MOVES[nibble & 7])))
            out.append(value)
    return out


def test_tables():
    assert T.MULAW_PCM.tolist() == [mulaw(b) for b in range(256)]
    assert sorted(T.ALAW_PCM.tolist()) == sorted(-x for x in T.ALAW_PCM.tolist()) and len(set(T.ALAW_PCM.tolist())) == 256
    assert T.ALAW_PCM[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def test_blocks_at_once_equal_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, 64 * 50, dtype=np.uint8)
    assert T.decode_adpcm(data).tolist() == [adpcm(data[i : i + 64].tobytes()) for i in range(0, len(data), 64)]


def test_rows(awkward, nothing, clashing):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    rows = T.encode(clashing(awkward)).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert T.read_wav(r["media"]) == (T.MULAW, 8000, payload)
        tag, rate, pcm = T.read_wav(r["pcm"])
        assert (tag, rate) == (T.PCM, 16000) and np.frombuffer(pcm, "<i2")[1::2].tolist() == [mulaw(b) for b in payload]
    assert T.encode(nothing).count() == 0


def test_chunks_and_groups_agree(monkeypatch):
    texts = ["a" * 1000, None, "hello", "wörld " * 500, "a" * 1000]
    whole = T.media_rows(texts)
    assert whole[0] == whole[4]
    monkeypatch.setattr(T, "CHUNK", 128)
    assert T.media_rows(texts) == whole
    assert [x[:7] for x in T.media_rows(texts, keep=False)] == [x[:7] for x in whole]
