import hashlib
import struct
import zlib

import numpy as np
import pytest

from veriplumb.llm import media
from veriplumb.llm.queries import op2_media

from .cases import SF, clashing, documents, empty


def test_every_filter_round_trips():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 24 * 40, dtype=np.uint8).tobytes()
    for filters in ([k] * 40 for k in range(5)):
        assert media.read_png(media.write_png(data, filters=np.array(filters))).tobytes() == data
    mixed = rng.integers(0, 5, 40)
    assert media.read_png(media.write_png(data, filters=mixed)).tobytes() == data


def test_damage_is_found():
    png = media.write_png(media.payload_of(b"hello"))
    for bad in (png[:-5], png[:40] + bytes([png[40] ^ 1]) + png[41:], b"x" + png, png[:8] + png[33:]):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_other_readers_accept_it():
    png = media.write_png(media.payload_of(b"abc"))
    at = 8
    while at < len(png):
        (n,) = struct.unpack_from(">I", png, at)
        assert zlib.crc32(png[at + 4 : at + 8 + n]) == struct.unpack_from(">I", png, at + 8 + n)[0]
        at += 12 + n
    assert at == len(png)


def expected(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


@pytest.mark.parametrize("which", ["cases", "query"])
def test_digests(spark, which):
    docs = clashing(documents(spark)) if which == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = (media.media_features(media.to_media(docs)) if which == "cases" else op2_media(spark, SF)).collect()
    want = sorted(((r["doc_id"], *expected(r["text"])) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == want
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())


def test_hash_sees_low_frequencies():
    rng = np.random.default_rng(1)
    image = np.clip(rng.normal(128, 5, (48, 24)) + 60 * np.sin(np.arange(24) / 5)[None], 0, 255).astype(np.uint8)
    near = np.clip(image + rng.integers(-1, 2, image.shape), 0, 255).astype(np.uint8)
    other = rng.integers(0, 256, (48, 24)).astype(np.uint8)
    bits = lambda a, b: bin(int(media.low_frequency_hash(a), 16) ^ int(media.low_frequency_hash(b), 16)).count("1")
    assert bits(image, near) < bits(image, other)


def test_empty(spark):
    assert media.media_features(media.to_media(empty(spark))).count() == 0
