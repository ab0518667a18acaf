import zlib

import numpy as np
import pytest

from veriplumb.llm import packing
from veriplumb.llm.queries import op1_packing, tokenizer_files

from .cases import SF, clashing, documents, empty


def exact_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files()[0])
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check(pieces, docs, room=1024):
    want = {}
    for r, ids in zip(docs, exact_ids([r["text"] for r in docs]), strict=True):
        want.setdefault((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), []).append(ids)
    used = {}
    for p in pieces:
        used.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for rows in used.values():  # gapless from 0, within the room
        at = 0
        for offset, n in sorted(rows):
            assert offset == at and n > 0
            at += n
        assert at <= room
    by = {}
    for p in pieces:
        by.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"], p["ids_crc32"]))
    total = 0
    for (doc, n, _), lists in want.items():
        for ids in lists:
            total += n
            own = by[doc, n]
            for at in range(0, n, room):
                part = np.array(ids[at : at + room], "<u4")
                own.remove((at, len(part), zlib.crc32(part.tobytes())))
    assert not any(by.values())
    return total / (room * len(used)) if used else 1


def test_cases(spark):
    docs = documents(spark)
    check(packing.pack(clashing(docs), *tokenizer_files()).collect(), docs.collect())
    assert packing.pack(empty(spark), *tokenizer_files()).count() == 0


def test_fast_and_exact_encoder_agree_on_special_strings():
    fast, exact = packing.Encoder(*tokenizer_files()), packing.Encoder(tokenizer_files()[0])
    for text in ("", "a<|endoftext|>b", "x  y\n\n z", "naïve 漢字 😀", "\x00\x01", " " * 50):
        assert fast.ids(text) == exact.ids(text)


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert check(op1_packing(spark, SF).collect(), docs) > 0.97


@pytest.mark.parametrize("n", [0, 1, 30, 20_000])
def test_plan_packs_the_histogram(n):
    rng = np.random.default_rng(n)
    h = {int(k): int(c) for k, c in zip(*np.unique(rng.integers(1, 129, n), return_counts=True), strict=True)}
    uses, got = packing.plan(h, 128), {}
    for pattern, k in uses:
        assert sum(a * b for a, b in pattern.items()) <= 128
        for a, b in pattern.items():
            got[a] = got.get(a, 0) + b * k
    assert got == h
    least = sum(a * b for a, b in h.items()) / 128
    assert sum(k for _, k in uses) <= 1.03 * least + 70


def test_knapsack_against_brute_force():
    lengths, prices = np.array([3, 4, 5]), np.array([0.31, 0.45, 0.5])
    value, pattern = packing.gain(prices, lengths, 13)
    best = max(a * 0.31 + b * 0.45 + c * 0.5 for a in range(5) for b in range(4) for c in range(3) if 3 * a + 4 * b + 5 * c <= 13)
    assert abs(value - best) < 1e-12 and abs((pattern * prices).sum() - best) < 1e-12 and (pattern * lengths).sum() <= 13


def test_token_ids_on_request(spark):
    rows = packing.pack(documents(spark).filter("doc_id = 8"), *tokenizer_files(), with_ids=True).orderBy("start").collect()
    assert [i for r in rows for i in r["ids"]] == exact_ids([documents(spark).filter("doc_id = 8").first()["text"]])[0]
