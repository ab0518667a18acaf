import re
from collections import defaultdict

import numpy as np
import pytest

from veriplumb.llm import components, neardup
from veriplumb.llm.queries import op5_minhash

from .cases import SF, clashing, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=2):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n=2):
    """All pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(op5_minhash(spark, SF)) == brute(rows)


def test_group_around_a_centre_and_strays(spark):
    """Copies that differ from a base by 0 to 15 % of words: some link to it alone, some with one another, some with none."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for i in rng.choice(150, int(rng.integers(0, 24)), replace=False):
            words[i] = f"x{k}_{i}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(5000 + k, " ".join(f"z{k}_{i}" for i in range(int(rng.integers(1, 40))))) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_duplicates(df, words=2)) == brute(rows)
    assert got(neardup.near_duplicates(df)) == brute(rows, 5)


def test_second_pass_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 16)
    test_group_around_a_centre_and_strays(spark)


@pytest.mark.parametrize("size", [None, "n_shingles"])
def test_blocks_let_all_pairs_of_different_components_meet(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "SIDE", 16)
    monkeypatch.setattr(neardup, "SHINGLES", 200)
    rows = [("large", i, 1 if i < 300 else i // 3, 10 * (1 + i % 9)) for i in range(320)] + [("small", i, i % 2, 1) for i in range(10)] + [("even", i, i % 20, 5) for i in range(60)]
    df = neardup.staged(spark.createDataFrame(rows, "key string, node long, comp long, n_shingles long"))
    dealt = defaultdict(list)
    for r in neardup._sides(df, ["key"], size).collect():
        dealt[r["key"], r["low"], r["high"]].append((r["node"], r["comp"]))
    met = {(k, *sorted((a, b))) for (k, _, _), block in dealt.items() for a, x in block for b, y in block if x != y}
    assert met == {(k, a, b) for k, a, x, _ in rows for j, b, y, _ in rows if j == k and a < b and x != y}
    assert all(len(block) == len(set(block)) for block in dealt.values()) and {k for k in dealt if k[0] == "small"} == {("small", 0, 0)}
    assert all(len({c for _, c in block}) > 1 for (k, a, b), block in dealt.items() if a != b)
    large = sum(len(block) for (k, *_), block in dealt.items() if k == "large")
    # 300 rows in 19 cuts meet 20 others in 2, which meet all 21; were all cuts to meet, there would be 20 * 320 rows
    assert max(map(len, dealt.values())) < 80 and (size is not None or large == 300 * 2 + 20 * 21)


def test_cases(spark):
    rows = neardup.near_duplicates(clashing(documents(spark)), words=2).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(tuple(r)[1:])
    assert by[1] == [(11, 1, True)] and by[2] == [(11, 1, False)] and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert sorted(by[6]) == [(1, 6, True), (1, 6, True)] and by[7] == [(1, 6, False)]
    assert by[8][0][1:] == (8, True) and by[9][0][1:] == (8, False)
    assert sorted(by[None], key=repr) == [(0, None, True), (4, None, True)]
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_kept_rows(spark):
    docs = documents(spark)
    assert neardup.distinct(docs, words=2).count() == docs.count() - 3
    assert neardup.distinct(docs).columns == docs.columns or set(neardup.distinct(docs).columns) == set(docs.columns)


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (4, 9)], [(5, 100 - i) for i in range(40)] + [(i, i + 1) for i in range(200, 260)]])
def test_components(spark, links):
    up = {}
    find = lambda i: i if up.setdefault(i, i) == i else find(up[i])
    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    out = components.components(spark.createDataFrame(links, "u long, v long"))
    assert sorted(map(tuple, out.collect())) == sorted((i, find(i)) for i in list(up))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 2**63, 400).astype(np.uint64)]))
    same = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same - 3600 / 4400) < 0.2


def test_distinct_goes_by_rows_not_ids(spark):
    fox, owl = "the quick brown fox jumps over the lazy dog", "an old owl sat all night in the tall oak"
    rows = [(1, fox), (2, fox), (2, "nothing else is like this one text"), (3, None), (3, owl), (None, owl), (None, "sing a song of six little grey mice"), (None, "sing a song of six little grey mice and men")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in neardup.distinct(docs, words=1, percent=70).collect()]
    assert len(kept) == 5 and set(kept[:]) - set(rows[6:]) == {rows[0], rows[2], rows[3], rows[4]} and len(set(kept) & set(rows[6:])) == 1
