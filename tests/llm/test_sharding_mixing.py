import re
from collections import Counter

import pytest

from veriplumb.llm import mixing, sharding
from veriplumb.llm.queries import SHARDS, SLOTS, op3_sharding, op4_mixing

from .cases import SF, clashing, documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_fill(shards, size):
    """The filling by whole permutations."""
    order = {s: [(sharding._number(f"offset:{s}") % size + j * (sharding._number(f"step:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in shards}
    owner, at = [None] * size, Counter()
    while None in owner:
        for s in sorted(shards):
            while at[s] < size and owner[order[s][at[s]]] is not None:
                at[s] += 1
            if None in owner:
                owner[order[s][at[s]]] = s
    return owner


def test_table_against_whole_permutations():
    shards = [f"s{i}" for i in range(7)]
    assert [shards[i] for i in sharding.fill(shards, 101)] == plain_fill(shards, 101)
    counts = Counter(sharding.fill(SHARDS, SLOTS).tolist())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_removal_moves_little():
    a, b = sharding.fill(SHARDS, SLOTS), sharding.fill(SHARDS[:-1], SLOTS)
    stayed = a != len(SHARDS) - 1
    assert (a[stayed] != b[stayed]).mean() < 0.05


def test_bad_tables():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(shards, size)
    turns = Counter(sharding.fill(["a", "b"], 101, [3, 1]).tolist())
    assert turns[0] > 2.5 * turns[1]


def test_placement(spark):
    docs = documents(spark)
    rows = sharding.place(clashing(docs), "doc_id", SHARDS, SLOTS).collect()
    assert len(rows) == docs.count() and len({r["slot"] for r in rows if r["doc_id"] is None}) == 1
    assert sharding.place(empty(spark), "doc_id", SHARDS, SLOTS).count() == 0
    owner = sharding.fill(SHARDS, SLOTS)
    assert all(r["shard"] == SHARDS[owner[r["slot"]]] for r in op3_sharding(spark, SF).collect())


def plain_targets(sizes):
    """Water-filling by rounds."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or open_
    return target


@pytest.mark.parametrize("which", ["cases", "query"])
def test_mix_against_rounds(spark, which):
    docs = documents(spark) if which == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    got = (mixing.mix(clashing(docs)) if which == "cases" else op4_mixing(spark, SF)).collect()
    rows = docs.collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    assert sorted((r["doc_id"], size(r["text"])) if r["doc_id"] is not None else (-1, size(r["text"])) for r in rows) == sorted((r["doc_id"], r["size"]) if r["doc_id"] is not None else (-1, r["size"]) for r in got)
    target = plain_targets(sizes)
    key = {(sizes[s], round(t, 6)) for s, t in target.items()}
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == key
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by_id = {r["doc_id"]: r["source"] for r in rows if r["doc_id"] is not None}
    if which == "query":
        taken = Counter()
        for r in got:
            taken[by_id[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
        again = {r["doc_id"]: r["taken"] for r in op4_mixing(spark, SF).collect()}
        assert again == {r["doc_id"]: r["taken"] for r in got}


def test_materialised_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in mixing.materialise(docs).collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def test_empty_mix(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.materialise(empty(spark)).count() == 0
    assert mixing.mix(documents(spark).filter("text is null")).count() == 2
